"""Set-at-a-time operators: every public function maps DataFrames to DataFrames."""
