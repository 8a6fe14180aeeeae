"""Operators for training-data pipelines: deduplication, filtering, scoring and tokenising of text.

Every operator takes DataFrames and returns DataFrames. Nothing else in the library imports this
subpackage; ``queries`` registers one query per operator.
"""
