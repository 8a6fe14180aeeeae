"""Structured Streaming variants of the stateless and keyed-state operators."""
