"""Operators: each takes and gives DataFrames, grouped by key columns and never looped over them."""
