"""Operators: each takes and returns DataFrames, for all users at once."""
