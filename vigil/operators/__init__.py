"""Operators: DataFrames in, a DataFrame out, nothing collected on the way."""
