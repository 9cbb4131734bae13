"""Operators: DataFrames and parameters in, a lazy DataFrame out."""
