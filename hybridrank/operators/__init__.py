"""Relational operators: every module maps DataFrames to DataFrames."""
