"""Audit operators: DataFrames in, DataFrames out."""
