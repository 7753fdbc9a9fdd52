"""Operators over the memory graph: DataFrames in, lazy DataFrames out."""
