"""Operators of retrieval and evaluation. All take and return DataFrames."""
