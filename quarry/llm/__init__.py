"""Operators for large-scale training-data pipelines.

Each module holds one operator with a general interface; ``queries`` holds the
registered ``opN_*`` queries and their SQL. Nothing outside imports this package.
"""
