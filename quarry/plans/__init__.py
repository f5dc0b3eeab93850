"""Registered queries of the retrieval and evaluation engine."""
