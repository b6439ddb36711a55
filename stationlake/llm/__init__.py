"""Operators for training-data pipelines: deduplication, filters, mixing, search, tokens.

Nothing else in the library imports this package.
"""
