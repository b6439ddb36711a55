"""Operators over station series."""
