"""Composed stages and the catalogue of checked queries."""
