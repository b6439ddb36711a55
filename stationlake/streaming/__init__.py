"""Incremental aggregates with Structured Streaming."""
