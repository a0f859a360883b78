"""Structured Streaming forms of the incremental tables."""
