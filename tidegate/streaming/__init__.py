"""Structured Streaming forms of the admission check."""
