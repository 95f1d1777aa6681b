"""Readers and views of plant records."""
