"""Operators on telemetry, client updates and scores."""
