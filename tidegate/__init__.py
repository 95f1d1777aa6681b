"""Spark-native engine for process telemetry, admission checks and training text."""
