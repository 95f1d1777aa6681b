"""Queries that combine operators, and the SQL that gives the same rows."""
