"""Queries over the given tables, and the SQL that each one must equal."""
