"""Queries over the driver tables, and the SQL that says the same."""
