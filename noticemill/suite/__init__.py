"""Queries over the given tables, each with the SQL that must give the same rows."""
