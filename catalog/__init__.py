"""Queries over the test tables, each with the SQL text that must give the same rows."""
