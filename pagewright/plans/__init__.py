"""Queries over the test tables, with DuckDB counterparts."""
