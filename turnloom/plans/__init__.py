"""Registered queries over the fixed tables, each with its DuckDB statement."""
