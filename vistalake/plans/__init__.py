"""Registered queries: each has a Spark form and, where SQL can say it, a DuckDB form."""
