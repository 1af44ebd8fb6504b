"""Operators of a training-data pipeline, and their queries.

Each module holds one operator with its thin query ``opN_<name>`` and, where
SQL can express it, the DuckDB text that the query is held against.
"""
