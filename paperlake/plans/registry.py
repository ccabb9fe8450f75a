"""All core queries and their SQL."""

from __future__ import annotations

from paperlake.plans import read_queries, reference_queries, store_queries, stream_queries, text_queries

MODULES = (text_queries, read_queries, stream_queries, store_queries, reference_queries)


def queries() -> dict:
    return {name: query for module in MODULES for name, query in module.QUERIES.items()}


def oracle_sql() -> dict:
    return {name: sql for module in MODULES for name, sql in module.SQL.items()}
