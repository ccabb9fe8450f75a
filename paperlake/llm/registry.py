"""All queries of this package and their SQL."""

from __future__ import annotations

from paperlake.llm import (
    glyph_queries,
    leak_queries,
    name_queries,
    quality_queries,
    scan_queries,
    sentence_queries,
    survivor_queries,
    token_queries,
)

MODULES = (
    name_queries,
    survivor_queries,
    token_queries,
    sentence_queries,
    quality_queries,
    scan_queries,
    glyph_queries,
    leak_queries,
)


def queries() -> dict:
    return {name: query for module in MODULES for name, query in module.QUERIES.items()}


def oracle_sql() -> dict:
    return {name: sql for module in MODULES for name, sql in module.SQL.items()}
