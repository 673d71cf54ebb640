"""All queries of this subpackage, with the SQL that checks them."""

from __future__ import annotations

from vellum.llm import budget_queries, conversation_queries, lookalike_queries, packing_queries, quantile_queries, reading_queries, split_queries, tokenize_queries

_MODULES = [budget_queries, conversation_queries, lookalike_queries, packing_queries, quantile_queries, reading_queries, split_queries, tokenize_queries]


def queries() -> dict:
    return {name: query for module in _MODULES for name, query in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in _MODULES for name, sql in module.SQL.items()}
