"""All queries of the core, with the SQL that checks them."""

from __future__ import annotations

from vellum.plans import graph, hierarchy, ingest, labels, library, monitor, ranking, retrieval, runs, search

_MODULES = [hierarchy, ranking, retrieval, monitor, ingest, labels, search, runs, graph, library]


def queries() -> dict:
    return {name: query for module in _MODULES for name, query in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in _MODULES for name, sql in module.SQL.items()}
