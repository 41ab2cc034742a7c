"""All queries and their SQL twins."""

from __future__ import annotations

from plumbline.plans import code_queries, graph_queries, history_queries, session_queries, stats_queries

MODULES = [history_queries, graph_queries, stats_queries, code_queries, session_queries]


def queries() -> dict:
    return {name: q for m in MODULES for name, (q, _) in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, (_, sql) in m.QUERIES.items() if sql}
