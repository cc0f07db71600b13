"""The queries of the score operators and their SQL oracles, gathered from the modules beside."""

from __future__ import annotations

from cantata.jobs import more_queries, score_queries, text_queries

MODULES = (text_queries, score_queries, more_queries)


def queries() -> dict:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
