"""Registry of named queries and their DuckDB oracle SQL.

A query is a function ``(spark, sf_dir) -> DataFrame`` built from the library
operators; its oracle is an ANSI SQL text over the driver's tables (with the
event view as a CTE). Queries whose result depends on a trained model have no
oracle and are checked by invariants in the tests.
"""

from __future__ import annotations

from collections.abc import Callable

from .sources.tables import EVENT_VIEW_SQL

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}
HEADLINE: list[str] = []


def query(name: str, oracle: str | None = None, headline: bool = False):
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        if headline:
            HEADLINE.append(name)
        return fn
    return deco


def ev_sql(body: str, *ctes: str) -> str:
    """Oracle text with the event view (and further CTEs) in front of ``body``."""
    parts = [f"ev as ({EVENT_VIEW_SQL})"] + list(ctes)
    return "with " + ",\n".join(parts) + "\n" + body
