"""Registry of named queries: each takes (spark, data directory) and returns a DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from augury.plans import oracle

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, check: str | None = None) -> Callable[[Query], Query]:
    """Register a query and, where SQL can say it on whole tables, its SQL form."""

    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if check is not None:
            ORACLES[name] = oracle.sql(check)
        return fn

    return add


def load() -> tuple[dict[str, Query], dict[str, str]]:
    from augury.plans import all_queries  # noqa: F401  (registers on import)

    return QUERIES, ORACLES
