"""Registered queries of the impact engine and their SQL oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tremor.sources.workspaces import Workspace

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function of a workspace under its name, with the SQL that gives the same rows in DuckDB."""

    def add(f: Callable[[Workspace], DataFrame]):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Workspace(spark, sf_dir))
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


from tremor.plans import cache_queries, change_queries, graph_queries, intent_queries, report_queries, source_queries  # noqa: E402, F401  they register
