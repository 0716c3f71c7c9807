"""Registry of queries and of the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from archivelake.plans.sql_views import with_views

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, views: str = "") -> Callable[[Query], Query]:
    """Register a query; `sql` may use the named derived views."""

    def add(function: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"two queries are named {name!r}")
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = with_views(sql, views.split())
        return function

    return add
