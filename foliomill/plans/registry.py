"""All queries of the core library, by name."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

#: Modules of this package with QUERIES and SQL.
MODULES = ("hierarchy", "retrieval", "analytics", "deid", "stream", "knowledge", "concepts", "search", "refresh", "resolve", "rules")

Query = Callable[[SparkSession, str], DataFrame]


def collect() -> tuple[dict[str, Query], dict[str, str]]:
    queries: dict[str, Query] = {}
    sql: dict[str, str] = {}
    for name in MODULES:
        module = import_module(f"foliomill.plans.{name}")
        queries |= module.QUERIES
        sql |= module.SQL
    return queries, sql
