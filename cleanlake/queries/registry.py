"""Registry of runnable queries: key -> (Spark callable, SQL for the cross-check or None)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(key: str, sql: str | None = None):
    def register(fn):
        if key in QUERIES:
            raise KeyError(f"query {key} registered twice")
        QUERIES[key] = fn
        if sql:
            SQL[key] = sql
        return fn
    return register
