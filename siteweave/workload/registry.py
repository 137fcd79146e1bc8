"""Named queries with their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn: Callable[[SparkSession, str], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return register


def with_(*ctes: str, recursive: bool = False) -> str:
    """``WITH`` clause from CTE texts, each named once."""
    seen = dict.fromkeys(ctes)
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(seen) + "\n"
