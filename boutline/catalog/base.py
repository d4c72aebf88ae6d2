"""Registry of named queries with their SQL oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def put(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} exists")
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return put


def r6(c: Column | str, name: str | None = None) -> Column:
    """Six digits, for comparison across engines."""
    return F.round(F.col(c).cast("double") if isinstance(c, str) else c.cast("double"), 6).alias(name or c)


def day(c: str, name: str | None = None) -> Column:
    return F.date_format(c, "yyyy-MM-dd").alias(name or c)
