"""Where queries and their SQL are registered."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def add(name: str, make: Query, sql: str | None = None) -> None:
    if name in QUERIES:
        raise ValueError(f"{name} is registered already")
    QUERIES[name] = make
    if sql:
        SQL[name] = sql


def over(name: str, source: Query, sql: str, made: Callable[[], dict[str, Column]]) -> None:
    """Columns made from the rows of a source; they are built when the query is, as that needs a session."""
    add(name, lambda spark, folder: source(spark, folder).select(*(c.alias(k) for k, c in made().items())), sql)
