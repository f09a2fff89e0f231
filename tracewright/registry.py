"""Where queries are registered, each with the SQL that its result is held against where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tracewright.views import table, with_views

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = with_views(sql)
        return f

    return add


def on(view: Callable[[SparkSession, str], DataFrame], name: str, sql: str | None) -> Callable[[Callable[[DataFrame], DataFrame]], None]:
    """Registers a query that takes one view alone."""

    def add(f: Callable[[DataFrame], DataFrame]) -> None:
        query(name, sql)(lambda spark, sf_dir: f(view(spark, sf_dir)))

    return add


def source(name: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: table(spark, sf_dir, name)
