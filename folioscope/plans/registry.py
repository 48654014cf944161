"""Registered queries: name → (Spark callable, DuckDB SQL or None)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name!r} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


WIDE = ("documents", "pages", "conversations", "events")


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A given table. One that sits in fewer files than there are cores is spread over all of them."""
    df = spark.read.parquet(f"{sf}/{name}.parquet")
    if name in WIDE and len(df.inputFiles()) < spark.sparkContext.defaultParallelism:
        return df.repartition(spark.sparkContext.defaultParallelism)
    return df
