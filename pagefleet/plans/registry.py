"""Registry of queries over the driver tables, each with its DuckDB oracle SQL.

A query is ``fn(spark, sf_dir) -> DataFrame``. Its oracle, when the semantics
are SQL-expressible, is an ANSI SQL string over the same tables. Column names
and types are aligned on both sides.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pagefleet.session import configure

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}


def register(name: str, oracle: str | None = None) -> Callable[[QueryFn], QueryFn]:
    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")

        @functools.wraps(fn)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            configure(spark)
            return fn(spark, sf_dir)

        QUERIES[name] = run
        if oracle is not None:
            ORACLE[name] = oracle.strip()
        return fn

    return deco


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def slug_sql(expr: str) -> str:
    """DuckDB spelling of route_slug, used inside oracle strings."""
    return f"trim(regexp_replace(lower({expr}), '[^a-z0-9]+', '-', 'g'), '-')"
