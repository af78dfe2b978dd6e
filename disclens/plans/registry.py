"""The table of runnable queries and their SQL checks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from disclens.sources.canonical import Canonical

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
CHECKS: dict[str, str] = {}


def query(name: str, check: str | None = None):
    """Register ``fn(tables) -> DataFrame`` under ``name``, with its DuckDB check where one exists."""

    def register(fn: Callable[[Canonical], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(Canonical(spark, sf_dir))

        run.__name__ = name
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if check is not None:
            CHECKS[name] = check
        return fn

    return register
