"""What batches leave behind: runs of rows that appear at once, and that are merged so that their number stays small.

A batch writes one run and then commits it by an empty file; a batch that is run
again after that finds its run and leaves it alone. Four runs of a level become
one of the next, so after n batches there are about 3 log4(n) of them, and each
row has been written again as often as there are levels.
"""

from __future__ import annotations

from collections.abc import Callable
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession

from disclens.sources import files

FAN_IN = 4


def _level(name: str) -> int:
    return int(name.split("-", 1)[0])


def _rows(store: str, name: str) -> str:
    return f"{store}/rows/run={name}"


def run_name(run: str, batch: int) -> str:
    return f"0-{run}-{batch:010}"


def is_committed(spark: SparkSession, store: str, name: str) -> bool:
    return files.exists(spark, f"{store}/commits/{name}")


def live_runs(spark: SparkSession, store: str) -> list[str]:
    """Committed runs that no later one has taken in."""
    committed = files.names(spark, f"{store}/commits")
    merged = [f"{store}/merged/{n}" for n in committed if _level(n)]
    taken = {t for path in merged for t in files.names(spark, path)}
    return [n for n in committed if n not in taken]


def read_runs(spark: SparkSession, store: str, names: list[str] | None = None) -> DataFrame | None:
    names = live_runs(spark, store) if names is None else names
    paths = [_rows(store, n) for n in names]
    return spark.read.option("basePath", f"{store}/rows").parquet(*paths).drop("run") if paths else None


def write_run(rows: DataFrame, store: str, name: str, by: str | None = None) -> None:
    """Rows as a run, in folders ``by`` a text column of few values where one is given; visible when this returns."""
    writer = rows.write.mode("overwrite")
    (writer.partitionBy(by) if by else writer).parquet(_rows(store, name))
    files.create(rows.sparkSession, f"{store}/commits/{name}")


def merge_runs(spark: SparkSession, store: str, combine: Callable[[DataFrame], DataFrame], by: str | None = None) -> None:
    """Bring runs of one level together as long as there are four of it."""
    while True:
        levels: dict[int, list[str]] = {}
        for name in live_runs(spark, store):
            levels.setdefault(_level(name), []).append(name)
        full = next((level for level in sorted(levels) if len(levels[level]) >= FAN_IN), None)
        if full is None:
            return
        name = f"{full + 1}-{uuid4().hex}"
        for taken in levels[full]:
            files.create(spark, f"{store}/merged/{name}/{taken}")
        write_run(combine(read_runs(spark, store, levels[full])), store, name, by)


def drop_merged(spark: SparkSession, store: str) -> int:
    """Remove the rows of runs that a later one holds, for when nobody reads them any more; how many."""
    gone = set(files.names(spark, f"{store}/commits")) - set(live_runs(spark, store))
    held = [n for n in sorted(gone) if files.exists(spark, _rows(store, n))]
    for name in held:
        files.delete(spark, _rows(store, name))
    return len(held)
