"""Intermediate results written once and read many times.

A result that several later steps read is written as a parquet table in the
shared folder of the session. That cuts the lineage (a lost executor re-reads
files instead of recomputing joins), keeps column pruning and filter pushdown
for each reader, and gives adaptive execution real sizes.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession

from disclens.session import shared_folder
from disclens.sources import files

#: Whether Spark removes the shuffle files of a query as soon as it ends (Spark 4.1; earlier ones ignore it).
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_released(spark: SparkSession) -> Iterator[None]:
    """What is written inside leaves no shuffle files: nobody reads them again, and else they stay until the driver collects its garbage."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)


def stage(df: DataFrame, compression: str | None = None) -> DataFrame:
    """``df`` written and read again; wide tables that several steps read may name a closer compression than the session's."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/staged/{uuid4().hex}"
    with shuffles_released(spark):
        df.write.parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)


def discard(*staged: DataFrame) -> None:
    """Remove results of ``stage`` that no step reads any more; files of other folders stay."""
    for df in staged:
        spark = df.sparkSession
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if folder.rsplit("/", 1)[0].endswith("/staged"):
                files.delete(spark, folder)
