"""What the shared file system is asked for directly: whether a path is there, its names, an empty file made by one writer."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def exists(spark: SparkSession, path: str) -> bool:
    system, place = _at(spark, path)
    return bool(system.exists(place))


def names(spark: SparkSession, folder: str) -> list[str]:
    """The names in a folder, in order; none where the folder is missing."""
    system, place = _at(spark, folder)
    return sorted(s.getPath().getName() for s in system.listStatus(place)) if system.exists(place) else []


def create(spark: SparkSession, path: str) -> bool:
    """Make an empty file; False where it is there already, whoever made it."""
    system, place = _at(spark, path)
    system.mkdirs(place.getParent())
    return bool(system.createNewFile(place))


def delete(spark: SparkSession, path: str) -> None:
    system, place = _at(spark, path)
    system.delete(place, True)
