"""Small helpers of the text operators: rows keyed by document, and connected components."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from disclens.sources.staging import discard, stage

ID, TEXT = "source_document_id", "text"


def source_text(documents: DataFrame) -> DataFrame:
    """Id and whole text of each source document; every other column is left behind, a missing text is empty."""
    return documents.select(F.col(ID), F.coalesce(F.col(TEXT), F.lit("")).alias(TEXT))


def rows_of(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[tuple]:
    """The rows of Arrow batches as tuples of Python values, one batch in memory at a time."""
    for batch in batches:
        yield from zip(*(batch.column(n).to_pylist() for n in names))


def components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` for every node of the edges ``(a, b)``; the component is its smallest node.

    Stars are grown over larger and then over smaller neighbours until no edge
    changes. Each step is a minimum per node and a join, so a node with very
    many neighbours is never gathered; each round is written to the shared
    folder, so a lost executor costs a re-read.
    """
    links = stage(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = None
    while True:
        shape = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if shape[0] == 0 or tuple(shape) == seen:
            break
        seen = tuple(shape)
        last, links = links, stage(_small_star(_large_star(links)))
        discard(last)
    return links.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        links.select("b", "b").distinct()
    )


def _large_star(links: DataFrame) -> DataFrame:
    both = links.union(links.select("b", "a"))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    least = links.groupBy("a").agg(F.min("b").alias("m"))
    moved = links.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
