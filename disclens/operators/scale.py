"""Shapes shared by the operators that must stay whole when one key is hot.

A request, product or document may hold a large share of all rows. No operator
here ranks or totals a raw group in one window: totals are aggregated (combined
map-side) and joined back, where adaptive execution splits a skewed side, and
rankings run over salted parts before the small final pass.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SALTS = 64


def attach(df: DataFrame, totals: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """``df`` with the columns of a per-key aggregate beside each row."""
    return df.join(totals, list(keys), how)


def dealt(df: DataFrame) -> DataFrame:
    """``df`` as a side of a join that is shuffled and never sent whole to each executor.

    Spark takes exploded rows and gathered lists for as small as the table they
    come from, so it would broadcast them however many there are.
    """
    return df.hint("merge")


def group_size(df: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """How many rows share the keys, beside each row."""
    return attach(df, df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name)), keys, "inner")


def top_n(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[Column],
    n: int,
    salt_on: Sequence[str],
    rank: str = "rank",
    salts: int = SALTS,
) -> DataFrame:
    """The first ``n`` rows of each group with their rank, exactly.

    Each salted part keeps its own first ``n``; only those reach the final
    ranking, so a hot group is ranked by ``salts`` tasks and finished by one
    that reads at most ``salts * n`` rows.
    """
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*salt_on), F.lit(salts)))
    part = Window.partitionBy(*group, "_salt").orderBy(*order)
    final = Window.partitionBy(*group).orderBy(*order)
    return (
        salted.withColumn("_part_rank", F.row_number().over(part))
        .where(F.col("_part_rank") <= n)
        .withColumn(rank, F.row_number().over(final).cast("bigint"))
        .where(F.col(rank) <= n)
        .drop("_salt", "_part_rank")
    )
