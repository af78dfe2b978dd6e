"""Source documents mixed to target weights: each retailer's words repeated at its own rate."""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from disclens.llm.shared import ID, TEXT
from disclens.sources.staging import stage

RETAILER = "retailer_id"
WEIGHTS = (1, 2, 3)
MOST = 3
SEED = "mix"
WORD = r"[^\x20\x09-\x0D]+"


def size_of(text: Column) -> Column:
    """Words of a text; a missing text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def draw_of(source_document_id: Column, text: Column, seed: str) -> Column:
    """A number from 0 to below 1 that the seed, the document's id and its text decide: 52 bits of their MD5."""
    named = F.concat(F.lit(f"{seed}:"), F.coalesce(source_document_id.cast("string"), F.lit("")), F.lit(":"), F.coalesce(text, F.lit("")))
    return F.conv(F.substring(F.md5(named), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def _numbered(retailers: DataFrame) -> DataFrame:
    """The retailers with their number from 0, by code point and the missing one last.

    Ranges are sorted side by side and numbered within; only the count of each
    range meets in one place.
    """
    order = F.col(RETAILER).asc_nulls_last()
    held = stage(
        retailers.repartitionByRange(order)
        .sortWithinPartitions(order)
        .select("*", F.spark_partition_id().alias("range"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("place"))
    )
    before = F.coalesce(F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = held.groupBy("range").agg(F.count(F.lit(1)).alias("n")).select("range", before.alias("before"))
    return held.join(ranges, "range").select(RETAILER, "retailer_size", (F.col("before") + F.col("place")).alias("number"))


def retailer_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST) -> DataFrame:
    """``(retailer_id, retailer_size, target)`` of ``sizes(retailer_id, size)``, one row a document.

    The retailers weigh ``weights`` in turn, by code point and the missing one
    last, and share the words of all documents. A target stops at ``most``
    times its retailer's words, and what that leaves goes to the others by
    weight until none is above. Each round is a sum over the retailers, of which
    three numbers come back; comparisons are exact.
    """
    retailers = _numbered(sizes.groupBy(RETAILER).agg(F.sum("size").alias("retailer_size")))
    turn = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("number") % len(weights) + 1).cast("int"))
    retailers = stage(retailers.select(RETAILER, "retailer_size", turn.cast("long").alias("weight")))
    words = retailers.agg(F.sum(F.col("retailer_size").cast("decimal(38,0)"))).first()[0] or Decimal(0)
    left, weight, full = int(words), None, F.lit(False)
    while True:
        held = retailers.agg(
            F.sum(F.when(full, F.col("retailer_size").cast("decimal(28,0)") * most)).alias("words"),
            F.sum(F.when(~full, F.col("weight"))).alias("weight"),
        ).first()
        if held.weight == weight:
            break
        left, weight = int(words) - int(held.words or 0), held.weight
        if not weight:
            break
        # Above its most: left / weight * own weight > most * own words.
        full = F.col("weight").cast("decimal(10,0)") * F.lit(Decimal(left)) > F.col("retailer_size").cast("decimal(19,0)") * F.lit(Decimal(most * int(weight)))
    share = F.lit(float(left)) / F.lit(float(weight or 1)) * F.col("weight").cast("double")
    target = F.when(full, (F.col("retailer_size") * most).cast("double")).otherwise(share)
    return stage(retailers.select(RETAILER, "retailer_size", target.alias("target")))


def _copies(rows: DataFrame, targets: DataFrame, most: int) -> DataFrame:
    """Rows of ``(retailer_id, size, draw, ...)`` with their retailer's figures and the number of copies."""
    own = targets.select(F.col(RETAILER).alias("_retailer"), "retailer_size", "target")
    rate = F.when(F.col("retailer_size") > 0, F.least(F.lit(float(most)), F.col("target") / F.col("retailer_size"))).otherwise(0.0)
    extra = F.when(F.col("draw") < F.col("rate") - F.floor("rate"), 1).otherwise(0)
    return (
        rows.join(own, F.col(RETAILER).eqNullSafe(F.col("_retailer")))
        .withColumn("rate", rate)
        .withColumn("copies", (F.floor("rate") + extra).cast("long"))
        .drop("_retailer")
    )


def mixing_plan(documents: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST, seed: str = SEED) -> DataFrame:
    """How often a mixture takes each source document, so that retailers' words come to their target weights.

    ``documents(source_document_id, retailer_id, text)``, the retailer being that
    of the document's request; other columns are ignored. Returns
    ``(source_document_id, retailer_id, size, retailer_size, target, rate,
    copies, taken)``: words of the text, of the retailer's documents, and of the
    retailer in the mixture; ``rate = target / retailer_size``; the document is
    taken ``floor(rate)`` times, and once more where its own draw falls below
    the fraction, so ``taken = copies * size`` and never above ``most`` times.

    A draw depends on the seed, the id and the text alone: reruns agree, and
    rows alike in id and text draw alike. A missing text has no words; a missing
    retailer is one of its own, last in order; a retailer without words has the
    target 0 and copies of none; an empty table gives no rows. Texts are read
    once; what is joined is four numbers a document, and the hot retailer's
    rows are split by adaptive execution or met by a broadcast that Spark sizes.
    """
    slim = stage(
        documents.select(
            F.col(ID), F.col(RETAILER), size_of(F.col(TEXT)).alias("size"), draw_of(F.col(ID), F.col(TEXT), seed).alias("draw")
        )
    )
    planned = _copies(slim, retailer_targets(slim, weights, most), most)
    return planned.select(ID, RETAILER, "size", "retailer_size", "target", "rate", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixed_documents(documents: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST, seed: str = SEED) -> DataFrame:
    """The mixture itself: all columns of the documents, a row for each copy, numbered from 1 by ``copy``.

    As :func:`mixing_plan`; a column ``copy`` of the documents gives way.
    """
    sizes = documents.select(F.col(RETAILER), size_of(F.col(TEXT)).alias("size"))
    rows = documents.select(
        F.struct("*").alias("_row"), F.col(RETAILER), size_of(F.col(TEXT)).alias("size"), draw_of(F.col(ID), F.col(TEXT), seed).alias("draw")
    )
    taken = _copies(rows, retailer_targets(sizes, weights, most), most).where("copies > 0")
    kept = [F.col("_row")[c].alias(c) for c in documents.columns if c.lower() != "copy"]
    return taken.select(*kept, F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("copy"))
