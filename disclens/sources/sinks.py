"""Tables of requests: baskets with their lines inside, documents by place, counts, broken references. Saving is in ``store``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def flatten_result(nested: DataFrame) -> dict[str, DataFrame]:
    """SNK-01: baskets with their lines inside as the flat tables."""
    txn = nested.where(F.col("part") == 0).drop("items", "part")
    lines = nested.select("request_id", "txn_id", "part", F.posexplode("items").alias("position", "i"))
    return {"txn": txn, "txn_item": lines.select("request_id", "txn_id", "part", "position", "i.*")}


def resolve_doc_id(records: DataFrame, documents: DataFrame) -> DataFrame:
    """SNK-02: a document's place in its upload as its stored id, the first one where it has none."""
    first = documents.groupBy("request_id").agg(
        F.min_by("source_document_id", "position").alias("first_id")
    )
    placed = documents.select("request_id", "position", F.col("source_document_id").alias("own_id"))
    return (
        records.join(placed, ["request_id", "position"], "left")
        .join(first, "request_id", "left")
        .withColumn("resolved_id", F.coalesce("own_id", "first_id"))
        .drop("own_id", "first_id")
    )


def load_result(txns: DataFrame, items: DataFrame, most: int | None = None) -> DataFrame:
    """SNK-03: baskets with their lines inside, in stored order.

    The nesting is one basket deep. A request is the run of its baskets, never
    one value, so a very large request stays many rows. A basket is one row,
    ``part`` 0, whatever its size; only if ``most`` is given, one of more lines
    comes in several ``part`` rows of about that size.
    """
    part = F.lit(0)
    if most is not None:
        crowded = (
            items.groupBy("txn_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most)
            .select("txn_id", F.ceil(F.col("n") / most).alias("parts"))
        )
        items = items.join(crowded, "txn_id", "left")
        part = F.coalesce(F.pmod(F.xxhash64("item_id"), F.col("parts")), F.lit(0)).cast("int")
    lines = (
        items.groupBy("txn_id", part.alias("part"))
        .agg(
            F.array_sort(
                F.collect_list(F.struct("item_id", "description_raw", "upc", "quantity", "retail_amt", "loyalty_amt"))
            ).alias("items")
        )
    )
    return txns.join(lines, "txn_id", "left").withColumns(
        {
            "part": F.coalesce("part", F.lit(0)),
            "items": F.coalesce("items", F.array().cast(lines.schema["items"].dataType)),
        }
    )


def delete_cascade(tables: dict[str, DataFrame], removed: DataFrame) -> dict[str, DataFrame]:
    """SNK-04: the tables without the removed requests and whatever belongs to them."""
    gone = removed.select("request_id").distinct()
    kept = {
        name: df.join(gone, "request_id", "left_anti")
        for name, df in tables.items()
        if "request_id" in df.columns and name != "txn_item"
    }
    if "txn_item" in tables and "txn" in tables:
        lost = tables["txn"].join(gone, "request_id", "left_semi").select("txn_id")
        kept["txn_item"] = tables["txn_item"].join(lost, "txn_id", "left_anti")
    return kept


def ingest_summary(requests: DataFrame, txns: DataFrame, items: DataFrame, others: dict[str, DataFrame]) -> DataFrame:
    """SNK-05: what each request holds, in counts."""
    lines = items.select("txn_id").join(txns.select("txn_id", "request_id"), "txn_id")
    parts = {"txns": txns, "items": lines, **others}
    summary = requests.select("request_id")
    for name, df in parts.items():
        counted = df.groupBy("request_id").agg(F.count(F.lit(1)).alias(name))
        summary = summary.join(counted, "request_id", "left").withColumn(
            name, F.coalesce(name, F.lit(0)).cast("bigint")
        )
    return summary


def dangling_refs(references: list[tuple[str, DataFrame, str, DataFrame, str]]) -> DataFrame:
    """SNK-06: children whose parent is missing, by table.

    Each reference is (table, children, foreign key, parents, parent key).
    """
    found = None
    for table, children, key, parents, parent_key in references:
        known = parents.select(F.col(parent_key).alias("ref")).distinct()
        missing = (
            children.select(F.col(key).alias("ref"))
            .where(F.col("ref").isNotNull())
            .join(known, "ref", "left_anti")
            .groupBy("ref")
            .agg(F.count(F.lit(1)).alias("rows"))
            .select(F.lit(table).alias("table"), F.col("ref").cast("bigint").alias("ref"), "rows")
        )
        found = missing if found is None else found.unionByName(missing)
    return found
