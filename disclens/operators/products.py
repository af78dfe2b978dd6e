"""Product identity and the product index."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from disclens.fixed_values import INDEX_LIMIT, PURCHASE_TIERS, STALE_AFTER_DAYS
from disclens.functions.amounts import product_key, purchase_amount
from disclens.functions.dates import day_number, day_text
from disclens.functions.labels import clean_label, handle_for, is_non_product, tier
from disclens.functions.text import strip
from disclens.operators.scale import attach, top_n
from disclens.sources.staging import discard, stage


def purchases(items: DataFrame) -> DataFrame:
    """FLT-05: the lines that are purchases of something nameable."""
    return items.withColumn("product_key", product_key()).where(
        F.col("product_key").isNotNull() & (purchase_amount() > 0)
    )


def dated_purchases(items: DataFrame, txns: DataFrame) -> DataFrame:
    """JN-02: purchases with the day of their visit, joined only where the lines do not carry it."""
    if "occurred_at" in items.columns:
        return purchases(items).withColumn("on_date", F.left("occurred_at", F.lit(10)))
    visits = txns.select("txn_id", "occurred_at", F.left("occurred_at", F.lit(10)).alias("on_date"))
    return purchases(items).join(visits, "txn_id")


def spelling_votes(dated: DataFrame, key: str = "product_key") -> DataFrame:
    """Sightings per cleaned spelling of each product.

    A spelling that cleans away keeps its raw form. The raw spelling behind a
    cleaned one is the shortest, then the first alphabetically. Lines are first
    counted per printed spelling, by hash and before any shuffle; names are
    cleaned once per spelling and not once per line.
    """
    day = day_number(F.col("on_date"))
    printed = dated.groupBy("request_id", key, "upc", "description_raw").agg(
        F.count(F.lit(1)).alias("sightings"), F.min(day).alias("first_day"), F.max(day).alias("last_day")
    )
    raw = F.col("description_raw")
    return printed.groupBy(
        "request_id", key, F.coalesce(F.nullif(clean_label(raw), F.lit("")), raw).alias("folded")
    ).agg(
        F.sum("sightings").alias("sightings"),
        F.min(F.struct(F.length(raw).alias("size"), raw.alias("raw"))).alias("shortest"),
        F.max(F.nullif(F.col("upc"), F.lit(""))).alias("upc"),
        F.min("first_day").alias("first_day"),
        F.max("last_day").alias("last_day"),
    )


def entries(votes: DataFrame, key: str = "product_key") -> DataFrame:
    """PRD-03: one entry per product, named by its most seen spelling, then alphabetically."""
    best = F.min(
        F.struct((-F.col("sightings")).alias("votes"), F.col("folded"), F.col("shortest.raw").alias("raw"))
    )
    return (
        votes.groupBy("request_id", key)
        .agg(
            best.alias("best"),
            F.max("upc").alias("upc"),
            F.sum("sightings").alias("purchases"),
        )
        .select(
            "request_id", key, "upc",
            F.col("best.folded").alias("label"), F.col("best.raw").alias("raw"), "purchases",
        )
    )


def split_heads(entry: DataFrame) -> DataFrame:
    """PRD-04: uncoded entries whose names clean alike, each with the head it belongs to.

    Only members of groups of two or more without any code are returned.
    """
    named = entry.select(
        "request_id", "product_key", "upc",
        F.coalesce(
            F.nullif(F.upper(clean_label(F.col("label"))), F.lit("")), F.upper("label")
        ).alias("clean_name"),
    )
    groups = (
        named.groupBy("request_id", "clean_name")
        .agg(
            F.count(F.lit(1)).alias("members"),
            F.count("upc").alias("coded"),
            F.min(F.struct(F.length("product_key").alias("size"), F.col("product_key").alias("head"))).alias("first"),
        )
        .where((F.col("members") > 1) & (F.col("coded") == 0))
        .select("request_id", "clean_name", F.col("first.head").alias("head_key"))
    )
    return named.join(groups, ["request_id", "clean_name"]).select("request_id", "product_key", "head_key")


def join_split(votes: DataFrame, heads: DataFrame) -> DataFrame:
    """PRD-05: spellings folded onto their heads, as one entry per product.

    A product that no head takes has its spellings counted already, and is summed up where its votes met the heads.
    """
    product = ["request_id", "product_key"]
    # Heads take uncoded products only, whose votes have no code.
    folded = votes.where("upc is null").join(heads, product)
    merged = folded.groupBy("request_id", F.col("head_key").alias("key"), "folded").agg(
        F.sum("sightings").alias("sightings"),
        F.min("shortest").alias("shortest"),
        F.max("upc").alias("upc"),
        F.min("first_day").alias("first_day"),
        F.max("last_day").alias("last_day"),
    )
    alone = votes.join(heads, product, "left_anti")
    best = F.min(
        F.struct((-F.col("sightings")).alias("votes"), F.col("folded"), F.col("shortest.raw").alias("raw"))
    )
    figures = [
        best.alias("best"),
        F.max("upc").alias("upc"),
        F.sum("sightings").alias("purchases"),
        F.min("first_day").alias("first_day"),
        F.max("last_day").alias("last_day"),
    ]
    whole = alone.groupBy(*product).agg(*figures).withColumnRenamed("product_key", "key").withColumn("joined", F.lit(False))
    return whole.unionByName(merged.groupBy("request_id", "key").agg(*figures).withColumn("joined", F.lit(True))).select(
        "request_id", "key", "upc", "joined",
        F.col("best.folded").alias("label"), F.col("best.raw").alias("raw"), "purchases",
        day_text(F.col("first_day")).alias("first_seen"), day_text(F.col("last_day")).alias("last_seen"),
    )


class Identity(NamedTuple):
    """Who is who among the products: entries, split names with their heads, and one row per product where it was asked for."""

    entry: DataFrame
    heads: DataFrame
    dim: DataFrame | None = None


def named(items: DataFrame, txns: DataFrame) -> tuple[DataFrame, Identity]:
    """The spelling votes of every request, written once, with the entries and heads they give."""
    votes = stage(spelling_votes(dated_purchases(items, txns)), "zstd")
    # Three steps read the entries: heads twice, prices once.
    entry = stage(entries(votes), "zstd")
    return votes, Identity(entry, split_heads(entry))


def identify(items: DataFrame, txns: DataFrame) -> Identity:
    """Product identity of every request, worked out once for index and prices alike."""
    votes, found = named(items, txns)
    refused = (clean_label(F.col("raw")) == "") | is_non_product(F.col("label"))
    dim = join_split(votes, found.heads).withColumn("refused", refused)
    dim = stage(dim.withColumn("match_name", handle_for(F.col("label"), F.col("raw"), F.col("joined"))), "zstd")
    discard(votes)
    return found._replace(dim=dim)


def product_dim(items: DataFrame, txns: DataFrame) -> DataFrame:
    return identify(items, txns).dim


def repeated(products: DataFrame, name: str, flag: str) -> DataFrame:
    """``flag``: whether a name stands on more than one product of a request.

    Names are counted map-side and only those that repeat are written, so the
    products meet a plain table: small ones are broadcast by their size, and
    beyond that both sides are shuffled by request and name, which adaptive
    execution can split. No request is brought together.
    """
    twice = products.groupBy("request_id", name).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("request_id", name, F.lit(True).alias(flag))
    return products.join(stage(twice), ["request_id", name], "left").withColumn(flag, F.coalesce(flag, F.lit(False)))


def restore_collisions(products: DataFrame) -> DataFrame:
    """PRD-10: where a label stands on more than one product, all of them show their handle.

    ``products`` is read twice and should be a stored table.
    """
    return repeated(products, "label", "_alike").withColumn(
        "description", F.when(F.col("_alike"), F.col("match_name")).otherwise(F.col("label"))
    ).drop("_alike")


def shares_name(products: DataFrame) -> DataFrame:
    """PRD-10: whether the shown name still stands on more than one product."""
    return repeated(products, "description", "shares_name")


def coverage_end(dim: DataFrame) -> DataFrame:
    """PRD-09: the latest purchase over every entry, before any is set aside."""
    return dim.groupBy("request_id").agg(F.max("last_seen").alias("coverage_end")).withColumn(
        "stale_before",
        F.date_format(F.date_sub(F.to_date("coverage_end"), STALE_AFTER_DAYS), "yyyy-MM-dd"),
    )


def index_rows(dim: DataFrame) -> DataFrame:
    """PRD-07: the listed products with tier, shown name and whether they stopped."""
    # Stored on both sides of the join by request: a hot request is split, and what follows is dealt out by request and name.
    listed = attach(dim, stage(coverage_end(dim)), ["request_id"], "inner").where(~F.col("refused"))
    rows = listed.withColumn("tier", tier(F.col("purchases"))).withColumn(
        "stopped", (F.col("purchases") >= 2) & (F.col("last_seen") < F.col("stale_before"))
    )
    return shares_name(stage(restore_collisions(stage(rows)))).select(
        "request_id", "key", "upc", "description", "match_name", "purchases", "tier",
        "first_seen", "last_seen", "stopped", "shares_name",
    )


def index_totals(dim: DataFrame) -> DataFrame:
    """PRD-07: what the index counts per request, whatever is filtered later."""
    shown = ~F.col("refused")
    return attach(
        dim.groupBy("request_id").agg(
            F.count_if(shown).alias("total_products"),
            F.count_if(shown & (F.col("purchases") == 1)).alias("bought_once_total"),
            F.count_if(F.col("refused")).alias("set_aside"),
        ),
        coverage_end(dim),
        ["request_id"],
        "inner",
    )


def index_search(rows: DataFrame, query: str | None = None, min_purchases: int = 1) -> DataFrame:
    """FLT-03/04: applied to finished rows, so totals and names are those of the whole response."""
    if query:
        needle = F.lower(strip(F.lit(query)))
        rows = rows.where(
            F.contains(F.lower("description"), needle)
            | F.contains(F.lower("match_name"), needle)
            | F.contains(F.lower(F.coalesce("upc", F.lit(""))), needle)
        )
    return rows.where(F.col("purchases") >= min_purchases) if min_purchases > 1 else rows


def _cap_order():
    return [F.col("purchases").desc(), F.col("description"), F.col("key")]


def cap_rows(rows: DataFrame, limit: int = INDEX_LIMIT) -> DataFrame:
    """PRD-11: the most bought products of each request, up to the limit."""
    return top_n(rows, ["request_id"], _cap_order(), limit, ["key"])


def cap_summary(rows: DataFrame, limit: int = INDEX_LIMIT) -> DataFrame:
    """PRD-11: what the cap left out, and how often the most bought of it was bought."""
    # Rows leave the cap in the order of purchases, so only how many rows have each number of purchases matters:
    # they are counted before anything meets by request, and a request has few such numbers.
    counted = rows.groupBy("request_id", "purchases").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("stopped")).alias("stopped")
    )
    downwards = Window.partitionBy("request_id").orderBy(F.col("purchases").desc())
    past = F.sum("n").over(downwards.rowsBetween(Window.unboundedPreceding, 0)) > limit
    return (
        counted.withColumn("_past", past)
        .groupBy("request_id")
        .agg(
            F.sum("n").alias("product_count"),
            F.sum("stopped").alias("stopped_count"),
            F.max(F.when(F.col("_past"), F.col("purchases"))).alias("left_out_max_purchases"),
        )
        .select(
            "request_id", "product_count", "stopped_count",
            F.greatest(F.col("product_count") - limit, F.lit(0)).cast("bigint").alias("left_out"),
            F.coalesce("left_out_max_purchases", F.lit(0)).cast("bigint").alias("left_out_max_purchases"),
        )
    )


def tier_population(rows: DataFrame) -> DataFrame:
    """PRD-12: products per tier, all five tiers present, with the range each one stands for."""
    ladder = sorted(PURCHASE_TIERS)
    names = {}
    for (level, floor), above in zip(ladder, [*ladder[1:], None], strict=True):
        if floor == 1:
            names[level] = "once"
        elif above is None:
            names[level] = f"{floor}+"
        else:
            top = above[1] - 1
            names[level] = str(floor) if top == floor else f"{floor}–{top}"
    tiers = F.array(
        *[
            F.struct(
                F.lit(level).cast("bigint").alias("tier"),
                F.lit(floor).cast("bigint").alias("min_purchases"),
                F.lit(names[level]).alias("range"),
            )
            for level, floor in PURCHASE_TIERS
        ]
    )
    counts = rows.groupBy("request_id").agg(
        *[F.count_if(F.col("tier") == level).alias(f"_t{level}") for level, _ in PURCHASE_TIERS]
    )
    count = F.lit(0).cast("bigint")
    for level, _ in PURCHASE_TIERS:
        count = F.when(F.col("t.tier") == level, F.col(f"_t{level}")).otherwise(count)
    return counts.select("*", F.explode(tiers).alias("t")).select(
        "request_id", "t.tier", "t.min_purchases", "t.range", count.alias("products")
    )
