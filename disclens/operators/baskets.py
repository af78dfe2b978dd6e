"""Baskets: per-visit totals, footing, request headers and months."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from disclens.fixed_values import FOOTING_TOLERANCE
from disclens.functions.amounts import is_fractional, paid_amount, purchase_amount, saved_amount
from disclens.operators.scale import attach, top_n
from disclens.sources.staging import stage


def line_amounts(items: DataFrame) -> DataFrame:
    """PRJ-01: what each line cost and saved."""
    return items.withColumn("paid_amt", paid_amount()).withColumn("saved_amt", saved_amount())


def item_totals(items: DataFrame) -> DataFrame:
    """AGG-01 on the line side: one row per basket that has lines.

    Shelf and paid are summed over the same lines: whichever amount is present
    stands in for the missing one.
    """
    return items.groupBy("txn_id").agg(
        F.count(F.lit(1)).alias("item_count"),
        F.count("retail_amt").alias("shelf_lines"),
        F.coalesce(F.sum(purchase_amount()), F.lit(0).cast("decimal(18,2)")).alias("shelf_total"),
        F.coalesce(F.sum(paid_amount()), F.lit(0).cast("decimal(18,2)")).alias("paid_total"),
        F.sum("retail_amt").alias("retail_sum"),
    )


def basket_totals(txns: DataFrame, items: DataFrame) -> DataFrame:
    """AGG-01: every basket with its line totals; lines are aggregated before the join."""
    zero = F.lit(0).cast("decimal(18,2)")
    return (
        txns.join(item_totals(items), "txn_id", "left")
        .withColumn("item_count", F.coalesce("item_count", F.lit(0).cast("bigint")))
        .withColumn("shelf_lines", F.coalesce("shelf_lines", F.lit(0).cast("bigint")))
        .withColumn("shelf_total", F.coalesce("shelf_total", zero))
        .withColumn("paid_total", F.coalesce("paid_total", zero))
    )


def settle(baskets: DataFrame) -> DataFrame:
    """AGG-02: no lines, lines without any shelf price, and ordinary baskets."""
    lines = F.col("item_count") > 0
    shelved = lines & (F.col("shelf_lines") > 0)
    shelf = F.round("shelf_total", 2)
    paid = F.round("paid_total", 2)
    return baskets.select(
        *[c for c in baskets.columns if c not in ("shelf_total", "paid_total")],
        lines.alias("lines_disclosed"),
        F.when(shelved, shelf).alias("shelf_total"),
        F.when(lines, paid).alias("paid_total"),
        F.when(shelved, shelf - paid).alias("saved_total"),
        F.when(shelved, shelf - F.col("total_pre_discount")).alias("stated_pre_discount_delta"),
    )


def timeline_filter(
    txns: DataFrame,
    store: str | None = None,
    date_from: str | None = None,
    date_to: str | None = None,
) -> DataFrame:
    """FLT-01: a bare closing date covers its whole day."""
    if store:
        txns = txns.where(F.col("store_code") == store)
    if date_from:
        txns = txns.where(F.col("occurred_at") >= date_from)
    if date_to:
        until = date_to + "T23:59:59" if len(date_to) == 10 else date_to
        txns = txns.where(F.col("occurred_at") <= until)
    return txns


def basket_search(txns: DataFrame, items: DataFrame, text: str) -> DataFrame:
    """FLT-02: baskets holding a line whose name or code contains the text, literally."""
    needle = F.lower(F.lit(text))
    found = items.where(
        F.contains(F.lower("description_raw"), needle) | F.contains(F.lower("upc"), needle)
    ).select("txn_id")
    return txns.join(found, "txn_id", "left_semi")


def timeline(txns: DataFrame, items: DataFrame, query: str | None = None, **bounds) -> DataFrame:
    """AGG-03: settled baskets that pass the filters, with how many passed per request.

    The baskets that pass are written once; only their lines are totalled, the
    others leave before any shuffle by basket where those that pass are few.
    """
    kept = timeline_filter(txns, **bounds)
    if query:
        kept = basket_search(kept, items, query)
    if query or any(bounds.values()):
        kept = stage(kept)
        items = items.join(kept.select("txn_id"), "txn_id", "left_semi")
    settled = settle(basket_totals(kept, items))
    counted = kept.groupBy("request_id").agg(F.count(F.lit(1)).alias("filtered_count"))
    return attach(settled, counted, ["request_id"], "inner")


def basket_detail(txns: DataFrame, items: DataFrame) -> DataFrame:
    """AGG-04: the lines of each basket beside the totals they foot to."""
    totals = settle(basket_totals(txns, items)).select(
        "txn_id", "item_count", "shelf_total", "paid_total", "saved_total"
    )
    return line_amounts(items).join(totals, "txn_id")


def store_visits(txns: DataFrame) -> DataFrame:
    """FLT-06: visits per store, unnamed stores left out."""
    return (
        txns.where(F.col("store_code").isNotNull())
        .groupBy("request_id", "store_code")
        .agg(F.count(F.lit(1)).alias("visits"))
    )


def across_visits(baskets: DataFrame) -> DataFrame:
    """AGG-06: each visit at its stated total, or at what its shelf lines come to."""
    return baskets.groupBy("request_id").agg(
        F.round(
            F.coalesce(
                F.sum(F.coalesce("total_pre_discount", "retail_sum")), F.lit(0).cast("decimal(18,2)")
            ),
            2,
        ).alias("across_visits")
    )


def shelved_totals(baskets: DataFrame) -> DataFrame:
    """AGG-07: shelf and paid over the baskets with a shelf price on any line."""
    return (
        baskets.where(F.col("shelf_lines") > 0)
        .groupBy("request_id")
        .agg(F.sum("shelf_total").alias("shelved_shelf"), F.sum("paid_total").alias("shelved_paid"))
    )


def quantity_kind(items: DataFrame) -> DataFrame:
    """AGG-13: whether a request keeps measures in the quantity field, and whether it has any."""
    return items.groupBy("request_id").agg(
        F.coalesce(F.max(is_fractional(F.col("quantity"))), F.lit(False)).alias("is_measure"),
        (F.count("quantity") > 0).alias("quantity_disclosed"),
    )


def specific_pieces(requests: DataFrame, disclosures: DataFrame, txns: DataFrame) -> DataFrame:
    """AGG-10/11: whether purchases were disclosed, and whether a zero may be claimed."""
    pieces = (
        disclosures.where(F.col("category") == "SPECIFIC_PIECES")
        .groupBy("request_id")
        .agg(F.min("status").alias("pieces_status"))
    )
    shopped = txns.groupBy("request_id").agg(F.count(F.lit(1)).alias("_visits"))
    status = F.col("pieces_status")
    provided = F.coalesce(status == "provided", F.lit(False))
    partial = F.coalesce((status == "partial") & (F.col("_visits") > 0), F.lit(False))
    return (
        requests.select("request_id")
        .join(pieces, "request_id", "left")
        .join(shopped, "request_id", "left")
        .select("request_id", (provided | partial).alias("disclosed"), provided.alias("zero_claimable"))
    )


def _gate(condition: Column, *names: str) -> dict[str, Column]:
    return {name: F.when(condition, F.col(name)) for name in names}


def request_stats(
    requests: DataFrame,
    txns: DataFrame,
    items: DataFrame,
    disclosures: DataFrame,
    product_totals: DataFrame,
) -> DataFrame:
    """AGG-05/08/09: the header of each request, with figures that were not disclosed as NULL.

    ``product_totals`` is the index's own count per request, so that the headline
    and the list under it cannot disagree.
    """
    baskets = basket_totals(txns, items)
    amount = purchase_amount()
    line_stats = items.groupBy("request_id").agg(
        F.sum(F.when(amount == 0, 1).otherwise(0)).alias("zero_value_lines"),
        F.sum(F.when(amount < 0, 1).otherwise(0)).alias("negative_lines"),
    )
    zero = F.lit(0).cast("decimal(18,2)")
    visits = baskets.groupBy("request_id").agg(
        F.count(F.lit(1)).alias("basket_count"),
        F.min("occurred_at").alias("first_visit"),
        F.max("occurred_at").alias("last_visit"),
        F.sum("item_count").alias("line_count"),
        F.sum(F.when(F.col("item_count") > 0, 1).otherwise(0)).alias("itemised_count"),
        F.sum("paid_total").alias("summed_paid"),
        F.coalesce(F.sum("total_pre_discount"), zero).alias("total_stated"),
        F.coalesce(F.sum(F.coalesce("total_pre_discount", "retail_sum")), zero).alias("across_visits"),
        F.sum(F.when(F.col("shelf_lines") > 0, F.col("shelf_total"))).alias("total_shelf"),
        F.sum(F.when(F.col("shelf_lines") > 0, F.col("paid_total"))).alias("shelved_paid"),
    )
    counts = ("basket_count", "line_count", "itemised_count", "zero_value_lines", "negative_lines",
              "distinct_products")
    joined = (
        requests.select("request_id")
        .join(visits, "request_id", "left")
        .join(line_stats, "request_id", "left")
        .join(product_totals.select("request_id", F.col("total_products").alias("distinct_products")),
              "request_id", "left")
        .join(specific_pieces(requests, disclosures, txns), "request_id", "left")
        .withColumns({c: F.coalesce(F.col(c), F.lit(0)).cast("bigint") for c in counts})
        .withColumns({c: F.coalesce(F.col(c), zero) for c in ("total_stated", "across_visits", "summed_paid")})
    )
    lines = F.col("line_count") > 0
    partly = ~lines | (F.col("itemised_count") < F.col("basket_count"))
    headed = joined.withColumns(
        {
            "lines_disclosed": lines,
            "total_paid": F.when(partly, F.col("across_visits")).otherwise(F.col("summed_paid")),
            "total_saved": F.col("total_shelf") - F.col("shelved_paid"),
        }
    )
    by_lines = headed.withColumns(
        _gate(
            F.col("lines_disclosed"),
            "total_shelf", "total_saved", "distinct_products", "line_count", "zero_value_lines",
            "negative_lines", "itemised_count",
        )
    )
    return by_lines.withColumns(
        _gate(
            F.col("disclosed"),
            "basket_count", "total_shelf", "total_paid", "total_saved", "line_count",
            "distinct_products", "zero_value_lines", "negative_lines", "first_visit", "last_visit",
            "total_stated", "itemised_count",
        )
    ).select(
        "request_id", "basket_count", "first_visit", "last_visit", "line_count", "itemised_count",
        "zero_value_lines", "negative_lines", "distinct_products", "total_stated", "total_shelf",
        "total_paid", "total_saved", "lines_disclosed", "disclosed", "zero_claimable",
    )


def does_not_foot() -> Column:
    delta = F.col("stated_pre_discount_delta")
    return F.coalesce(F.abs(delta) >= F.lit(FOOTING_TOLERANCE).cast("decimal(18,2)"), F.lit(False))


def footing_summary(settled: DataFrame) -> DataFrame:
    """AGG-14: how many baskets of a request miss their stated total, and by how much at worst."""
    delta = F.col("stated_pre_discount_delta")
    off = does_not_foot()
    return settled.groupBy("request_id").agg(
        F.count(F.lit(1)).alias("baskets"),
        F.count_if(off).alias("not_footing"),
        F.max(F.when(off, F.abs(delta))).alias("worst_delta"),
        F.count_if(off & (delta > 0)).alias("over"),
        F.count_if(off & (delta < 0)).alias("under"),
    )


def worst_footing(settled: DataFrame, n: int) -> DataFrame:
    """SRT-06: the baskets furthest from their stated total, worst first."""
    off = settled.where(does_not_foot())
    order = [F.abs("stated_pre_discount_delta").desc(), F.col("occurred_at"), F.col("txn_id")]
    return top_n(off, ["request_id"], order, n, ["txn_id"])


def month_index(settled: DataFrame) -> DataFrame:
    """AGG-15: one row per month with visits.

    A month is drawn from what its itemised baskets paid, or from stated totals
    where none was itemised. The position of its first visit is the number of
    visits in earlier months, so no request is ever ranked row by row.
    """
    zero = F.lit(0).cast("decimal(18,2)")
    lines = F.col("lines_disclosed")
    months = settled.groupBy("request_id", F.left("occurred_at", F.lit(7)).alias("month")).agg(
        F.count(F.lit(1)).alias("visits"),
        F.count_if(lines).alias("itemised"),
        F.count_if(~lines).alias("unitemised"),
        F.coalesce(F.sum(F.when(lines, F.col("paid_total"))), zero).alias("summed"),
        F.coalesce(F.sum(F.when(lines, F.col("saved_total"))), zero).alias("saved"),
        F.coalesce(F.sum(F.when(~lines, F.col("total_pre_discount"))), zero).alias("stated"),
    )
    earlier = (
        Window.partitionBy("request_id")
        .orderBy("month")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    return months.select(
        "request_id", "month", "visits", "itemised", "unitemised",
        F.when(F.col("itemised") == 0, F.col("stated")).otherwise(F.col("summed")).alias("paid"),
        "saved", "stated",
        F.coalesce(F.sum("visits").over(earlier), F.lit(0)).cast("bigint").alias("first_index"),
    )


def month_fill(months: DataFrame) -> DataFrame:
    """AGG-16: every month from the first to the last, empty ones at zero with index -1."""
    first = F.to_date(F.concat("from_month", F.lit("-01")))
    last = F.to_date(F.concat("to_month", F.lit("-01")))
    calendar = (
        months.groupBy("request_id")
        .agg(F.min("month").alias("from_month"), F.max("month").alias("to_month"))
        .select("request_id", F.explode(F.sequence(first, last, F.expr("interval 1 month"))).alias("day"))
        .select("request_id", F.date_format("day", "yyyy-MM").alias("month"))
    )
    filled = calendar.join(months, ["request_id", "month"], "left")
    empty = {c: F.coalesce(F.col(c), F.lit(0)) for c in ("visits", "itemised", "unitemised", "paid", "saved", "stated")}
    return filled.withColumns({**empty, "first_index": F.coalesce("first_index", F.lit(-1).cast("bigint"))})
