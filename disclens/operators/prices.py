"""Price history: what each product cost, where its amounts can be read as a price.

Points are reduced to a histogram of distinct unit amounts per product before
anything is gathered, so what meets in one place is *different prices* and never
purchases. The sorted prices of a product come in chunks of bounded size; the
clusters, which are found from the lowest price upwards, go from chunk to chunk
by the anchor that is open at its end, and every other figure is worked out per
chunk and brought together per product.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from disclens.fixed_values import (
    DRIFT_MARGIN,
    MIN_OBSERVATIONS,
    REPEAT_SHARE,
    SAME_PRICE,
    TREND_SHARE,
    WEIGHT_SPREAD,
)
from disclens.functions.amounts import count_of, near_multiple, paid_amount, per_unit
from disclens.operators.baskets import quantity_kind
from disclens.operators.products import Identity, dated_purchases, restore_collisions
from disclens.operators.scale import top_n
from disclens.sources.staging import discard, stage

CHUNK_PRICES = 4096
#: Prices are counted by cells of this ratio, of which a product has a few thousand at most, to cut its chunks.
CELL_RATIO = 1.005
SERIES = ["request_id", "key"]


def price_points(items: DataFrame, txns: DataFrame) -> DataFrame:
    """PRC-03: one row per purchase, with unit amounts where the request states counts."""
    kinds = quantity_kind(items).select("request_id", "is_measure")
    return _points(dated_purchases(items, txns).join(kinds, "request_id"))


def _points(dated: DataFrame, *more: str) -> DataFrame:
    count = F.when(~F.col("is_measure"), count_of(F.col("quantity")))
    return dated.withColumn("count", count).select(
        "request_id", "product_key", "item_id", "txn_id", "on_date", "occurred_at",
        "description_raw", "upc", "retail_amt",
        paid_amount().alias("paid_amt"),
        (F.col("retail_amt") - paid_amount()).alias("saved_amt"),
        "quantity", "count",
        per_unit(F.col("retail_amt"), F.col("count")).alias("unit_retail"),
        per_unit(paid_amount(), F.col("count")).alias("unit_paid"), *more,
    )


def series_points(points: DataFrame, heads: DataFrame) -> DataFrame:
    """PRC-04: points under the head of their name group.

    ``place`` orders a series: by date, then the group's members in their own
    order, then as the receipt had them.
    """
    return _placed(points.join(heads, ["request_id", "product_key"], "left"))


def _placed(points: DataFrame) -> DataFrame:
    # Of a product that is its own group no member has to be told from another, and the time goes on where the day ends.
    member = F.when(F.col("head_key").isNotNull(), F.col("product_key"))
    return (
        points.withColumn("key", F.coalesce("head_key", "product_key"))
        .withColumn("unit_amount", F.coalesce("unit_retail", "unit_paid"))
        .withColumn(
            "place",
            F.struct("on_date", F.length(member).alias("size"), member.alias("member"), F.substr("occurred_at", F.lit(11)).alias("time"), "item_id"),
        )
        .drop("head_key")
    )


def stored_series(items: DataFrame, txns: DataFrame, identity: Identity) -> DataFrame:
    """PRC-03/04, written once for all that is worked out from it, with only the columns those need; ``place`` holds day and line.

    What a request and a product add to a line stands in one row per product, so the lines are shuffled once.
    """
    kinds = quantity_kind(items).select("request_id", "is_measure")
    marks = identity.entry.join(identity.heads, ["request_id", "product_key"], "left").join(kinds, "request_id")
    marks = stage(marks.select("request_id", "product_key", "head_key", "is_measure"))
    points = _placed(_points(dated_purchases(items, txns).join(marks, ["request_id", "product_key"]), "head_key"))
    kept = stage(points.select(*SERIES, "unit_amount", "unit_paid", "retail_amt", "place"), "zstd")
    discard(marks)
    return kept.withColumns({"on_date": F.col("place.on_date"), "item_id": F.col("place.item_id")})


def amount_histogram(series: DataFrame) -> DataFrame:
    """Distinct unit amounts of each product with their count."""
    return series.groupBy(*SERIES, "unit_amount").agg(F.count(F.lit(1)).alias("n"))


# -- clusters of like amounts -------------------------------------------------


def _same_price(amount: Column, anchor: Column) -> Column:
    a, c = amount.cast("double"), anchor.cast("double")
    return F.abs(a - c) / c <= F.lit(SAME_PRICE)


CLUSTER_TYPE = "array<struct<anchor:decimal(18,4),n:bigint,total:decimal(38,4)>>"


def cluster_fold(prices: Column, anchor: Column | None = None) -> Column:
    """PRC-05 over an ascending array of (amount, n): only the last cluster can take an amount.

    ``anchor`` is that of a cluster still open from lower prices; it comes first, with what it takes here.
    """
    open_ = F.array(F.struct(anchor.alias("anchor"), F.lit(0).cast("bigint").alias("n"), F.lit(0).cast("decimal(38,4)").alias("total"))) if anchor is not None else F.array()

    def step(acc: Column, x: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        alone = F.struct(
            x["amount"].alias("anchor"), x["n"].alias("n"),
            (x["amount"] * x["n"]).cast("decimal(38,4)").alias("total"),
        )
        grown = F.struct(
            last["anchor"].alias("anchor"), (last["n"] + x["n"]).alias("n"),
            (last["total"] + x["amount"] * x["n"]).cast("decimal(38,4)").alias("total"),
        )
        fits = F.coalesce(_same_price(x["amount"], last["anchor"]), F.lit(False))
        return F.when(
            fits, F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(grown))
        ).otherwise(F.concat(acc, F.array(alone))).cast(CLUSTER_TYPE)

    return F.aggregate(prices, open_.cast(CLUSTER_TYPE), step)


def _amount_at(prices: Column, place: Column) -> Column:
    """The amount of the purchase at a place from 0 in ascending (amount, n), or NULL if it is not among them."""
    found = F.aggregate(
        prices,
        F.struct(F.lit(0).cast("bigint").alias("before"), F.lit(None).cast("double").alias("value")),
        lambda acc, x: F.struct(
            (acc["before"] + x["n"]).alias("before"),
            F.when((acc["before"] <= place) & (place < acc["before"] + x["n"]), x["amount"].cast("double")).otherwise(acc["value"]).alias("value"),
        ),
    )
    return found["value"]


def _base_columns(summary: DataFrame) -> DataFrame:
    """PRC-06, first half: the biggest cluster and its mean.

    Ties go to the anchor nearest the median, then to the lower one.
    """
    ranked = F.transform(
        "clusters",
        lambda c: F.struct(
            (-c["n"]).alias("votes"),
            F.abs(c["anchor"].cast("double") - F.col("median")).alias("off"),
            c["anchor"].alias("anchor"),
            c["total"].alias("total"),
        ),
    )
    return (
        summary.withColumn("_big", F.array_min(ranked))
        .withColumn("biggest", -F.col("_big.votes"))
        .withColumn(
            "common", F.round(F.col("_big.total") / F.col("biggest"), 2).cast("decimal(18,4)")
        )
        .drop("_big")
    )


def _divides(amount: Column, base: Column) -> Column:
    return (amount < base) & near_multiple(base.cast("double") / amount.cast("double")).isNotNull()


def _to_the_cent(amount: Column) -> Column:
    """An amount of four places at two, rounded as the binary number it is: 0.145 lies below the half."""
    return (F.floor(amount.cast("double") * 100 + 0.5) / 100).cast("decimal(18,4)")


def _above_drift(amount: Column, base: Column) -> Column:
    return amount.cast("double") > base.cast("double") * F.lit(1 + DRIFT_MARGIN)


def multiple_of(amount: Column, base: Column, gap: Column) -> Column:
    """PRC-08: near a multiple of the base, with nothing seen on the way up to it.

    ``gap`` is the smallest amount that has clearly left the base.
    """
    a, b = amount.cast("double"), base.cast("double")
    nearest = near_multiple(a / b)
    on_the_way = F.coalesce(gap.cast("double") < b * (nearest - F.lit(DRIFT_MARGIN)), F.lit(False))
    return F.when((b > 0) & ~on_the_way, nearest)


def _chunked(histogram: DataFrame, most: int) -> tuple[DataFrame, int]:
    """The histogram with each price's ``chunk``, ascending within a product, and the last number of any chunk."""
    wide = histogram.groupBy(*SERIES).agg(F.count(F.lit(1)).alias("prices")).where(F.col("prices") > most)
    cell = F.floor(F.log(F.col("unit_amount").cast("double")) / F.log(F.lit(CELL_RATIO)))
    celled = histogram.withColumn("cell", cell)
    cells = celled.join(wide.select(*SERIES), SERIES, "left_semi").groupBy(*SERIES, "cell").agg(F.count(F.lit(1)).alias("prices"))
    upwards = Window.partitionBy(*SERIES).orderBy("cell")
    before = F.coalesce(F.sum("prices").over(upwards.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = cells.withColumn("part", F.floor(before / most))
    chunk = F.dense_rank().over(Window.partitionBy(*SERIES).orderBy("part")) - 1
    numbered = stage(parts.withColumn("chunk", chunk).select(*SERIES, "cell", "chunk"))
    last = numbered.agg(F.max("chunk")).first()[0]
    if last is None:
        return histogram.withColumn("chunk", F.lit(0)), 0
    placed = celled.join(numbered, [*SERIES, "cell"], "left").drop("cell")
    return placed.withColumn("chunk", F.coalesce("chunk", F.lit(0))), last


def _across(chunks: DataFrame, last: int, **figures: Column) -> DataFrame:
    """Figures of chunks as those of their product, beside each chunk; they are that where every product is one chunk."""
    if not last:
        return chunks
    chunks = stage(chunks)
    totals = stage(chunks.groupBy(*SERIES).agg(*[figure.alias(name) for name, figure in figures.items()]))
    return chunks.drop(*figures).join(totals, SERIES)


def _clusters(chunks: DataFrame, last: int) -> DataFrame:
    """PRC-05: chunks with the clusters of their product, each chunk taken up where the one below it ended."""
    if not last:
        return chunks.withColumn("clusters", cluster_fold(F.col("prices")))
    chunks = stage(chunks)
    found, ends = [], None
    for number in range(last + 1):
        own = chunks.where(F.col("chunk") == number)
        fold = cluster_fold(F.col("prices")) if ends is None else cluster_fold(F.col("prices"), F.col("anchor"))
        folded = stage((own if ends is None else own.join(ends, SERIES)).select(*SERIES, fold.alias("clusters")))
        ends = folded.select(*SERIES, F.element_at("clusters", -1)["anchor"].alias("anchor"))
        found.append(folded)
    parts = reduce(DataFrame.unionByName, found).select(*SERIES, F.explode("clusters").alias("c"))
    whole = parts.groupBy(*SERIES, F.col("c.anchor").alias("anchor")).agg(
        F.sum("c.n").alias("n"), F.sum("c.total").cast("decimal(38,4)").alias("total")
    )
    # A cluster spans three per cent, so a product has some hundreds.
    listed = F.array_sort(F.collect_list(F.struct("anchor", "n", "total"))).cast(CLUSTER_TYPE)
    return chunks.join(stage(whole.groupBy(*SERIES).agg(listed.alias("clusters"))), SERIES)


def product_prices(series: DataFrame, chunk_prices: int = CHUNK_PRICES, store: bool = False) -> DataFrame:
    """PRC-05..08, 11: clusters, base price, multiples and end points, one row per product.

    A chunk holds about ``chunk_prices`` different prices, so no task gathers a
    product; each figure is that of the chunks brought together. End points are
    worked out where somebody reads them; with ``store`` the figures that they
    and the rest go by are written for it.
    """
    figures = _figures(series, chunk_prices)
    figures = stage(figures, "zstd") if store else figures
    return figures.join(end_points(series, figures), SERIES, "left")


def _figures(series: DataFrame, chunk_prices: int) -> DataFrame:
    """PRC-05..08 from the histogram of prices."""
    histogram, last = _chunked(stage(amount_histogram(series), "zstd"), chunk_prices)
    price = F.struct(F.col("unit_amount").alias("amount"), "n")
    # Where every product is one chunk, it stays where the histogram's rows of it met.
    group = [*SERIES, "chunk"] if last else SERIES
    chunks = histogram.groupBy(*group).agg(F.array_sort(F.collect_list(price)).alias("prices"), F.sum("n").alias("points"))
    below = Window.partitionBy(*SERIES).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    chunks = chunks.withColumns(
        {
            "below": F.coalesce(F.sum("points").over(below), F.lit(0)) if last else F.lit(0).cast("bigint"),
            "low": F.element_at("prices", 1)["amount"],
            "high": F.element_at("prices", -1)["amount"],
        }
    )
    chunks = _across(chunks, last, points=F.sum("points"), low=F.min("low"), high=F.max("high"))
    middle = lambda place: _amount_at(F.col("prices"), F.floor(place) - F.col("below"))
    chunks = chunks.withColumns({"lower": middle((F.col("points") - 1) / F.lit(2)), "upper": middle(F.col("points") / F.lit(2))})
    chunks = _across(chunks, last, lower=F.max("lower"), upper=F.max("upper"))
    chunks = _base_columns(_clusters(chunks.withColumn("median", (F.col("lower") + F.col("upper")) / F.lit(2.0)), last))
    first_where = lambda test: F.try_element_at(F.filter("prices", lambda p: test(p["amount"])), F.lit(1))["amount"]
    chunks = _across(chunks.withColumn("unit", first_where(lambda a: _divides(a, F.col("common")))), last, unit=F.min("unit"))
    chunks = chunks.withColumn("base", F.coalesce(_to_the_cent(F.col("unit")), F.col("common")))
    chunks = _across(chunks.withColumn("gap", first_where(lambda a: _above_drift(a, F.col("base")))), last, gap=F.min("gap"))
    is_multiple = lambda p: multiple_of(p["amount"], F.col("base"), F.col("gap")).isNotNull()
    multiples = F.aggregate(F.filter("prices", is_multiple), F.lit(0).cast("bigint"), lambda acc, p: acc + p["n"])
    chunks = chunks.withColumn("multiples", multiples)
    whole = ["points", "low", "high", "median", "clusters", "biggest", "base", "gap"]
    if last:
        stored = stage(chunks.drop("prices"))
        counted = stored.groupBy(*SERIES).agg(F.sum("multiples").alias("multiples"))
        chunks = stored.where("chunk = 0").select(*SERIES, *whole).join(stage(counted), SERIES)
    return chunks.select(*SERIES, *whole, "multiples")


def end_points(series: DataFrame, figures: DataFrame) -> DataFrame:
    """PRC-11: the first and last point of each product, of all and of those that are no multiples, and whether each has a shelf price.

    Points meet the base price by product as one value, so that the join is not
    the partitioning of the totals: a hot product's points are split over tasks,
    each totals its own, and only totals are brought together.
    """
    own = figures.select(F.struct(*SERIES).alias("_series"), "base", "gap")
    points = series.select(F.struct(*SERIES).alias("_series"), *SERIES, "unit_amount", "retail_amt", F.struct("place.*", "unit_paid").alias("_seen"))
    single = F.when(multiple_of(F.col("unit_amount"), F.col("base"), F.col("gap")).isNull(), F.col("_seen"))
    return points.join(own, "_series").groupBy(*SERIES).agg(
        F.min("_seen").alias("first_point"), F.max("_seen").alias("last_point"),
        F.min(single).alias("first_single"), F.max(single).alias("last_single"),
        F.bool_and(F.col("retail_amt").isNotNull()).alias("shelf_disclosed"),
    )


# -- direction and shape ------------------------------------------------------


def trends(series: DataFrame) -> DataFrame:
    """PRC-09: whether a series mostly moves one way.

    Steps are counted inside each day and then between the days, so a series is
    never read by one task row after row.
    """
    day = [*SERIES, "on_date"]
    in_day = Window.partitionBy(*day).orderBy("place")
    step = F.col("unit_amount") - F.lag("unit_amount").over(in_day)
    days = (
        series.withColumn("_step", step)
        .groupBy(*day)
        .agg(
            F.count_if(F.col("_step") > 0).alias("ups"),
            F.count_if(F.col("_step") < 0).alias("downs"),
            F.min_by("unit_amount", "place").alias("opening"),
            F.max_by("unit_amount", "place").alias("closing"),
        )
    )
    across = F.col("opening") - F.lag("closing").over(Window.partitionBy(*SERIES).orderBy("on_date"))
    totals = (
        days.withColumn("_step", across)
        .groupBy(*SERIES)
        .agg(
            (F.sum("ups") + F.count_if(F.col("_step") > 0)).alias("ups"),
            (F.sum("downs") + F.count_if(F.col("_step") < 0)).alias("downs"),
        )
    )
    moves = F.col("ups") + F.col("downs")
    one_way = F.greatest("ups", "downs").cast("double") / F.nullif(moves, F.lit(0)).cast("double")
    return totals.withColumn(
        "trending", F.coalesce((moves >= 3) & (one_way >= F.lit(TREND_SHARE)), F.lit(False))
    )


def price_shape(series: DataFrame, chunk_prices: int = CHUNK_PRICES, store: bool = False) -> DataFrame:
    """PRC-10: unit, multiple or weight, with the figures the verdict rests on; with ``store`` those are written one after the other."""
    priced = product_prices(series, chunk_prices, store)
    moving = trends(series).select(*SERIES, "trending")
    moving = stage(moving, "zstd") if store else moving
    scattered = (
        (F.col("biggest").cast("double") / F.col("points").cast("double") <= F.lit(REPEAT_SHARE))
        & (F.col("points") >= 4)
        & (F.col("high").cast("double") / F.col("low").cast("double") > F.lit(WEIGHT_SPREAD))
    )
    kind = (
        F.when(F.col("multiples") > 0, "multiple")
        .when(scattered & ~F.coalesce("trending", F.lit(False)), "weight")
        .otherwise("unit")
    )
    return priced.join(moving, SERIES, "left").withColumn("shape", kind)


def marked_points(series: DataFrame, shapes: DataFrame) -> DataFrame:
    """PRC-08 on every point of every series."""
    return series.join(shapes.select(*SERIES, "base", "gap"), SERIES).withColumn(
        "multiple_of", multiple_of(F.col("unit_amount"), F.col("base"), F.col("gap"))
    )


def price_change(shapes: DataFrame) -> DataFrame:
    """PRC-11: first and last single-item prices, and the change of a unit-priced product."""
    first_price = F.coalesce(F.col("first_single.unit_paid"), F.col("first_point.unit_paid"))
    last_price = F.coalesce(F.col("last_single.unit_paid"), F.col("last_point.unit_paid"))
    singles = F.col("points") - F.col("multiples")
    a, b = F.col("first_price").cast("double"), F.col("last_price").cast("double")
    return shapes.withColumn("first_price", first_price).withColumn("last_price", last_price).withColumn(
        "change_pct",
        F.when(
            (F.col("shape") == "unit") & (singles >= 2) & (a != 0), F.round((b - a) / a * 100, 1)
        ),
    )


def price_history(
    items: DataFrame,
    txns: DataFrame,
    identity: Identity,
    min_observations: int = MIN_OBSERVATIONS,
    limit: int | None = None,
    series: DataFrame | None = None,
) -> DataFrame:
    """PRC-12: the priced products of each request; with a limit (the reader's own is 200), so many of each, priceable ones first.

    ``series`` is the stored series where the caller has it already.
    """
    series = stored_series(items, txns, identity) if series is None else series
    figures = price_change(price_shape(series, store=True)).drop("clusters")
    named = identity.dim.where(~F.col("refused") & (F.col("purchases") >= min_observations))
    rows = named.drop("first_seen", "last_seen").join(figures, SERIES).select(
        *SERIES, "upc", "label", "match_name", "purchases", "shape",
        F.col("base").alias("base_price"), F.col("multiples").alias("multiple_count"), (F.col("shape") == "unit").alias("priceable"),
        F.col("first_point.on_date").alias("first_seen"), F.col("last_point.on_date").alias("last_seen"),
        "first_price", "last_price", F.col("low").alias("min_price"), F.col("high").alias("max_price"),
        "shelf_disclosed", "change_pct",
    )
    shown = restore_collisions(stage(rows, "zstd")).select(
        *SERIES, "upc", "description", "match_name", "purchases", "shape", "base_price", "multiple_count", "priceable",
        "first_seen", "last_seen", "first_price", "last_price", "min_price", "max_price", "shelf_disclosed", "change_pct",
    )
    discard(series)
    if limit is None:
        return shown
    order = [F.col("priceable").desc(), F.col("purchases").desc(), F.col("description"), F.col("key")]
    return top_n(shown, ["request_id"], order, limit, ["key"])


def price_counts(products: DataFrame) -> DataFrame:
    """PRC-12: counted before the limit."""
    return products.groupBy("request_id").agg(
        F.count(F.lit(1)).alias("product_count"), F.count_if(F.col("priceable")).alias("priceable_count")
    )
