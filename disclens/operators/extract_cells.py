"""Worksheets as long cell tables: headers, lines, baskets and the warnings they leave."""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from disclens.fixed_values import HEADER_ROWS_READ, MIN_POINT_ROWS, REPEATED_WARNINGS
from disclens.functions.amounts import num_coerce
from disclens.functions.cells import a1_locator, normalise, present, product_code
from disclens.functions.dates import serial_date
from disclens.functions.text import strip
from disclens.operators.scale import top_n

SHEET = ["doc_id", "sheet"]


def header_map(cells: DataFrame, expected: list[str], required: list[str]) -> DataFrame:
    """EXT-12: where each expected column sits, found by name in the first rows.

    The first row holding every required header wins; of two columns with one
    name the later wins.
    """
    names = sorted({h.lower() for h in [*expected, *required]})
    head = cells.where(F.col("row_no") <= HEADER_ROWS_READ).withColumn("name", normalise(F.col("value"))).where(F.col("name").isin(names))
    at = lambda h: F.col("name") == h.lower()
    rows = (
        head.groupBy(*SHEET, "row_no")
        .agg(
            *[F.max(at(h)).alias(f"needs_{i}") for i, h in enumerate(required)],
            *[F.max(at(h)).alias(f"has_{i}") for i, h in enumerate(expected)],
            *[F.max(F.when(at(h), F.col("col_no"))).alias(f"col_{i}") for i, h in enumerate(expected)],
        )
        .where(reduce(and_, [F.col(f"needs_{i}") for i in range(len(required))], F.lit(True)))
    )
    found = F.array(
        *[F.struct(F.lit(h).alias("header"), F.col(f"col_{i}").alias("col_no"), F.col(f"has_{i}").alias("has")) for i, h in enumerate(expected)]
    )
    return (
        rows.groupBy(*SHEET)
        .agg(F.min(F.struct("row_no", found.alias("found"))).alias("first"))
        .where(F.col("doc_id").isNotNull() & F.col("sheet").isNotNull())
        .select(*SHEET, F.col("first.row_no").alias("header_row"), F.explode(F.filter("first.found", lambda f: f["has"])).alias("f"))
        .select(*SHEET, "header_row", "f.header", "f.col_no")
    )


def sheet_lines(cells: DataFrame, columns: DataFrame, expected: list[str]) -> DataFrame:
    """The rows under the header as one record each, fields by header name.

    A sheet's columns stand in one row, so its cells meet them and become lines
    in one shuffle by sheet, the columns looked up by hash and no cell sorted for
    it; a worksheet holds 1,048,576 rows at most.
    """
    at = [F.max(F.when(F.col("header") == h, F.col("col_no"))).alias(f"_at_{i}") for i, h in enumerate(expected)]
    is_at = [F.col("col_no") == F.col(f"_at_{i}") for i in range(len(expected))]
    body = cells.join(columns.groupBy(*SHEET, "header_row").agg(*at).hint("shuffle_hash"), SHEET).where(
        (F.col("row_no") > F.col("header_row")) & reduce(or_, is_at)
    )
    return body.groupBy(*SHEET, "row_no").agg(*[F.max(F.when(here, F.col("value"))).alias(h) for here, h in zip(is_at, expected, strict=True)])


def read_lines(lines: DataFrame) -> DataFrame:
    """Each sheet line with its date, basket and amounts, and what is wrong with it."""
    return lines.select(
        *SHEET, "row_no",
        serial_date(F.col("TXN_DTE")).alias("occurred_at"),
        present(F.col("TXN_ID")).alias("external_order_id"),
        present(F.col("STORE_ID")).alias("store_code"),
        F.coalesce("UPC_DSC", F.lit("")).alias("description_raw"),
        product_code(F.col("UPC_ID"), F.col("UPC_DSC")).alias("upc"),
        num_coerce(F.col("QTY")).alias("quantity"),
        num_coerce(F.col("NET")).alias("loyalty_amt"),
        F.col("UPC_DSC").isNull().alias("unnamed"),
    )


BASKET = [*SHEET, "external_order_id"]


def baskets(read: DataFrame) -> DataFrame:
    """EXT-13: one basket per transaction number of a sheet, dated by its first line."""
    placed = read.where(F.col("occurred_at").isNotNull() & F.col("external_order_id").isNotNull())
    first = placed.groupBy(*BASKET).agg(
        F.min_by("occurred_at", "row_no").alias("occurred_at"),
        F.min_by("store_code", "row_no").alias("store_code"),
        F.count(F.lit(1)).alias("lines"),
    )
    return first


def line_warnings(read: DataFrame) -> DataFrame:
    """EXT-13: what a line costs: itself where it cannot be placed, otherwise only a remark."""
    placed = F.col("occurred_at").isNotNull() & F.col("external_order_id").isNotNull()
    first = baskets(read).select(*BASKET, F.col("occurred_at").alias("basket_date"))
    joined = read.join(first, BASKET, "left")
    finding = lambda test, severity, message: F.when(
        test, F.struct(F.lit(severity).alias("severity"), F.lit(message).alias("message"))
    )
    found = F.array(
        finding(F.col("occurred_at").isNull(), "warning", "Skipped a line with no readable date."),
        finding(
            F.col("occurred_at").isNotNull() & F.col("external_order_id").isNull(),
            "warning", "Skipped a line with no transaction number, so no basket to put it in.",
        ),
        finding(
            placed & (F.col("occurred_at") != F.col("basket_date")), "info",
            "A transaction number appears on more than one date; its lines are kept together under the first.",
        ),
        finding(placed & F.col("unnamed"), "info", "A line had no description."),
        finding(placed & F.col("loyalty_amt").isNull(), "warning",
                "A line had no readable amount; it is kept, with none."),
    )
    return joined.select(*SHEET, "row_no", F.explode(F.filter(found, lambda w: w.isNotNull())).alias("w")).select(
        *SHEET, "row_no", "w.severity", "w.message"
    )


def warning_cap(warnings: DataFrame, key: str, seq: str) -> DataFrame:
    """EXT-15: the first few of each repeated warning, and one row counting the rest."""
    group = [key, "severity", "message"]
    kept = top_n(warnings, group, [F.col(seq)], REPEATED_WARNINGS, [seq]).select(*group, F.col(seq).alias("at"))
    extra = F.col("n") - REPEATED_WARNINGS
    rest = (
        warnings.groupBy(*group)
        .agg(F.count(F.lit(1)).alias("n"))
        .where(extra > 0)
        .select(
            key, "severity",
            F.concat(extra.cast("string"), F.lit(" more lines like the above: "), "message").alias("message"),
            F.lit(None).cast("string").alias("at"),
        )
    )
    return kept.unionByName(rest)


def declared_size(cells: DataFrame, declared: DataFrame) -> DataFrame:
    """EXT-16: sheets whose declared size is not what was read."""
    read = cells.groupBy(*SHEET).agg(F.max("row_no").alias("last_row"), F.max("col_no").alias("widest"))
    rows = F.coalesce(F.col("declared_rows") != F.col("last_row"), F.lit(False))
    columns = F.coalesce(F.col("widest") > F.col("declared_columns"), F.lit(False))
    return (
        declared.join(read, SHEET)
        .withColumn("rows_differ", rows)
        .withColumn("too_wide", columns)
        .where(rows | columns)
    )


def column_redundancy(pairs: DataFrame, key: str) -> DataFrame:
    """EXT-17: whether one column is merely the other rounded, on every row carrying both."""
    both = F.col("amount_raw").isNotNull() & F.col("point_raw").isNotNull()
    amount, point = num_coerce(F.col("amount_raw")), num_coerce(F.col("point_raw"))
    fits = F.coalesce(
        (point == F.round(point, 0)) & (F.abs(point - amount) <= F.lit(0.5).cast("decimal(2,1)")),
        F.lit(False),
    )
    return pairs.groupBy(key).agg(
        F.coalesce(F.bool_and(F.when(both, fits)), F.lit(False)).alias("all_fit"),
        F.count_if(both).alias("both_present"),
    ).select(
        key,
        (F.col("all_fit") & (F.col("both_present") >= MIN_POINT_ROWS)).alias("holds"),
        F.when(F.col("all_fit") & (F.col("both_present") >= MIN_POINT_ROWS), F.col("both_present"))
        .otherwise(0).cast("bigint").alias("checked_rows"),
    )


def locate(cells: DataFrame) -> DataFrame:
    """SC-01 on every cell."""
    return cells.withColumn("locator", a1_locator(F.col("sheet"), F.col("row_no"), F.col("col_no")))


def visit_evidence_text() -> Column:
    """A statement of visits in words: ``visits``, ``stores``, ``itemised`` and ``captures`` counted."""
    fields = F.when(F.col("stores") > 0, "a date, a store and a total").otherwise("a date and a total")
    detail = F.when(
        F.col("itemised") > 0,
        F.concat(
            F.col("itemised").cast("string"), F.lit(" of them itemised, from "), F.col("captures").cast("string"),
            F.lit(" screen captures of the receipts."),
        ),
    ).otherwise(F.lit("No line items."))
    return F.concat(F.col("visits").cast("string"), F.lit(" visits, each with "), fields, F.lit(". "), detail)


def visit_evidence(counts: DataFrame) -> DataFrame:
    """EXT-29: what a statement of visits amounts to, counted.

    ``counts`` holds (request_id, visits, stores, itemised, captures).
    """
    return counts.select("request_id", visit_evidence_text().alias("evidence"))
