"""Spreadsheet references and small cell expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from disclens.fixed_values import DEPARTMENT_RING, MIN_PRODUCT_CODE, PLACEHOLDER_VALUES
from disclens.functions.text import strip


def normalise(cell: Column) -> Column:
    """Lower case with runs of white space closed up."""
    return F.lower(strip(F.regexp_replace(F.coalesce(cell, F.lit("")), r"\s+", " ")))


def present(cell: Column) -> Column:
    """The trimmed value, or NULL for what stands for nothing."""
    text = strip(cell)
    return F.when(~text.isin(PLACEHOLDER_VALUES), text)


def column_letter(index: Column) -> Column:
    """1 is A, 27 is AA, 703 is AAA: sheets have at most 16,384 columns, so three letters."""
    n = index.cast("bigint")
    letter = lambda x: F.char(F.lit(65) + F.pmod(x, F.lit(26)))
    third = letter(n - 1)
    second = letter(F.floor((n - 27) / 26))
    first = letter(F.floor((n - 703) / 676))
    return F.when(n <= 26, third).when(n <= 702, F.concat(second, third)).otherwise(
        F.concat(first, second, third)
    )


def a1_locator(sheet: Column, row: Column, col: Column) -> Column:
    return F.concat(sheet, F.lit("!"), column_letter(col), row.cast("string"))


def column_index(letters: Column) -> Column:
    return F.aggregate(
        F.filter(F.split(letters, ""), lambda c: c != ""),
        F.lit(0).cast("bigint"),
        lambda acc, c: acc * 26 + (F.ascii(c) - 64),
    )


def range_corner(ref: Column) -> Column:
    """`A1:J9131` as (rows, columns) of its far corner; NULLs where it is no reference."""
    corner = F.regexp_replace(F.element_at(F.split(ref, ":"), -1), r"\$", "")
    fits = corner.rlike(r"^[A-Z]{1,3}\d+$")
    return F.struct(
        F.when(fits, F.regexp_extract(corner, r"(\d+)$", 1).try_cast("bigint")).alias("rows"),
        F.when(fits, column_index(F.regexp_extract(corner, r"^([A-Z]{1,3})", 1))).alias("columns"),
    )


def product_code(upc: Column, description: Column) -> Column:
    """EXT-14: the code of a line, or NULL where the code names no product."""
    code = present(upc)
    ring = F.coalesce(strip(description).rlike(DEPARTMENT_RING), F.lit(False))
    return F.when((F.length(code) >= MIN_PRODUCT_CODE) & ~ring, code)


def tender_join(tenders: Column) -> Column:
    """EXT-11: every tender of a basket, blanks dropped, none at all as NULL."""
    named = F.filter(F.transform(tenders, lambda x: strip(x)), lambda x: x != "")
    return F.nullif(F.array_join(named, " + "), F.lit(""))
