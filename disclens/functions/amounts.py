"""Amounts and quantities as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from disclens.fixed_values import (
    MULTIPLE_TOLERANCE,
    WHOLE_TOLERANCE,
)
from disclens.functions.text import strip

MONEY = "decimal(18,4)"


def num_coerce(text: Column) -> Column:
    """A printed amount as a decimal; blank, junk and non-finite text give NULL."""
    return F.regexp_replace(strip(text), "[$,]", "").try_cast(MONEY)


def product_key(upc: Column = None, description: Column = None) -> Column:
    """The code where there is one, else the printed name; blank names nothing."""
    upc = F.col("upc") if upc is None else upc
    description = F.col("description_raw") if description is None else description
    return F.coalesce(F.nullif(upc, F.lit("")), F.nullif(description, F.lit("")))


def purchase_amount() -> Column:
    """The amount a line is judged by: shelf price where disclosed, else the price paid."""
    return F.coalesce(F.col("retail_amt"), F.col("loyalty_amt"))


def paid_amount() -> Column:
    return F.coalesce(F.col("loyalty_amt"), F.col("retail_amt"))


def saved_amount() -> Column:
    """NULL where no shelf price was disclosed: subtraction carries the NULL through."""
    return F.col("retail_amt") - paid_amount()


def is_fractional(quantity: Column) -> Column:
    q = quantity.cast("double")
    return F.abs(q - F.rint(q)) > F.lit(WHOLE_TOLERANCE)


def count_of(quantity: Column) -> Column:
    """A quantity as a count of two or more, or NULL."""
    return F.when((quantity >= 2) & ~is_fractional(quantity), F.rint(quantity.cast("double")).cast("bigint"))


def per_unit(amount: Column, count: Column) -> Column:
    """The line amount over its count at four places, or the amount unchanged."""
    exact = amount.cast(MONEY)
    return F.when(count.isNull(), exact).otherwise(F.round(exact / count, 4).cast(MONEY))


def near_multiple(ratio: Column) -> Column:
    """The whole number from two up that a ratio sits on, with tolerance growing with it."""
    nearest = F.rint(ratio)
    return F.when(
        (nearest >= 2) & (F.abs(ratio - nearest) <= F.lit(MULTIPLE_TOLERANCE) * nearest),
        nearest.cast("bigint"),
    )
