"""Printed product names as labels, and labels as charges."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from disclens.fixed_values import CHARGE_WORDS, PRICE_PREFIX, PURCHASE_TIERS, REGISTER_DEPOSIT
from disclens.functions.text import strip


def clean_label(raw: Column) -> Column:
    """The name without a printed price and without opening punctuation, in any script."""
    without_price = F.regexp_replace(raw, PRICE_PREFIX, "")
    return strip(F.regexp_replace(without_price, r"^[^\p{L}\p{N}]+", ""))


def words(label: Column) -> Column:
    return F.filter(F.split(F.upper(label), r"\s+"), lambda w: w != "")


def is_non_product(label: Column) -> Column:
    """Every word is charge vocabulary, or the label is a register's deposit line."""
    tokens = words(label)
    vocabulary = F.array(*[F.lit(w) for w in CHARGE_WORDS])
    all_charge = (F.size(tokens) > 0) & (F.size(F.array_except(tokens, vocabulary)) == 0)
    return all_charge | F.array_join(tokens, " ").rlike(REGISTER_DEPOSIT)


def handle_for(label: Column, raw: Column, joined: Column) -> Column:
    """What a lookup matches on: the printed spelling, or the label where spellings were joined."""
    return F.when(joined, label).otherwise(raw)


def tier(purchases: Column) -> Column:
    expr = F.lit(None).cast("bigint")
    for level, floor in reversed(PURCHASE_TIERS):
        expr = F.when(purchases >= floor, F.lit(level).cast("bigint")).otherwise(expr)
    return expr


def initial_bucket(description: Column) -> Column:
    first = F.upper(F.left(strip(description), F.lit(1)))
    return F.when(first.rlike("^[A-Z]$"), first).otherwise(F.lit("#"))
