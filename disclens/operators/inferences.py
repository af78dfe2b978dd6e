"""Scales, subjects and derivability of disclosed attributes, by rule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from disclens.fixed_values import (
    DERIVABLE_LABELS,
    HOUSEHOLD_ATTRIBUTES,
    ORDINAL_LABEL,
    ORDINAL_PREFIX,
    WORKBOOK_COUNT_LABEL,
    WORKBOOK_DERIVABLE_LABEL,
    WORKBOOK_HOUSEHOLD_LABEL,
    WORKBOOK_UNSETTLED_LABEL,
)
from disclens.functions.amounts import num_coerce
from disclens.functions.text import strip


def report_rules(inferences: DataFrame) -> DataFrame:
    """EXT-21: attributes a report lists under `Individual` or `Household`."""
    label, raw = F.col("label"), strip("value_raw")
    lowered = F.lower(label)
    number = num_coerce(raw).cast("double")
    leading = F.nullif(F.regexp_extract(raw, ORDINAL_PREFIX, 1), F.lit("")).cast("double")
    ordinal = label.rlike(ORDINAL_LABEL) | leading.isNotNull()
    currency = F.contains(label, F.lit("$")) | F.contains(lowered, F.lit("income"))
    scale = (
        F.when(ordinal, "ordinal_1_7")
        .when(number.isNotNull() & currency, "currency")
        .when(number.isNotNull(), "count")
        .otherwise("categorical")
    )
    household = (F.lower("bucket") == "household") | label.isin(HOUSEHOLD_ATTRIBUTES)
    pets: Column = F.lit(False)
    for hint in DERIVABLE_LABELS:
        pets = pets | F.contains(lowered, F.lit(hint))
    online = F.contains(lowered, F.lit("online")) & (
        F.contains(lowered, F.lit("shop")) | F.contains(lowered, F.lit("purchas"))
    )
    derivable = (
        F.when(pets, True)
        .when(online | (label == "onlineShopperLikelihood"), F.lit(None).cast("boolean"))
        .otherwise(label == "petOwner")
    )
    return inferences.where(raw != "").select(
        "inference_seq", "request_id", "label", scale.alias("scale"),
        F.coalesce(leading, number).alias("value_num"),
        F.when(household, "household").otherwise("individual").alias("subject"),
        derivable.alias("derivable_from_txns"),
    )


def workbook_rules(inferences: DataFrame) -> DataFrame:
    """EXT-21: attributes of a worksheet, where only the label says what a value is."""
    label, raw = F.col("label"), strip("value_raw")
    number = F.when(raw.rlike(r"^-?\d+(?:\.\d+)?$"), raw.try_cast("double"))
    thousands = F.contains(F.lower(label), F.lit("(in thousands)"))
    counted = label.rlike(WORKBOOK_COUNT_LABEL)
    scale = (
        F.when(number.isNotNull() & thousands, "currency")
        .when(number.isNotNull() & counted, "count")
        .otherwise("categorical")
    )
    return inferences.where(raw != "").select(
        "inference_seq", "request_id", "label", scale.alias("scale"),
        number.alias("value_num"),
        F.when(label.rlike(WORKBOOK_HOUSEHOLD_LABEL), "household").alias("subject"),
        F.when(~label.rlike(WORKBOOK_UNSETTLED_LABEL), label.rlike(WORKBOOK_DERIVABLE_LABEL)).alias("derivable_from_txns"),
    )
