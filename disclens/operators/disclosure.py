"""What each response answered: compliance, comparison, profile and the follow-up letter.

The eight categories and three origins are fixed lists carried as array
literals, so completing a request to all of them is an explode and never a
cross join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from disclens.fixed_values import (
    ABSENT_NOTE,
    CATEGORIES,
    CATEGORY_LABELS,
    CITATIONS,
    LETTER_CLOSING,
    LETTER_COMPLETE,
    LETTER_EARLIER_PERIOD,
    LETTER_IN_PART,
    LETTER_MISSING,
    LETTER_NOTE,
    LETTER_NOTE_WITH_QUESTIONS,
    LETTER_OPENING,
    LETTER_PHRASES,
    LETTER_QUESTIONS,
    ORIGINS,
)
from disclens.operators.scale import dealt

FALLBACK_FORMATS = ["generic"]


def literal_map(values: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def literal_array(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def all_categories(requests: DataFrame) -> DataFrame:
    """JN-09: every request beside every category, in order."""
    return requests.select(
        "request_id", F.posexplode(literal_array(CATEGORIES)).alias("ordinal", "category")
    )


def absent_completion(found: DataFrame, documents: DataFrame, key: str) -> DataFrame:
    """EXT-24: what was found, completed with an explicit absent row per missing category."""
    wanted = documents.select(
        key, F.posexplode(literal_array(CATEGORIES)).alias("ordinal", "category")
    )
    joined = wanted.join(dealt(found), [key, "category"], "left")
    return joined.select(
        key, "ordinal", "category",
        F.coalesce("status", F.lit("absent")).alias("status"),
        "evidence",
        F.when(F.col("status").isNull(), F.lit(ABSENT_NOTE)).alias("notes"),
    )


def compliance_cells(requests: DataFrame, disclosures: DataFrame) -> DataFrame:
    """AGG-20 in long form: a category without a row was not assessed, which is not absence."""
    known = disclosures.select("request_id", "category", "status", "notes")
    joined = all_categories(requests).join(dealt(known), ["request_id", "category"], "left")
    return joined.withColumn(
        "notes",
        F.when(F.col("status").isNull(), F.lit("This adapter did not assess this category.")).otherwise(
            F.col("notes")
        ),
    )


def compliance_matrix(requests: DataFrame, disclosures: DataFrame) -> DataFrame:
    """AGG-20: requests as rows, the eight categories as columns, with what was left open.

    Pivoted by conditional aggregates over the rows that exist; a request with
    none keeps eight empty cells.
    """
    cells = disclosures.groupBy("request_id").agg(
        *[F.max(F.when(F.col("category") == c, F.col("status"))).alias(c.lower()) for c in CATEGORIES]
    )
    statuses = [F.col(c.lower()) for c in CATEGORIES]
    count = lambda test: sum((F.coalesce(test(s).cast("bigint"), F.lit(0)) for s in statuses), F.lit(0)).cast("bigint")
    return requests.select("request_id").join(cells, "request_id", "left").select(
        "request_id", *statuses,
        count(lambda s: s == "absent").alias("absent_count"),
        count(lambda s: s.isNull()).alias("unassessed_count"),
        count(lambda s: s == "partial").alias("partial_count"),
    )


def answered_summary(matrix: DataFrame) -> DataFrame:
    """AGG-21: answered of the assessed, and the wording for those answered in part."""
    answered = F.col("answered")
    part = F.col("partial_count")
    wording = (
        F.when(part == 0, "")
        .when(part < answered, F.concat(F.lit(", "), part, F.lit(" of them only in part")))
        .when(answered == 1, ", and only in part")
        .when(answered == 2, ", both only in part")
        .otherwise(F.concat(F.lit(", all "), answered, F.lit(" only in part")))
    )
    assessed = F.lit(len(CATEGORIES)) - F.col("unassessed_count")
    return matrix.select(
        "request_id", assessed.cast("bigint").alias("assessed"),
        (assessed - F.col("absent_count")).cast("bigint").alias("answered"), "partial_count",
    ).withColumn("wording", wording)


def shared_note(cells: DataFrame) -> DataFrame:
    """AGG-22: the one note all unanswered categories share, where there are two or more."""
    note = F.when(
        ~F.coalesce(F.col("status").isin("provided", "partial"), F.lit(False)),
        F.nullif(F.col("notes"), F.lit("")),
    )
    return cells.groupBy("request_id").agg(
        F.when((F.count(note) >= 2) & (F.min(note) == F.max(note)), F.min(note)).alias("shared_note")
    )


def follow_up_routing(follow_ups: DataFrame) -> DataFrame:
    """AGG-23: what the letter asks, and what is a note to the reader."""
    in_letter = F.col("question").isNotNull() | (F.col("kind") == "supplemental_period")
    extra = F.col("kind") != "missing_category"
    return follow_ups.withColumns(
        {
            "in_letter": in_letter,
            "listed": extra,
            "asked": extra & in_letter,
            "about_it": extra & ~in_letter,
        }
    )


def profile_split(requests: DataFrame, identities: DataFrame, inferences: DataFrame) -> DataFrame:
    """AGG-17: inferences per origin, all three origins present, beside the request's own counts."""
    by_origin = inferences.groupBy("request_id", "origin").agg(F.count(F.lit(1)).alias("inferences"))
    household = inferences.groupBy("request_id").agg(
        F.count_if(F.col("subject") == "household").alias("household_scoped_count")
    )
    held = identities.groupBy("request_id").agg(F.count(F.lit(1)).alias("identity_count"))
    wanted = requests.select("request_id", F.explode(literal_array(ORIGINS)).alias("origin"))
    zero = F.lit(0).cast("bigint")
    return (
        wanted.join(by_origin, ["request_id", "origin"], "left")
        .join(household, "request_id", "left")
        .join(held, "request_id", "left")
        .withColumns(
            {c: F.coalesce(F.col(c), zero) for c in ("inferences", "household_scoped_count", "identity_count")}
        )
    )


def scope_note(requests: DataFrame, identities: DataFrame) -> DataFrame:
    """AGG-18: how far the identifiers of a request say whom they describe."""
    counts = identities.groupBy("request_id").agg(
        F.count(F.lit(1)).alias("held"),
        F.count_if(F.col("scope") == "household").alias("household"),
        F.count_if(F.coalesce("scope", F.lit("")) == "").alias("unstated"),
    )
    household, unstated = F.col("household"), F.col("unstated")
    note = (
        F.when(F.coalesce("held", F.lit(0)) == 0, "")
        .when(household > 0, F.concat(household, F.lit(" household-scoped")))
        .when(unstated == F.col("held"), "scope not stated")
        .when(unstated > 0, F.concat(unstated, F.lit(" with no scope stated")))
        .otherwise("all individual")
    )
    return requests.select("request_id").join(counts, "request_id", "left").select(
        "request_id", note.alias("scope_note")
    )


def gauge_position(value: Column, scale: Column) -> Column:
    """AGG-19: where a value sits from 0 to 100 on a scale that names its ends with a dash."""
    low = F.regexp_extract(scale, r"(\d+)[–-](\d+)", 1).try_cast("double")
    high = F.regexp_extract(scale, r"(\d+)[–-](\d+)", 2).try_cast("double")
    share = (value - low) / (high - low) * 100
    # Halves go up, as in the interface this reproduces.
    return F.when(
        value.isNotNull() & (high > low), F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.floor(share + 0.5))).cast("bigint")
    )


def compare(
    requests: DataFrame,
    stats: DataFrame,
    identities: DataFrame,
    inferences: DataFrame,
    disclosures: DataFrame,
) -> DataFrame:
    """AGG-24: requests side by side. A zero is shown only where the response claimed it."""
    held = identities.groupBy("request_id").agg(F.count(F.lit(1)).alias("identifiers"))
    inferred = inferences.groupBy("request_id").agg(
        F.count(F.lit(1)).alias("inferred"),
        F.count_if(F.col("origin") == "appended_third_party").alias("appended"),
    )
    answers = (
        disclosures.where(F.col("category").isin(CATEGORIES))
        .groupBy("request_id")
        .agg(
            F.countDistinct("category").alias("assessed"),
            F.countDistinct(F.when(F.col("status") == "absent", F.col("category"))).alias("absent"),
        )
    )
    n = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint")
    claimable = F.col("zero_claimable")
    fallback = F.col("retailer_id").isin(FALLBACK_FORMATS)
    return (
        requests.select("request_id", "retailer_id", "display_name")
        .join(stats, "request_id")
        .join(held, "request_id", "left")
        .join(inferred, "request_id", "left")
        .join(answers, "request_id", "left")
        .select(
            "request_id", "display_name", "disclosed", "lines_disclosed",
            F.col("basket_count").alias("visits"),
            "total_stated", "total_paid", "total_shelf", "total_saved", "distinct_products",
            F.when((n("identifiers") != 0) | claimable, n("identifiers")).alias("identifier_count"),
            F.when(n("inferred") != 0, n("inferred")).alias("inference_count"),
            F.when(
                (n("appended") != 0) | (claimable & (n("inferred") != 0)), n("appended")
            ).alias("appended_inference_count"),
            F.when(~fallback & (n("assessed") >= len(CATEGORIES)), n("absent")).alias("absent_disclosures"),
        )
    )


def comparable(requests: DataFrame) -> DataFrame:
    return requests.agg((F.count(F.lit(1)) > 1).alias("comparable"), F.count(F.lit(1)).alias("requests"))


def letters(requests: DataFrame, disclosures: DataFrame, follow_ups: DataFrame) -> DataFrame:
    """AGG-26: the supplemental request each response calls for, as text.

    The lists that are gathered hold at most one bullet per category and the
    questions of one request.
    """
    phrase = F.element_at(literal_map(LETTER_PHRASES), F.col("category"))
    cite = F.concat(F.lit(" (Civ. Code § "), F.element_at(literal_map(CITATIONS), F.col("category")), F.lit(")"))
    bullet = F.concat(
        F.lit("\n  - "), phrase, cite,
        F.when(F.col("status") == "partial", F.lit(f", {LETTER_IN_PART}")).otherwise(F.lit("")),
    )
    open_points = (
        disclosures.where(F.col("status").isin("absent", "partial"))
        .groupBy("request_id")
        .agg(
            F.array_sort(
                F.collect_list(F.struct((F.col("status") == "partial").alias("part"), "ordinal", bullet.alias("text")))
            ).alias("points")
        )
    )
    asked = follow_ups.groupBy("request_id").agg(
        F.max(F.col("kind") == "supplemental_period").alias("earlier"),
        F.array_sort(
            F.collect_list(F.when(F.coalesce("question", F.lit("")) != "", F.struct("ord", "question")))
        ).alias("questions"),
    )
    points = F.array_join(F.transform("points", lambda p: p["text"]), "")
    numbered = F.array_join(
        F.transform("questions", lambda q, i: F.concat(F.lit("\n  "), i + 1, F.lit(". "), q["question"])), ""
    )
    has_questions = F.coalesce(F.size("questions") > 0, F.lit(False))
    letter = F.concat(
        F.lit("To: "), F.col("display_name"),
        F.lit(" Privacy Office\nSubject: Supplemental request under the CCPA"),
        F.when(
            F.coalesce("report_reference", F.lit("")) != "",
            F.concat(F.lit(" (your reference "), F.col("report_reference"), F.lit(")")),
        ).otherwise(F.lit("")),
        F.lit(LETTER_OPENING),
        F.when(F.col("points").isNotNull(), F.concat(F.lit(LETTER_MISSING), points)).otherwise(
            F.lit(LETTER_COMPLETE)
        ),
        F.when(F.col("earlier"), F.lit(LETTER_EARLIER_PERIOD)).otherwise(F.lit("")),
        F.when(has_questions, F.concat(F.lit(LETTER_QUESTIONS), numbered)).otherwise(F.lit("")),
        F.lit(LETTER_CLOSING),
    )
    return (
        requests.join(dealt(open_points), "request_id", "left")
        .join(dealt(asked), "request_id", "left")
        .select(
            "request_id", letter.alias("letter"),
            F.when(has_questions, F.lit(LETTER_NOTE_WITH_QUESTIONS)).otherwise(F.lit(LETTER_NOTE)).alias("note"),
        )
    )


def missing_category_rows(disclosures: DataFrame, display_name: Column) -> DataFrame:
    """EXT-30: one follow-up per absent category."""
    label = F.element_at(literal_map(CATEGORY_LABELS), F.col("category"))
    return disclosures.where(F.col("status") == "absent").select(
        "request_id",
        F.lit("missing_category").alias("kind"),
        F.concat(
            F.lit("Ask "), display_name, F.lit(" to disclose "), label,
            F.lit(", which the response did not address."),
        ).alias("description"),
        F.lit(None).cast("string").alias("question"),
    )
