"""Which format a bundle of documents is in, and what becomes of each of its files."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from disclens.fixed_values import CAPTURE_NAME, MIN_CONFIDENCE, NOTHING_MATCHED
from disclens.functions.dates import capture_date
from disclens.functions.text import strip


@dataclass(frozen=True)
class HeaderFormat:
    """A report known by headers in its text: evidence adds up over the bundle."""

    format_id: str
    main: str
    others: tuple[str, ...]


@dataclass(frozen=True)
class ShapeFormat:
    """A format known for certain by enough of its titles."""

    format_id: str
    titles: tuple[str, ...]
    needed: int = 2
    score: float = 0.9


FALLBACK_ID, FALLBACK_SCORE = "generic", 0.1
# fixed values: declared, filename, main header, each further header, most for further headers
DECLARED, NAMED, MAIN, OTHER, OTHER_MOST = 0.2, 0.1, 0.5, 0.1, 0.3


def _hits(text: Column, needles: tuple[str, ...]) -> Column:
    total = F.lit(0)
    for needle in needles:
        total = total + F.contains(text, F.lit(needle)).cast("int")
    return total


def format_scores(docs: DataFrame, formats: list[HeaderFormat | ShapeFormat]) -> DataFrame:
    """EXT-31: a score from 0 to 1 per bundle and format.

    ``docs`` holds (bundle, declared, original_filename, text). Scores of the
    documents are summed or maximised by one aggregation over bundles.
    """
    columns = []
    for f in formats:
        if isinstance(f, HeaderFormat):
            named = F.contains(F.lower("original_filename"), F.lit(f.format_id)).cast("int") * NAMED
            main = F.contains(F.col("text"), F.lit(f.main)).cast("int") * MAIN
            others = F.least(F.lit(OTHER_MOST), _hits(F.col("text"), f.others) * OTHER)
            declared = F.max(F.lower(strip(F.coalesce("declared", F.lit("")))) == f.format_id)
            score = F.least(
                F.lit(1.0), F.round(declared.cast("int") * DECLARED + F.sum(F.round(named + main + others, 6)), 6)
            )
        else:
            score = F.max(F.when(_hits(F.col("text"), f.titles) >= f.needed, f.score).otherwise(0.0))
        columns.append((f.format_id, score))
    columns.append(
        (FALLBACK_ID, F.max(F.when(strip("text") != "", FALLBACK_SCORE).otherwise(0.0)))
    )
    scored = docs.groupBy("bundle").agg(*[c.cast("double").alias(f"_{name}") for name, c in columns])
    each = F.array(
        *[F.struct(F.lit(name).alias("format"), F.col(f"_{name}").alias("score")) for name, _ in columns]
    )
    return scored.select("bundle", F.explode(each).alias("s")).select("bundle", "s.format", "s.score")


def format_select(scores: DataFrame) -> DataFrame:
    """EXT-32: the best format of each bundle; a fallback only where no other claims it."""
    finite = F.when(
        F.isnan("score") | F.col("score").isin(float("inf"), float("-inf")), 0.0
    ).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("score"))))
    ranked = scores.withColumn("confidence", F.coalesce(finite, F.lit(0.0))).where(F.col("confidence") > 0)
    best = F.min(F.struct((F.col("format") == FALLBACK_ID).alias("fallback"), (-F.col("confidence")).alias("c"), "format"))
    return ranked.groupBy("bundle").agg(best.alias("best")).select(
        "bundle", F.col("best.format").alias("format"), (-F.col("best.c")).alias("confidence"),
        ((-F.col("best.c")) >= MIN_CONFIDENCE).alias("is_confident"),
    )


def pick_document(docs: DataFrame, headers: list[str]) -> DataFrame:
    """EXT-33: the document with most headers, and the longest one, first of equals in each case."""
    scored = docs.select(
        "bundle", "doc_id", "position", _hits(F.col("text"), tuple(headers)).alias("headers"),
        F.length("text").alias("size"),
    )
    place = lambda score: F.min_by("doc_id", F.struct(-F.col(score), F.col("position"), F.col("doc_id")))
    return scored.groupBy("bundle").agg(
        place("headers").alias("report"), F.max("headers").cast("bigint").alias("headers"), place("size").alias("longest")
    )


def bundle_accounting(docs: DataFrame, reads: DataFrame) -> DataFrame:
    """EXT-43: every uploaded file, and whether it was read, unreadable or not recognised.

    ``reads`` has one row per file that could be opened: (doc_id, recognised).
    """
    joined = docs.join(reads.select("doc_id", "recognised"), "doc_id", "left")
    return joined.withColumn(
        "outcome",
        F.when(F.col("recognised").isNull(), "unreadable").when(F.col("recognised"), "read").otherwise("unrecognised"),
    ).drop("recognised")


def failure_reasons(docs: DataFrame) -> DataFrame:
    """EXT-45: why nothing in a bundle matched. ``reason`` is NULL for a file that opened."""
    reasons = (
        docs.where(F.col("reason").isNotNull())
        .groupBy("bundle", "reason")
        .agg(F.min("position").alias("position"))
        .groupBy("bundle")
        .agg(
            F.array_join(
                F.transform(F.array_sort(F.collect_list(F.struct("position", "reason"))), lambda r: r["reason"]), " "
            ).alias("said"),
            F.count(F.lit(1)).alias("distinct_reasons"),
        )
    )
    readable = docs.groupBy("bundle").agg(F.count_if(F.col("reason").isNull()).alias("readable"))
    message = (
        F.when(F.col("said").isNull(), F.lit(NOTHING_MATCHED))
        .when(F.col("readable") == 0, F.col("said"))
        .otherwise(
            F.concat(
                F.col("distinct_reasons").cast("string"), F.lit(" of the uploaded files could not be read: "),
                "said", F.lit(" The remaining files were readable but matched no adapter."),
            )
        )
    )
    return readable.join(reasons, "bundle", "left").select("bundle", message.alias("message"))


def capture_files(files: DataFrame) -> DataFrame:
    """EXT-34: visit, date and part of a capture, from its file name."""
    stem = F.regexp_replace(F.element_at(F.split("original_filename", "/"), -1), r"\.[^.]*$", "")
    dated = stem.rlike(CAPTURE_NAME)
    part = F.nullif(F.regexp_extract(stem, CAPTURE_NAME, 3), F.lit(""))
    return files.withColumns(
        {
            "visit_key": F.when(dated, F.regexp_extract(stem, CAPTURE_NAME, 1)).otherwise(stem),
            "on_date": F.when(dated, capture_date(F.regexp_extract(stem, CAPTURE_NAME, 2))),
            "part": part.cast("bigint"),
        }
    )
