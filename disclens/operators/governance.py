"""Personal data in documents: finding it, masking it, and the denylist of known values."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from disclens.fixed_values import (
    ALLOWED_EMAIL_DOMAINS,
    ALLOWED_EMAIL_SUFFIXES,
    ALLOWED_EMAILS,
    BARE_NUMBER_LINE,
    DENY_STOPLIST,
    FILENAME_TOKEN,
    HARVEST_RULES,
    HEX_RUN,
    IDENTIFIER_KEY,
    IDENTIFYING_KEY,
    LABEL_KEYS,
    MIN_DENY_DIGITS,
    MIN_DENY_LENGTH,
    PII_RULES,
    RECONCILE_VERDICTS,
    SKIP_KEY,
)
from disclens.functions.text import strip
from disclens.operators.extract_json import json_spans, json_walk
from disclens.operators.literals import literal_hits

TOLERANCE = 0.01
FEE_WORDS = "(?i)BAG|TAX|FEE|DEPOSIT|BOTTLE|CRV|SURCHARGE|RECYCL"
SUPPRESSION = r"pii-scan:\s*allow\b(.*)"


def text_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, line_no from one, line, line above)."""
    cut = docs.select("doc_id", F.split("text", "\n", -1).alias("_lines"))
    lines = F.transform(
        "_lines",
        lambda line, i: F.struct(
            (i + 1).alias("line_no"), line.alias("line"), F.coalesce(F.get("_lines", i - 1), F.lit("")).alias("above")
        ),
    )
    return cut.select("doc_id", F.explode(lines).alias("l")).select("doc_id", "l.line_no", "l.line", "l.above")


def plain_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, line_no from one, line)."""
    cut = docs.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("n", "line"))
    return cut.select("doc_id", (F.col("n") + 1).alias("line_no"), "line")


# -- accept tests -------------------------------------------------------------


def email_is_real(match: Column) -> Column:
    """GOV-02: not one of the reserved domains or listed addresses."""
    address = F.lower(match)
    domain = F.element_at(F.split(address, "@"), -1)
    reserved = domain.isin(ALLOWED_EMAIL_DOMAINS)
    for suffix in ALLOWED_EMAIL_SUFFIXES:
        reserved = reserved | F.endswith(domain, F.lit(suffix))
    return ~(address.isin(ALLOWED_EMAILS) | reserved)


def phone_is_real(match: Column) -> Column:
    """GOV-03: the 555 exchange is fiction."""
    return F.regexp_extract(match, r"(\d{3})[-. ]\d{4}$", 1) != "555"


def luhn_ok(digits: Column) -> Column:
    """GOV-04: every second digit from the right doubled, all summed, divisible by ten."""
    figures = F.transform(F.filter(F.split(F.reverse(digits), ""), lambda c: c != ""), lambda c: c.cast("int"))
    doubled = lambda d: F.when(d > 4, d * 2 - 9).otherwise(d * 2)
    total = F.aggregate(
        F.transform(figures, lambda d, i: F.when(i % 2 == 1, doubled(d)).otherwise(d)),
        F.lit(0), lambda acc, d: acc + d,
    )
    return total % 10 == 0


def card_is_real(match: Column) -> Column:
    digits = F.regexp_replace(match, r"[^0-9]", "")
    return F.length(digits).between(13, 19) & luhn_ok(digits)


OPEN, CLOSE = "\x01", "\x02"


def placed_matches(line: Column, pattern: str) -> Column:
    """The matches of a pattern without groups, in order, each with where it starts and ends: ``array<struct<start, end, text>>``.

    Matches are fenced in where they stand, and the fenced line is cut: its
    pieces are by turns outside and inside, and their lengths give the places.
    """
    free = F.translate(line, OPEN + CLOSE, "  ")
    pieces = F.split(F.regexp_replace(free, f"({pattern})", f"{OPEN}$1{CLOSE}"), f"[{OPEN}{CLOSE}]", -1)
    nothing = F.struct(
        F.lit(0).alias("at"), F.lit(False).alias("inside"),
        F.array().cast("array<struct<start:int,end:int,text:string>>").alias("found"),
    )

    def walk(so_far: Column, piece: Column) -> Column:
        after = so_far["at"] + F.length(piece)
        match = F.struct(so_far["at"].alias("start"), after.alias("end"), piece.alias("text"))
        return F.struct(
            after.alias("at"), (~so_far["inside"]).alias("inside"),
            F.when(so_far["inside"], F.concat(so_far["found"], F.array(match))).otherwise(so_far["found"]).alias("found"),
        )

    return F.aggregate(pieces, nothing, walk)["found"]


def outside_hashes(line: Column, pattern: str) -> Column:
    """The matches that do not lie inside a long hex run: a digest holds digit runs that are no numbers.

    What counts is the place of a match, so the same digits elsewhere on the
    line are judged by themselves. Lines without such a run, nearly all, are
    only searched.
    """
    runs = placed_matches(line, HEX_RUN)
    free = F.filter(placed_matches(line, pattern), lambda m: ~F.exists(runs, lambda r: (r["start"] <= m["start"]) & (m["end"] <= r["end"])))
    return F.when(line.rlike(HEX_RUN), F.transform(free, lambda m: m["text"])).otherwise(F.regexp_extract_all(line, F.lit(pattern), F.lit(0)))


def suppressed(line: Column, above: Column) -> Column:
    """GOV-05: a marker with a reason, on the line or the one above it."""
    reason = lambda x: strip(F.regexp_extract(x, SUPPRESSION, 1)) != ""
    return reason(line) | reason(above)


def mask(text: Column) -> Column:
    """GOV-06: enough to find the match, not enough to leak it."""
    t = strip(text)
    n = F.length(t)
    hidden = F.concat(F.left(t, F.lit(2)), F.repeat(F.lit("*"), n - 4), F.right(t, F.lit(2)))
    return F.when(n <= 4, F.repeat(F.lit("*"), n)).otherwise(hidden)


ACCEPT = {"EMAIL": email_is_real, "PHONE": phone_is_real, "PAYMENT_CARD": card_is_real}
HASH_GUARDED = ("PAYMENT_CARD", "LOYALTY_NUMBER")


def _tagged(matches: Column, label: str, name: str, value: str) -> Column:
    return F.transform(matches, lambda m: F.struct(F.lit(name).alias(label), m.alias(value)))


def pii_scan(docs: DataFrame, rules: list[str] | None = None) -> DataFrame:
    """GOV-01: every accepted match of every rule on every line, suppressed lines left out.

    All rules run over a line in one pass of array expressions: one row per match
    leaves the stage, and nothing is shuffled.
    """
    lines = text_lines(docs).where(~suppressed(F.col("line"), F.col("above")))
    found = []
    for name, pattern in PII_RULES:
        if rules and name not in rules:
            continue
        if name in HASH_GUARDED:
            matches = outside_hashes(F.col("line"), pattern)
        else:
            matches = F.regexp_extract_all("line", F.lit(pattern), F.lit(0))
        if name in ACCEPT:
            matches = F.filter(matches, ACCEPT[name])
        found.append(_tagged(matches, "rule", name, "matched"))
    return lines.select("doc_id", "line_no", F.explode(F.flatten(F.array(*found))).alias("f")).select(
        "doc_id", "line_no", "f.rule", "f.matched"
    )


# -- denylist -----------------------------------------------------------------


def denylist_hits(docs: DataFrame, needles: DataFrame) -> DataFrame:
    """GOV-07: which listed strings stand literally in which lines, whatever the case.

    No line is compared with every needle, and lines that hold no needle's
    rarest piece never leave their task; see :func:`literals.literal_hits`.
    """
    low = plain_lines(docs).select("doc_id", "line_no", F.lower("line").alias("low"))
    listed = needles.select(F.lower(strip("needle")).alias("needle"))
    return literal_hits(low, listed, texts=docs.select(F.lower("text").alias("low")))


def worth_keeping(value: Column) -> Column:
    """Whether a harvested value says enough to be listed."""
    text = strip(value)
    bare = F.regexp_replace(text, "[- ]", "")
    short_number = bare.rlike(r"^\d+$") & (F.length(F.regexp_replace(text, r"[^0-9]", "")) < MIN_DENY_DIGITS)
    core = F.regexp_replace(text, r"^[0 -]+|[0 -]+$", "")
    varied = F.size(F.array_distinct(F.filter(F.split(core, ""), lambda c: c != ""))) > 1
    return (F.length(text) >= MIN_DENY_LENGTH) & ~F.lower(text).isin(DENY_STOPLIST) & ~short_number & varied


def harvest_text(docs: DataFrame) -> DataFrame:
    """GOV-09: candidate values by pattern."""
    found = F.flatten(
        F.array(
            *[
                _tagged(F.regexp_extract_all("text", F.lit(pattern), F.lit(0)), "bucket", bucket, "value")
                for bucket, pattern in HARVEST_RULES
            ]
        )
    )
    return docs.select(F.explode(found).alias("f")).select("f.bucket", strip("f.value").alias("value")).where(
        worth_keeping(F.col("value"))
    )


def harvest_json(pairs: DataFrame) -> DataFrame:
    """GOV-09: values of identifying fields."""
    key = F.col("key")
    named = key.rlike(IDENTIFYING_KEY) & ~key.rlike(SKIP_KEY) & ~F.lower(strip("key")).isin(LABEL_KEYS)
    return pairs.where(named & worth_keeping(F.col("value"))).select(
        F.lit("identifying JSON fields").alias("bucket"), strip("value").alias("value")
    )


def harvest_visits(txns: DataFrame) -> DataFrame:
    """GOV-09: when someone shopped, in each form a file might quote it."""
    day = F.nullif(F.regexp_extract("occurred_at", r"^(\d{4}-\d{2}-\d{2})", 1), F.lit(""))
    time = F.nullif(F.regexp_extract("occurred_at", r"^\d{4}-\d{2}-\d{2}[T ](\d{2}:\d{2})", 1), F.lit(""))
    forms = F.array(day, F.concat(day, F.lit(" "), time), F.concat(day, F.lit("T"), time))
    return txns.select(
        F.lit("dates and times of a visit").alias("bucket"),
        F.explode(F.filter(forms, lambda v: v.isNotNull())).alias("value"),
    )


def without_page_numbers(text: Column) -> Column:
    """The text without the bare numbers that a printed page leaves on lines of their own, which cut through what surrounds them."""
    return F.regexp_replace(text, BARE_NUMBER_LINE, "")


def embedded_pairs(docs: DataFrame) -> DataFrame:
    """Every (key, value) of the JSON that stands inside the text of documents, read as it is and without page numbers."""
    read = docs.select("doc_id", F.explode(F.array_distinct(F.array("text", without_page_numbers(F.col("text"))))).alias("text"))
    spans = json_spans(read).where(F.col("json").isNotNull()).select("doc_id", "json")
    return json_walk(spans.distinct())


def harvest_identities(identities: DataFrame) -> DataFrame:
    """GOV-09: the identifiers that were found, whole and in their comma-separated pieces."""
    pieces = F.concat(F.array("value"), F.split("value", r",\s*", -1))
    return (
        identities.select(F.explode(F.array_distinct(pieces)).alias("value"))
        .where(worth_keeping(F.col("value")))
        .select(F.lit("identifiers the adapter found").alias("bucket"), strip("value").alias("value"))
    )


def harvest_references(requests: DataFrame, filenames: DataFrame) -> DataFrame:
    """GOV-09: a report's own reference, and what looks like one in the name of its file."""
    stem = F.regexp_replace(F.element_at(F.split("original_filename", "/"), -1), r"(?<=.)\.[^.]*$", "")
    tokens = filenames.select(F.explode(F.regexp_extract_all(stem, F.lit(FILENAME_TOKEN), F.lit(0))).alias("value"))
    stated = requests.select(F.col("report_reference").alias("value"))
    return (
        stated.unionByName(tokens).where(F.coalesce(worth_keeping(F.col("value")), F.lit(False)))
        .select(F.lit("report references").alias("bucket"), strip("value").alias("value"))
    )


def denylist_build(
    docs: DataFrame,
    pairs: DataFrame,
    txns: DataFrame,
    identities: DataFrame | None = None,
    requests: DataFrame | None = None,
    filenames: DataFrame | None = None,
) -> DataFrame:
    """GOV-09: every value worth listing, once per bucket.

    ``pairs`` are fields of structured responses; the JSON inside the text is
    read as well. Identifiers and references are listed where they are given.
    """
    found = [harvest_text(docs), harvest_json(pairs), harvest_json(embedded_pairs(docs)), harvest_visits(txns)]
    if identities is not None:
        found.append(harvest_identities(identities))
    if requests is not None and filenames is not None:
        found.append(harvest_references(requests, filenames))
    return reduce(DataFrame.unionByName, found).distinct()


def denylist_split(values: DataFrame, corpus: DataFrame) -> DataFrame:
    """GOV-10: whether each value already stands in a corpus; visit dates are kept all the same."""
    seen = denylist_hits(corpus, values.select(F.col("value").alias("needle"))).select("needle").distinct()
    return (
        values.withColumn("needle", F.lower(strip("value")))
        .join(seen.withColumn("known", F.lit(True)), "needle", "left")
        .withColumn("known", F.coalesce("known", F.lit(False)))
        .withColumn("kept", ~F.col("known") | (F.col("bucket") == "dates and times of a visit"))
        .drop("needle")
    )


def denylist_merge(existing: DataFrame, values: DataFrame) -> DataFrame:
    """SET-04: the old list and the new values, once each, longest first."""
    return (
        existing.select("value").unionByName(values.select("value")).distinct()
        .orderBy(F.length("value").desc(), "value")
    )


# -- skeletons ----------------------------------------------------------------


def skeleton_text(text: Column) -> Column:
    """GOV-11: runs of letters and digits as their kind and length, everything else kept."""
    tokens = F.regexp_extract_all(text, F.lit(r"[A-Za-z]+|\d+|[^A-Za-z\d]"), F.lit(0))
    shape = lambda t: (
        F.when(t.rlike("^[A-Za-z]"), F.concat(F.lit("a"), F.length(t).cast("string")))
        .when(t.rlike(r"^\d"), F.concat(F.lit("9"), F.length(t).cast("string")))
        .otherwise(t)
    )
    return F.array_join(F.transform(tokens, shape), "")


def number_shape(value: Column) -> Column:
    exponent = F.floor(F.log10(F.abs(value))).cast("string")
    sign = F.when(value < 0, "-").otherwise("")
    return F.when(value == 0, "<num:0>").otherwise(F.concat(F.lit("<num:"), sign, F.lit("1e"), exponent, F.lit(">")))


def string_shape(text: Column) -> Column:
    t = strip(text)
    iso, us = r"^(\d{4})-(\d{2})-\d{2}$", r"^(\d{1,2})/\d{1,2}/(\d{4})$"
    month = (
        F.when(t.rlike(iso), F.left(t, F.lit(7)))
        .when(t.rlike(us), F.concat(F.regexp_extract(t, us, 2), F.lit("-"), F.lpad(F.regexp_extract(t, us, 1), 2, "0")))
    )
    return F.coalesce(
        F.concat(F.lit("<date:"), month, F.lit(">")), F.concat(F.lit("<str:len="), F.length(text).cast("string"), F.lit(">"))
    )


def skeleton_key(key: Column) -> Column:
    """A field name as it is; a key that is itself somebody's data only by its length."""
    return F.when(key.rlike(IDENTIFIER_KEY), F.concat(F.lit("<key:len="), F.length(key).cast("string"), F.lit(">"))).otherwise(key)


def skeleton_value(key: Column, value: Column, is_number: Column) -> tuple[Column, Column]:
    """GOV-12: a pair reduced to its field and the shape of its value."""
    shape = F.when(is_number, number_shape(value.try_cast("double"))).otherwise(string_shape(value))
    return skeleton_key(key), shape


# -- reconciliation -----------------------------------------------------------


def source_summary(source_baskets: DataFrame, source_lines: DataFrame) -> DataFrame:
    """GOV-14, source side: one row per date that has exactly one basket in the source."""
    flagged = F.col("description_raw").rlike(FEE_WORDS)
    lines = source_lines.groupBy("source_id").agg(
        F.count(F.lit(1)).alias("source_lines"),
        F.sum("retail_amt").alias("source_shelf_sum"),
        F.count_if(flagged).alias("fee_like_lines"),
        F.sum(F.when(flagged, F.coalesce("retail_amt", F.lit(0).cast("decimal(18,2)")))).alias("fee_like_sum"),
    )
    alone = (
        source_baskets.groupBy("request_id", "on_date")
        .agg(F.count(F.lit(1)).alias("candidates"), F.min("source_id").alias("source_id"),
             F.min("stated").alias("stated"))
        .where(F.col("candidates") == 1)
    )
    zero = F.lit(0).cast("decimal(18,2)")
    return alone.join(lines, "source_id", "left").withColumns(
        {
            "source_lines": F.coalesce("source_lines", F.lit(0).cast("bigint")),
            "source_shelf_sum": F.coalesce("source_shelf_sum", zero),
            "fee_like_lines": F.coalesce("fee_like_lines", F.lit(0).cast("bigint")),
            "fee_like_sum": F.coalesce("fee_like_sum", zero),
        }
    )


def reconcile(stored: DataFrame, source: DataFrame) -> DataFrame:
    """GOV-14/15: stored baskets against the source's, with the verdict in fixed precedence."""
    paired = stored.withColumn("on_date", F.left("occurred_at", F.lit(10))).join(source, ["request_id", "on_date"])
    close = F.lit(TOLERANCE).cast("decimal(4,2)")
    delta = F.col("source_shelf_sum") - F.col("stated")
    columns = {
        "lines_match": F.col("source_lines") == F.col("item_count"),
        "shelf_matches": F.coalesce(F.abs(F.col("source_shelf_sum") - F.col("shelf_total")) < close, F.lit(False)),
        "delta": delta,
        "delta_is_the_fee": F.coalesce(
            (F.abs(delta) >= close) & (F.col("fee_like_lines") > 0)
            & (F.abs(delta - F.col("fee_like_sum")) < close),
            F.lit(False),
        ),
    }
    v = RECONCILE_VERDICTS
    verdict = (
        F.when(~F.col("lines_match"), v["lines"])
        .when(~F.col("shelf_matches"), v["amounts"])
        .when(F.col("delta").isNull(), v["unstated"])
        .when(F.abs("delta") < close, v["exact"])
        .when(F.col("delta_is_the_fee"), v["fee"])
        .when(F.col("delta") > 0, v["short"])
        .otherwise(v["over"])
    )
    return paired.withColumns(columns).withColumn("verdict", verdict)
