"""Documents of prose: pages, sections, sentences and the categories they touch.

Every job works inside one document's row: text is cut with array functions,
so nothing is exploded and regrouped to read a document.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from disclens.fixed_values import (
    CATEGORY_HINTS,
    DETAILED_REPORT,
    MIN_PAGE_CHAIN,
    NO_DATA_HINTS,
    QUOTE_LENGTH,
    REPORT_CELL_LINE,
    REPORT_FOOTER,
    REPORT_HEADING,
    REPORT_KEY_LINE,
    REPORT_MODES,
    REPORT_PERIOD,
    REPORT_ROW_LABEL,
    REQUEST_DETAILS,
    REQUEST_LABELS,
    SUPPLEMENTAL_HINT,
    SUPPLEMENTAL_TEXT,
)
from disclens.functions.text import strip
from disclens.sources.staging import stage


def occurrences(text: Column, needle: str) -> Column:
    """0-based offsets of each non-overlapping occurrence of a literal."""
    pieces = F.split(text, rf"\Q{needle}\E", -1)
    found = F.aggregate(
        F.slice(pieces, F.lit(1), F.size(pieces) - 1),
        F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("hits")),
        lambda acc, piece: F.struct(
            (acc["at"] + F.length(piece) + len(needle)).alias("at"),
            F.concat(acc["hits"], F.array(acc["at"] + F.length(piece))).alias("hits"),
        ),
    )
    return found["hits"]


# -- pages --------------------------------------------------------------------


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def page_chain(candidates: pd.Series) -> pd.Series:
    """Line numbers of the longest run of candidates counting up by one, the earliest of equals."""

    def longest(rows) -> list[int]:
        best_for: dict[int, int] = {}  # number -> candidate ending the best run at that number
        length, before = [], []
        for i, row in enumerate(rows):
            link = best_for.get(row["number"] - 1)
            length.append(1 if link is None else length[link] + 1)
            before.append(link)
            held = best_for.get(row["number"])
            if held is None or length[i] > length[held]:
                best_for[row["number"]] = i
        if not length or max(length) < MIN_PAGE_CHAIN:
            return []
        at, chain = length.index(max(length)), []
        while at is not None:
            chain.append(int(rows[at]["line"]))
            at = before[at]
        return sorted(chain)

    return candidates.map(longest)


def strip_page_markers(docs: DataFrame) -> DataFrame:
    """EXT-03: text without its printed page numbers, and the breaks they stood at.

    A bare number counts only as part of the document's longest run; a stray one
    stays in the text. ``first_page`` is the page before the first break.
    """
    lines = F.split("text", "\n", -1)
    bare = F.filter(
        F.transform(lines, lambda line, i: F.struct(i.alias("line"), strip(line).alias("text"))),
        lambda x: x["text"].rlike(r"^\d{1,3}$"),
    )
    candidates = F.transform(
        bare, lambda x: F.struct(x["line"].alias("line"), x["text"].cast("int").alias("number"))
    )
    marked = docs.withColumn("_lines", lines).withColumn("_markers", page_chain(candidates))
    walked = F.aggregate(
        F.col("_lines"),
        F.struct(
            F.lit(0).alias("line"), F.lit(0).alias("offset"),
            F.array().cast("array<struct<offset:int,number:int>>").alias("breaks"),
        ),
        lambda acc, line: F.when(
            F.array_contains("_markers", acc["line"]),
            F.struct(
                (acc["line"] + 1).alias("line"), acc["offset"].alias("offset"),
                F.concat(
                    acc["breaks"],
                    F.array(F.struct(acc["offset"].alias("offset"), strip(line).try_cast("int").alias("number"))),
                ).alias("breaks"),
            ),
        ).otherwise(
            F.struct(
                (acc["line"] + 1).alias("line"),
                (acc["offset"] + F.length(line) + 1).alias("offset"),
                acc["breaks"].alias("breaks"),
            )
        ),
    )
    kept = F.filter(F.col("_lines"), lambda line, i: ~F.array_contains("_markers", i))
    breaks = walked["breaks"]
    return marked.select(
        *[c for c in docs.columns if c != "text"],
        F.array_join(kept, "\n").alias("text"),
        breaks.alias("breaks"),
        F.greatest(F.coalesce(F.try_element_at(breaks, F.lit(1))["number"] - 1, F.lit(1)), F.lit(1)).alias("first_page"),
    )


# -- sections -----------------------------------------------------------------


def sections(docs: DataFrame, headers: list[str]) -> DataFrame:
    """EXT-04: the known headers in the order they occur, each with the span of its body."""

    def tagged(header: str) -> Column:
        found_at = occurrences(F.col("text"), header)
        return F.transform(found_at, lambda at: F.struct(at.alias("at"), F.lit(header).alias("header")))

    hits = F.array_sort(F.flatten(F.array(*[tagged(h) for h in headers])))
    found = docs.withColumn("_hits", hits)
    spans = F.transform(
        "_hits",
        lambda hit, i: F.struct(
            hit["header"].alias("header"),
            (hit["at"] + F.length(hit["header"])).alias("body_start"),
            F.coalesce(F.get(F.col("_hits"), i + 1)["at"], F.length("text")).alias("body_end"),
        ),
    )
    return found.select("doc_id", F.posexplode(spans).alias("seq", "s")).select(
        "doc_id", "seq", "s.header", "s.body_start", "s.body_end"
    )


def last_at_or_before(breaks: Column, offset: Column) -> Column:
    """The place from 1 of the last of ascending ``breaks`` at or before an offset, by bisection; 0 before the first."""
    nothing = F.struct(F.lit(0).alias("low"), F.size(breaks).alias("high"))

    def halved(at: Column, _: Column) -> Column:
        middle = F.floor((at["low"] + at["high"]) / F.lit(2)).cast("int")
        reached = (at["low"] < at["high"]) & (F.get(breaks, middle)["offset"] <= offset)
        return F.struct(
            F.when(reached, middle + 1).otherwise(at["low"]).alias("low"),
            F.when(reached, at["high"]).otherwise(F.least(middle, at["high"])).alias("high"),
        )

    steps = F.ceil(F.log2(F.size(breaks) + F.lit(1))).cast("int")
    return F.aggregate(F.sequence(F.lit(0), steps), nothing, halved)["low"]


def offset_asof(offsets: DataFrame, breaks: DataFrame, value: str, default: Column) -> DataFrame:
    """EXT-05: the last break at or before each offset, or the default before the first one.

    A document's breaks stand beside its offsets as one sorted array, and each
    offset is found in it by itself: nothing is ordered over a document, and the
    offsets of one that holds most of them are spread over tasks. Of breaks at
    the same offset the largest value counts; a missing value is passed over.
    """
    marks = (
        breaks.where(F.col("offset").isNotNull() & F.col(value).isNotNull())
        .groupBy("doc_id", "offset").agg(F.max(value).alias("_value"))
        .groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("offset", "_value"))).alias("_breaks"))
    )
    place = last_at_or_before(F.col("_breaks"), F.col("offset"))
    return offsets.select("doc_id", "offset").join(marks, "doc_id", "left").select(
        "doc_id", "offset", F.coalesce(F.get("_breaks", place - 1)["_value"], default).alias(value)
    )


# -- wording ------------------------------------------------------------------


def _quoted(text: Column, at: Column) -> Column:
    """The whole sentence around a position, white space closed up, cut at the quoting length."""
    head = F.element_at(F.split(F.substr(text, F.lit(1), at - 1), r"[.!?\n]", -1), -1)
    tail = F.regexp_extract(F.substr(text, at), r"^[^.!?\n]*[.!?]?", 0)
    closed = strip(F.regexp_replace(F.concat(head, tail), r"\s+", " "))
    return F.nullif(F.left(closed, F.lit(QUOTE_LENGTH)), F.lit(""))


def category_evidence(text: Column, lexicon: dict[str, list[str]]) -> Column:
    """The categories a text touches, each with the sentence that shows it."""
    lowered = F.lower(text)
    graded = []
    for category, phrases in lexicon.items():
        tries = []
        for phrase in phrases:
            at = F.instr(lowered, F.lit(phrase))
            tries.append(F.when(at > 0, _quoted(text, at)))
        graded.append(F.struct(F.lit(category).alias("category"), F.coalesce(*tries).alias("evidence")))
    return F.filter(F.array(*graded), lambda g: g["evidence"].isNotNull())


def hint_grading(docs: DataFrame, lexicon: dict[str, list[str]] | None = None) -> DataFrame:
    """EXT-22: categories a letter touches, graded `partial`, each with the sentence that shows it.

    Phrases are tried in the order of the list; one whose hit stands in no
    sentence gives way to the next.
    """
    hits = category_evidence(F.col("text"), lexicon or CATEGORY_HINTS)
    return (
        docs.select("doc_id", F.explode(hits).alias("g"))
        .select("doc_id", "g.category", F.lit("partial").alias("status"), "g.evidence")
    )


def no_data_hint(text: Column, hints: list[str] | None = None) -> Column:
    """EXT-23: whether a letter says that nothing is held."""
    lowered = F.lower(text)
    found = F.lit(False)
    for hint in hints or NO_DATA_HINTS:
        found = found | F.contains(lowered, F.lit(hint))
    return found


def sentences(text: Column) -> Column:
    """Prose cut at a full stop before a capital, and at bullets."""
    joined = F.regexp_replace(text, "\n", " ")
    parts = F.split(joined, r"(?<=[.!?])\s+(?=[A-Z])|\s*•\s*", -1)
    return F.filter(F.transform(parts, lambda s: strip(s)), lambda s: s != "")


def quote_sentences(docs: DataFrame, pattern: str, first_only: bool = False) -> DataFrame:
    """EXT-27: the sentences of a document that match, in order."""
    matching = F.filter(
        F.transform(sentences(F.col("text")), lambda s, i: F.struct(i.alias("seq"), s.alias("sentence"))),
        lambda s: s["sentence"].rlike(pattern),
    )
    if first_only:
        matching = F.slice(matching, 1, 1)
    return docs.select("doc_id", F.explode(matching).alias("m")).select("doc_id", "m.seq", "m.sentence")


def coverage_window(docs: DataFrame, dates: DataFrame) -> DataFrame:
    """EXT-25: the period a document states, else the one its data covers."""
    spans = dates.groupBy("doc_id").agg(
        F.min(F.left("occurred_at", F.lit(10))).alias("first_day"),
        F.max(F.left("occurred_at", F.lit(10))).alias("last_day"),
    )
    stated = lambda g: F.nullif(F.regexp_extract("text", REPORT_PERIOD, g), F.lit(""))
    return docs.select("doc_id", stated(1).alias("_from"), stated(2).alias("_to")).join(
        spans, "doc_id", "left"
    ).select(
        "doc_id",
        F.coalesce("_from", "first_day").alias("period_start"),
        F.coalesce("_to", "last_day").alias("period_end"),
    )


def supplemental_rows(docs: DataFrame) -> DataFrame:
    """EXT-30: the earlier window a letter offers, as a follow-up."""
    year = F.regexp_extract("text", SUPPLEMENTAL_HINT, 1)
    before, after = SUPPLEMENTAL_TEXT.split("{year}")
    return docs.where(F.col("text").rlike(SUPPLEMENTAL_HINT)).select(
        "request_id",
        F.lit("supplemental_period").alias("kind"),
        F.concat(F.lit(before), year, F.lit(after)).alias("description"),
        F.lit(None).cast("string").alias("question"),
    )


def coverage_gap(requests: DataFrame, txns: DataFrame, later: DataFrame) -> DataFrame:
    """EXT-26: years from the last purchase to the request, and the latest thing dated after it."""
    last = txns.groupBy("request_id").agg(F.max(F.left("occurred_at", F.lit(10))).alias("last_purchase"))
    latest = later.groupBy("request_id").agg(F.max(F.struct("on_date", "what")).alias("latest"))
    years = F.datediff(F.to_date(F.left("submitted_at", F.lit(10))), F.to_date("last_purchase")) / F.lit(365.25)
    after = F.col("latest.on_date") > F.col("last_purchase")
    return (
        requests.select("request_id", "submitted_at")
        .join(last, "request_id")
        .join(latest, "request_id", "left")
        .select(
            "request_id", "last_purchase",
            F.when(years >= 1, F.floor(years).cast("bigint")).alias("years"),
            F.when(years >= 2, F.concat(F.floor(years).cast("string"), F.lit(" years")))
            .when(years >= 1, "a year").alias("span"),
            F.when(after, F.col("latest.on_date")).alias("later_date"),
            F.when(after, F.col("latest.what")).alias("later_what"),
        )
    )


# -- key/value reports --------------------------------------------------------


def _tokens(line: Column) -> Column:
    return F.filter(F.split(strip(line), r"\s+"), lambda t: t != "")


def _single(token: Column) -> Column:
    """A token printed with every glyph twice, read once; anything else unchanged."""
    return F.when(token.rlike(DOUBLED), F.regexp_replace(token, r"(.)\1", "$1")).otherwise(token)


DOUBLED = r"^(?:(.)\1)+$"


def _of(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once, however often it is read."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _tokens_doubled(tokens: Column) -> Column:
    return F.forall(tokens, lambda t: t.rlike(DOUBLED)) & (F.size(tokens) > 0) & F.exists(tokens, lambda t: t.rlike(r"\p{L}"))


def undouble(line: Column) -> Column:
    """A heading printed with every glyph twice, read once; of anything else the words."""
    return _of(_tokens(line), lambda tokens: F.array_join(F.when(_tokens_doubled(tokens), F.transform(tokens, _single)).otherwise(tokens), " "))


def title_of(line: Column) -> Column:
    """The heading that a line is, or NULL: every token printed twice, or plainly a known heading.

    Only a heading is ever undoubled, so a value is free to look doubled.
    """
    known = lambda plain: plain.isin(*REPORT_MODES, REQUEST_DETAILS) | (plain.rlike(REPORT_HEADING) & ~plain.rlike(REPORT_KEY_LINE))
    return _of(
        _tokens(line),
        lambda tokens: F.when(_tokens_doubled(tokens), F.array_join(F.transform(tokens, _single), " ")).otherwise(
            _of(F.array_join(tokens, " "), lambda plain: F.when(known(plain), plain))
        ),
    )


def request_fields(line: Column, labels: list[str] = REQUEST_LABELS) -> Column:
    """The labels of a line of several, in order, each with the words up to the next: ``array<struct<at, key, value>>``.

    Labels are compared undoubled and whatever the case; every other word
    belongs to the value of the label before it, as it is.
    """

    def label_at(low: Column, i: Column) -> Column:
        found = []
        for label in sorted(labels, key=lambda text: -len(text.split())):
            words = label.lower().split()
            found.append(F.when(F.slice(low, i, F.lit(len(words))) == F.array(*[F.lit(w) for w in words]), F.lit(label)))
        return F.coalesce(*found)

    def starts_in(low: Column) -> Column:
        places = F.sequence(F.lit(1), F.greatest(F.size(low), F.lit(1)))
        return F.filter(F.transform(places, lambda i: F.struct(i.alias("at"), label_at(low, i).alias("key"))), lambda s: s["key"].isNotNull())

    def fields(tokens: Column, starts: Column) -> Column:
        value = lambda s, n: F.slice(
            tokens, s["at"] + F.size(F.split(s["key"], " ")),
            F.coalesce(F.get(starts, n + 1)["at"], F.size(tokens) + 1) - s["at"] - F.size(F.split(s["key"], " ")),
        )
        return F.transform(starts, lambda s, n: F.struct(s["at"].alias("at"), s["key"].alias("key"), F.array_join(value(s, n), " ").alias("value")))

    lowered = lambda tokens: F.transform(tokens, lambda t: F.lower(_single(t)))
    return _of(_tokens(line), lambda tokens: _of(_of(lowered(tokens), starts_in), lambda starts: fields(tokens, starts)))


def report_fields(lines: DataFrame) -> DataFrame:
    """EXT-44: the fields of a line-oriented report, wrapped values joined to the key above them.

    ``lines`` holds (doc_id, line_no, line). Values are kept as they are
    printed, white space inside them included. The request details, several
    labels on a line, come as fields of a section of that name, the last
    occurrence of each label. Lines of the report that are neither fields, wraps
    nor row labels are counted as unread. What each line is by itself is found
    once and written; both parts of the report are read from that.
    """
    text, title = F.col("text"), F.col("title")
    running = lambda *by: Window.partitionBy(*by).orderBy("line_no").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    asked = F.lower("title") == REQUEST_DETAILS.lower()
    control = F.coalesce(title.isin(REPORT_MODES) | asked, F.lit(False))
    heading = F.coalesce(title.rlike(REPORT_HEADING), F.lit(False)) & ~control
    read = (
        lines.withColumn("text", strip("line"))
        .where(text != "")
        .withColumns({"title": title_of(F.col("line")), "footer": text.rlike(REPORT_FOOTER)})
        .withColumn("page", (F.count_if(F.col("footer")).over(running("doc_id")) + 1).cast("bigint"))
        .where(~F.col("footer"))
        .withColumn("mode", F.last(F.when(control, F.when(asked, REQUEST_DETAILS).otherwise(title)), ignorenulls=True).over(running("doc_id")))
        .where(~control & F.col("mode").isin(DETAILED_REPORT, REQUEST_DETAILS))
        .withColumn("heading", heading)
    )
    read = stage(read.select("doc_id", "line_no", "text", F.when(F.col("heading"), title).alias("title"), "heading", "page", "mode"))
    return _section_fields(read.where(F.col("mode") == DETAILED_REPORT), running).unionByName(
        _request_rows(read.where(F.col("mode") == REQUEST_DETAILS))
    )


def _request_rows(lines: DataFrame) -> DataFrame:
    found = lines.select("doc_id", "line_no", "page", F.explode(request_fields(F.col("text"))).alias("f"))
    last = F.max(F.struct("line_no", "f.at", "page", "f.value"))
    nothing = lambda kind: F.lit(None).cast(kind)
    return found.groupBy("doc_id", F.col("f.key").alias("key")).agg(last.alias("last")).select(
        "doc_id", nothing("bigint").alias("section_no"), nothing("bigint").alias("field_no"), "last.page",
        F.lit(REQUEST_DETAILS).alias("section"), nothing("string").alias("scope_kind"), nothing("string").alias("scope_id"),
        "key", "last.value", F.lit(0).cast("bigint").alias("unread"),
    )


def _section_fields(lines: DataFrame, running: Callable) -> DataFrame:
    text, heading, key_line, cell_line = (F.col(c) for c in ("text", "heading", "key_line", "cell_line"))
    in_section = running("doc_id", "section_no")
    placed = (
        lines.withColumns({"key_line": text.rlike(REPORT_KEY_LINE), "cell_line": text.rlike(REPORT_CELL_LINE)})
        .withColumn("section_no", F.count_if(heading).over(running("doc_id")))
        .withColumn("section", F.last(F.when(heading, F.col("title")), ignorenulls=True).over(running("doc_id")))
        .where(~heading)
        .withColumn("records", F.count_if(cell_line).over(in_section))
        .withColumn("fields", F.count_if(key_line).over(in_section))
        .withColumn("field_no", F.count_if(key_line | cell_line).over(in_section))
        .withColumn(
            "role",
            F.when(F.col("section").isNull(), "unread")
            .when(cell_line, "cell")
            .when(key_line, "key")
            .when((F.col("records") > 0) & text.rlike(REPORT_ROW_LABEL), "label")
            .when((F.col("records") == 0) & (F.col("fields") > 0), "wrap")
            .otherwise("unread"),
        )
        .where(F.col("role") != "label")
    )
    opening = F.max(F.when(F.col("role").isin("cell", "key"), text))
    wraps = F.array_sort(F.collect_list(F.when(F.col("role") == "wrap", F.struct("line_no", "text"))))
    grouped = placed.groupBy(
        "doc_id", "section_no", "section", "field_no", (F.col("role") == "unread").alias("is_unread")
    ).agg(
        F.min("page").alias("page"),
        F.max(F.when(F.col("role") == "cell", True)).alias("is_cell"),
        opening.alias("opening"),
        F.array_join(F.transform(wraps, lambda w: w["text"]), " ").alias("wrapped"),
        F.count(F.lit(1)).alias("lines"),
    )
    part = lambda pattern: F.regexp_extract("opening", pattern, 1)
    scope = lambda pattern: F.nullif(F.regexp_replace(F.regexp_extract("section", pattern, 1), " ", ""), F.lit(""))
    value = F.when(F.col("is_cell"), part(r"^[a-z][a-z0-9_]*:(.*)$")).otherwise(part(r"^\S+\s*(.*)$"))
    return grouped.select(
        "doc_id", "section_no", "field_no", "page",
        F.regexp_extract("section", r"^([A-Za-z][A-Za-z ]*?\b[Dd]etails)", 1).alias("section"),
        scope(r"\[\s*([a-z]+)\s*:").alias("scope_kind"),
        scope(r":\s*([^\]]*?)\s*\]").alias("scope_id"),
        F.when(F.col("is_cell"), part(r"^([a-z][a-z0-9_]*):")).when(~F.col("is_unread"), part(r"^(\S+)")).alias("key"),
        F.when(~F.col("is_unread"), strip(F.concat(value, F.lit(" "), "wrapped"))).alias("value"),
        F.when(F.col("is_unread"), F.col("lines")).otherwise(0).cast("bigint").alias("unread"),
    )
