"""What a response discloses and what to ask next, from facts counted per request.

One row of facts per request goes in; every rule is a column over it, so each
finding costs no shuffle of its own. ``reader`` names how the response was read:
as a ``statement`` of visits, a ``workbook`` with a report, numbered
``sections``, or ``plain`` text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from disclens.fixed_values import (
    ABSENT_NOTES,
    ASK_TEXT,
    CATEGORIES,
    CATEGORIES_NOTE,
    CATEGORIES_NOTE_INFERRED,
    CATEGORIES_SENTENCE,
    CATEGORY_HINTS,
    CATEGORY_LABELS,
    DIGITAL_TRACES,
    GAP_TEXT,
    HISTORY_LACKS,
    HISTORY_LACKS_TEXT,
    LATER_PURCHASES_QUESTION,
    LATER_PURCHASES_TEXT,
    LATER_TEXT,
    NO_WORDING_TEXT,
    NOTHING_HELD_TEXT,
    OTHER_HOLDER_INFERRED,
    OTHER_HOLDER_QUESTION,
    OTHER_HOLDER_TEXT,
    PLAIN_READING_TEXT,
    RETENTION_RULE_TEXT,
    SECTIONS_NOTE,
    STATEMENT_SHAPE_TEXT,
    SUPPLEMENTAL_HINT,
    SUPPLEMENTAL_TEXT,
    VISITS_ALONE_NOTE,
    VISITS_ITEMISED_NOTE,
    WITHHELD_QUESTION,
    WITHHELD_SENTENCE,
    WITHHELD_TEXT,
    WORDING_NOTE,
)
from disclens.functions.cells import normalise, present
from disclens.operators.disclosure import literal_map
from disclens.operators.extract_cells import visit_evidence_text
from disclens.operators.extract_text import category_evidence, coverage_gap, no_data_hint, sentences


def filled(text: str, **values: Column) -> Column:
    """A wording with its gaps filled; NULL where a value is."""
    parts: list[Column] = []
    while "{" in text:
        before, _, rest = text.partition("{")
        name, _, text = rest.partition("}")
        parts += [F.lit(before), values[name].cast("string")]
    return F.concat(*parts, F.lit(text))


def _listing(items: Column, last: str) -> Column:
    """``a, b or c`` of at least two."""
    n = F.size(items)
    return F.concat(F.array_join(F.slice(items, F.lit(1), n - 1), ", "), F.lit(last), F.element_at(items, -1))


def _kept(*items: tuple[str, Column | bool]) -> Column:
    flagged = [F.when(F.lit(wanted) if isinstance(wanted, bool) else wanted, F.lit(text)) for text, wanted in items]
    return F.array_compact(F.array(*flagged))


# -- facts --------------------------------------------------------------------


def prose_facts(documents: DataFrame) -> DataFrame:
    """What the prose of one document per request says, read within its row: ``documents(request_id, text)``."""
    said = documents.withColumn("_said", sentences(F.col("text")))
    matching = lambda pattern: F.filter("_said", lambda s: s.rlike(pattern))
    graded = category_evidence(F.col("text"), CATEGORY_HINTS)
    return said.select(
        "request_id",
        F.get(matching(CATEGORIES_SENTENCE), F.lit(0)).alias("categories_sentence"),
        matching(WITHHELD_SENTENCE).alias("withheld"),
        no_data_hint(F.col("text")).alias("nothing_held"),
        F.nullif(F.regexp_extract("text", SUPPLEMENTAL_HINT, 1), F.lit("")).alias("earlier_than"),
        graded.alias("touched"),
    )


def history_facts(txns: DataFrame, items: DataFrame, is_capture: Column) -> DataFrame:
    """What the visits of each request hold, counted; lines are counted per visit first."""
    lines = items.groupBy("txn_id").agg(F.count(F.lit(1)).alias("lines"))
    return (
        txns.withColumn("_capture", is_capture)
        .join(lines, "txn_id", "left")
        .groupBy("request_id")
        .agg(
            F.count(F.lit(1)).alias("visits"),
            F.count("store_code").alias("stores"),
            F.count("lines").alias("itemised"),
            F.coalesce(F.sum("lines"), F.lit(0)).alias("items"),
            F.count_if(F.col("_capture")).alias("captures"),
            F.min(F.left("occurred_at", F.lit(10))).alias("first_day"),
            F.max(F.left("occurred_at", F.lit(10))).alias("last_day"),
            F.max(F.contains("occurred_at", F.lit("T"))).alias("timed"),
        )
    )


def gap_text(gaps: DataFrame) -> DataFrame:
    """EXT-26 as sentences: ``(request_id, gap)``, NULL where there is nothing to say."""
    far = filled(GAP_TEXT, end=F.col("last_purchase"), span=F.col("span"))
    later = filled(LATER_TEXT, what=F.col("later_what"), day=F.col("later_date"))
    return gaps.select("request_id", F.nullif(F.concat_ws(" ", far, later), F.lit("")).alias("gap"))


COUNTS = ("visits", "stores", "itemised", "items", "captures", "appended", "blobs")


def response_facts(
    requests: DataFrame,
    txns: DataFrame,
    items: DataFrame,
    prose: DataFrame,
    identities: DataFrame,
    inferences: DataFrame,
    later: DataFrame,
    is_capture: Column,
) -> DataFrame:
    """One row of facts per request; every table is counted by request before it is joined.

    ``requests`` carries ``request_id, reader, display_name, submitted_at, profile,
    asked_name, holder_name, tables, heading, blobs``.
    """
    appended = inferences.groupBy("request_id").agg(F.count_if(F.col("origin") == "appended_third_party").alias("appended"))
    mail = identities.groupBy("request_id").agg(F.max(F.col("id_type") == "email").alias("has_email"))
    facts = requests.join(history_facts(txns, items, is_capture), "request_id", "left")
    for more in (prose_facts(prose), appended, mail, gap_text(coverage_gap(requests, txns, later))):
        facts = facts.join(more, "request_id", "left")
    return facts.withColumns(
        {c: F.coalesce(c, F.lit(0)) for c in COUNTS} | {c: F.coalesce(c, F.lit(False)) for c in ("timed", "has_email", "nothing_held", "profile")}
    )


# -- evidence -----------------------------------------------------------------


def _found(category: str, when: Column, status: str, evidence: Column, notes: Column) -> Column:
    return F.when(
        when,
        F.struct(
            F.lit(category).alias("category"), F.lit(status).alias("status"),
            evidence.alias("evidence"), notes.cast("string").alias("notes"),
        ),
    )


def _statement_rules() -> list[Column]:
    itemised = F.col("itemised") > 0
    notes = F.when(itemised, filled(VISITS_ITEMISED_NOTE, n=F.col("visits") - F.col("itemised"))).otherwise(F.lit(VISITS_ALONE_NOTE))
    return [_found("SPECIFIC_PIECES", F.col("reader") == "statement", "partial", visit_evidence_text(), notes)]


def _section_rules() -> list[Column]:
    here = (F.col("reader") == "sections") & F.col("heading").isNotNull()
    return [_found("SPECIFIC_PIECES", here, "provided", F.col("heading"), filled(SECTIONS_NOTE, n=F.col("blobs")))]


def _workbook_rules() -> list[Column]:
    workbook, bought = F.col("reader") == "workbook", F.col("visits") > 0
    report = F.col("withheld").isNotNull()
    purchases = F.concat_ws(
        "", F.col("visits"), F.lit(" purchases with "), F.col("items"), F.lit(" line items, "), "first_day", F.lit(" to "), "last_day"
    )
    parts = F.array_compact(
        F.array(
            F.when(bought, purchases),
            F.when(report & F.col("profile"), F.lit("a loyalty profile")),
            F.when(F.col("appended") > 0, F.concat(F.col("appended").cast("string"), F.lit(" inferred attributes"))),
        )
    )
    lacks = _kept(*[(text, ~F.col("timed") if text == "no time of day" else True) for text in HISTORY_LACKS])
    traces = _kept(*[(text, ~F.col("has_email") if text == "an email address" else True) for text in DIGITAL_TRACES])
    gaps = F.concat_ws(
        " ",
        F.when(bought, filled(HISTORY_LACKS_TEXT, list=F.array_join(lacks, ", "))),
        F.when(bought & report, F.concat(F.lit("Nothing from "), _listing(traces, " or "), F.lit("."))),
        F.when(bought & report, F.col("gap")),
    )
    evidence = F.when(F.size(parts) > 0, F.concat(F.array_join(parts, "; "), F.lit(".")))
    tables = F.coalesce(F.nullif(F.array_join("tables", ", "), F.lit("")), F.lit("none"))
    named = F.concat(
        filled(CATEGORIES_NOTE, tables=tables),
        F.when(F.col("appended") > 0, filled(CATEGORIES_NOTE_INFERRED, n=F.col("appended"))).otherwise(F.lit(".")),
    )
    said = workbook & F.col("categories_sentence").isNotNull()
    return [
        _found("CATEGORIES_COLLECTED", said, "partial", F.col("categories_sentence"), named),
        _found("SPECIFIC_PIECES", workbook, "partial", evidence, F.nullif(gaps, F.lit(""))),
    ]


def disclosure_evidence(facts: DataFrame) -> DataFrame:
    """EXT-29: what each response discloses, with counted evidence and what it lacks; the other categories are absent.

    A response of sheets alone, with no prose, leaves all but the specific
    pieces ungraded. Returns ``(request_id, category, ordinal, status,
    evidence, notes)``.
    """
    rules = F.array_compact(F.array(*_statement_rules(), *_section_rules(), *_workbook_rules()))
    plain = F.transform(
        F.when(F.col("reader") == "plain", F.col("touched")),
        lambda g: F.struct(
            g["category"].alias("category"), F.lit("partial").alias("status"), g["evidence"].alias("evidence"), F.lit(WORDING_NOTE).alias("notes")
        ),
    )
    found = facts.withColumn("_found", F.concat(rules, F.coalesce(plain, F.array().cast(_FOUND_TYPE))))
    own = lambda c: F.get(F.filter("_found", lambda f: f["category"] == c), F.lit(0))
    nothing = lambda c: F.struct(
        c.alias("category"), F.lit("absent").alias("status"), F.lit(None).cast("string").alias("evidence"),
        F.element_at(literal_map(ABSENT_NOTES), F.col("reader")).alias("notes"),
    )
    ungraded = (F.col("reader") == "workbook") & F.col("withheld").isNull()
    rows = F.transform(
        F.array(*[F.lit(c) for c in CATEGORIES]),
        lambda c, i: F.struct(i.alias("ordinal"), F.coalesce(own(c), F.when(~ungraded, nothing(c))).alias("f")),
    )
    return (
        found.select("request_id", F.explode(F.filter(rows, lambda r: r["f"].isNotNull())).alias("r"))
        .select("request_id", "r.f.category", "r.ordinal", "r.f.status", "r.f.evidence", "r.f.notes")
    )


_FOUND_TYPE = "array<struct<category:string,status:string,evidence:string,notes:string>>"


# -- follow-ups ---------------------------------------------------------------


def _action(when: Column, kind: str, description: Column, question: Column | None = None) -> Column:
    question = F.lit(None) if question is None else question
    return F.when(
        when,
        F.struct(F.lit(kind).alias("kind"), description.alias("description"), question.cast("string").alias("question")),
    )


def clarification_rules() -> list[Column]:
    """What to ask besides missing categories, in the order it is asked."""
    read = lambda name: F.col("reader") == name
    asked, holder = present(F.col("asked_name")), present(F.col("holder_name"))
    other = read("workbook") & F.col("profile") & (normalise(asked) != normalise(holder)) & asked.isNotNull() & holder.isNotNull()
    inferred = F.when(F.col("appended") > 0, filled(OTHER_HOLDER_INFERRED, n=F.col("appended"))).otherwise(F.lit(""))
    gap = read("workbook") & F.col("withheld").isNotNull() & (F.col("visits") > 0) & F.col("gap").isNotNull()
    withheld = read("workbook") & (F.size("withheld") > 0)
    return [
        _action(read("plain"), "clarification", F.lit(PLAIN_READING_TEXT)),
        _action(read("plain") & F.col("nothing_held"), "clarification", F.lit(NOTHING_HELD_TEXT)),
        _action(other, "clarification", filled(OTHER_HOLDER_TEXT, inferred=inferred), F.lit(OTHER_HOLDER_QUESTION)),
        _action(gap, "clarification", filled(LATER_PURCHASES_TEXT, gap=F.col("gap")), filled(LATER_PURCHASES_QUESTION, end=F.col("last_day"))),
        _action(withheld, "clarification", filled(WITHHELD_TEXT, quoted=F.array_join("withheld", " ")), F.lit(WITHHELD_QUESTION)),
        _action(
            read("sections") & F.col("earlier_than").isNotNull(), "supplemental_period", filled(SUPPLEMENTAL_TEXT, year=F.col("earlier_than"))
        ),
        _action(read("statement"), "clarification", F.lit(STATEMENT_SHAPE_TEXT)),
        _action(read("statement"), "missing_category", F.lit(RETENTION_RULE_TEXT)),
    ]


def follow_ups(facts: DataFrame, disclosures: DataFrame) -> DataFrame:
    """EXT-30: everything worth asking about each response, in order: ``(request_id, ord, kind, description, question)``.

    ``disclosures`` are those of :func:`disclosure_evidence`; at most eight of
    a request meet its facts.
    """
    absent = (
        disclosures.where("status = 'absent'").groupBy("request_id")
        .agg(F.array_sort(F.collect_list(F.struct("ordinal", "category"))).alias("_absent"))
    )
    label = lambda a: F.element_at(literal_map(CATEGORY_LABELS), a["category"])
    wording = lambda a: F.when(F.col("reader") == "plain", filled(NO_WORDING_TEXT, category=label(a))).otherwise(
        filled(ASK_TEXT, retailer=F.col("display_name"), category=label(a))
    )
    missing = F.transform(
        F.when(F.col("reader") != "statement", F.col("_absent")),
        lambda a: F.struct(F.lit("missing_category").alias("kind"), wording(a).alias("description"), F.lit(None).cast("string").alias("question")),
    )
    rules = F.array_compact(F.array(*clarification_rules()))
    actions = F.concat(rules, F.coalesce(missing, F.array().cast("array<struct<kind:string,description:string,question:string>>")))
    return (
        facts.join(absent, "request_id", "left")
        .select("request_id", F.posexplode(actions).alias("ord", "a"))
        .select("request_id", "ord", "a.kind", "a.description", "a.question")
    )
