import pytest
from pyspark.sql import functions as F

from disclens.fixed_values import CATEGORIES
from disclens.operators import findings

SCHEMA = """request_id long, reader string, display_name string, visits long, stores long, itemised long, items long, captures long,
    first_day string, last_day string, timed boolean, appended long, has_email boolean, profile boolean, blobs long, heading string,
    tables array<string>, withheld array<string>, categories_sentence string, nothing_held boolean, earlier_than string,
    asked_name string, holder_name string, gap string, touched array<struct<category:string,evidence:string>>"""
BLANK = {
    "visits": 0, "stores": 0, "itemised": 0, "items": 0, "captures": 0, "appended": 0, "blobs": 0,
    "timed": False, "has_email": False, "profile": False, "nothing_held": False, "tables": [], "display_name": "Shop",
}


@pytest.fixture
def facts(spark):
    def make(*rows):
        names = [c.split()[0] for c in SCHEMA.replace("\n", " ").split(", ")]
        return spark.createDataFrame([tuple({**BLANK, "request_id": n, **r}.get(c) for c in names) for n, r in enumerate(rows, 1)], SCHEMA)

    return make


def found(frame, *columns):
    return [tuple(r[c] for c in columns) for r in frame.collect()]


def test_visits_are_counted_and_never_upgraded(facts):
    given = facts(
        {"reader": "statement", "visits": 9, "stores": 9},
        {"reader": "statement", "visits": 9, "itemised": 4, "captures": 6},
    )
    graded = findings.disclosure_evidence(given)
    pieces = graded.where("category = 'SPECIFIC_PIECES'").orderBy("request_id")
    assert found(pieces, "status", "evidence") == [
        ("partial", "9 visits, each with a date, a store and a total. No line items."),
        ("partial", "9 visits, each with a date and a total. 4 of them itemised, from 6 screen captures of the receipts."),
    ]
    assert "5 visits still say" in pieces.collect()[1].notes
    assert graded.groupBy("request_id").count().select("count").distinct().collect()[0][0] == len(CATEGORIES)
    assert graded.where("status = 'absent' and evidence is null and notes like '%no prose at all%'").count() == 14


def test_a_workbook_without_a_report_leaves_the_rest_ungraded(facts):
    bought = {"reader": "workbook", "visits": 3, "items": 7, "first_day": "2020-01-01", "last_day": "2021-02-03", "gap": "G."}
    alone, both, none = bought, bought | {"withheld": [], "profile": True, "appended": 5, "timed": True}, {"reader": "workbook"}
    graded = findings.disclosure_evidence(facts(alone, both, none)).where("status <> 'absent'").orderBy("request_id")
    assert found(graded, "request_id", "evidence", "notes") == [
        (1, "3 purchases with 7 line items, 2020-01-01 to 2021-02-03.",
         "The purchase history has no shelf price beside the amount paid, no basket total, no time of day, no payment method."),
        (2, "3 purchases with 7 line items, 2020-01-01 to 2021-02-03; a loyalty profile; 5 inferred attributes.",
         "The purchase history has no shelf price beside the amount paid, no basket total, no payment method."
         " Nothing from an app, a website, an email address or an online order. G."),
        (3, None, None),
    ]
    assert findings.disclosure_evidence(facts(alone, none)).count() == 2


def test_sections_and_plain_text(facts):
    given = facts(
        {"reader": "sections", "heading": "Section 1", "blobs": 4},
        {"reader": "sections"},
        {"reader": "plain", "touched": [("SOURCES", "Obtained from you.")]},
    )
    graded = findings.disclosure_evidence(given).where("status <> 'absent'")
    assert found(graded.orderBy("request_id"), "request_id", "category", "status", "evidence") == [
        (1, "SPECIFIC_PIECES", "provided", "Section 1"), (3, "SOURCES", "partial", "Obtained from you."),
    ]


def questions(given):
    asked = findings.follow_ups(given, findings.disclosure_evidence(given))
    return found(asked.where("kind <> 'missing_category'").orderBy("request_id", "ord"), "request_id", "ord", "kind", "question")


def test_questions_of_a_workbook_in_their_order(facts):
    whole = {
        "reader": "workbook", "visits": 1, "items": 1, "first_day": "2020-01-01", "last_day": "2020-01-01", "profile": True, "appended": 2,
        "asked_name": " Ann ", "holder_name": "BOB", "gap": "It ends.", "withheld": ["We do not include it."],
    }
    asked = questions(facts(whole, whole | {"holder_name": "ann"}, whole | {"asked_name": "I/ss"}, whole | {"withheld": None}))
    by = {n: [q[:40] for i, _, _, q in asked if i == n] for n in range(1, 5)}
    assert [len(by[n]) for n in range(1, 5)] == [3, 2, 2, 1]
    assert by[1][0].startswith("The loyalty profile") and by[1][1].startswith("The purchase history") and by[1][2].startswith("Your response says")
    assert [o for i, o, _, _ in asked if i == 1] == [0, 1, 2]


def test_other_readings_and_missing_categories(facts):
    given = facts(
        {"reader": "plain", "nothing_held": True, "touched": []}, {"reader": "statement", "visits": 1},
        {"reader": "sections", "earlier_than": "1999", "heading": "S"},
    )
    assert [(i, k) for i, _, k, _ in questions(given)] == [(1, "clarification"), (1, "clarification"), (2, "clarification"), (3, "supplemental_period")]
    asked = findings.follow_ups(given, findings.disclosure_evidence(given)).where("kind = 'missing_category'")
    assert {r.request_id: r["count"] for r in asked.groupBy("request_id").count().collect()} == {1: 8, 2: 1, 3: 7}
    assert asked.where("request_id = 3").orderBy("ord").first().description.startswith("Ask Shop to disclose the categories")
    assert asked.where("request_id = 1").orderBy("ord").first().description.startswith("No wording in this response addresses")


def test_findings_of_all_rules_cost_no_shuffle(facts):
    plan = findings.disclosure_evidence(facts({"reader": "plain"}))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_filled_wordings(spark):
    text = spark.range(1).select(findings.filled("a {x} b {y}.", x=F.lit(1), y=F.lit("c"))).first()[0]
    assert text == "a 1 b c."
