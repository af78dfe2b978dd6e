import datetime
import random
from decimal import Decimal

import pandas as pd
import pytest
from pyspark.sql import functions as F

from disclens.functions import cells
from disclens.functions.amounts import num_coerce
from disclens.functions.dates import serial_date, ts_normalise
from disclens.functions.text import strip
from disclens.operators import bundles, extract_cells, extract_json, extract_text
from disclens.operators.disclosure import absent_completion


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    ("text", "value"),
    [("$1,234.56", Decimal("1234.5600")), ("", None), ("n/a", None), ("NaN", None), ("-Infinity", None), (" 7 ", Decimal("7.0000"))],
)
def test_numbers_are_never_guessed(spark, text, value):
    assert one(spark, num_coerce(F.lit(text))) == value


@pytest.mark.parametrize(
    ("date", "time", "stamp"),
    [
        ("08/17/2024 00:00:00", "15:52:00", "2024-08-17T15:52:00"),
        ("2024-08-17", None, "2024-08-17T00:00:00"),
        ("8/7/2024 9:05", None, "2024-08-07T09:05:00"),
        ("8/7/2024 9:05", "00:00:00", "2024-08-07T09:05:00"),
        ("yesterday", "10:00", None),
    ],
)
def test_wall_clocks(spark, date, time, stamp):
    assert one(spark, ts_normalise(F.lit(date), F.lit(time).cast("string"))) == stamp


@pytest.mark.parametrize(
    ("cell", "date"),
    [
        ("44000", "2020-06-18"),
        ("44000.5", "2020-06-18T12:00:00"),
        ("44000.9999999", "2020-06-19"),
        ("0.5", None),
        ("2020-13-45", None),
        ("2/29/2020", "2020-02-29"),
        ("99999999", None),
    ],
)
def test_serials(spark, cell, date):
    assert one(spark, serial_date(F.lit(cell))) == date


def test_serials_count_days_from_the_epoch(spark):
    days = [1, 59, 60, 61, 40000, 2958465]
    df = spark.createDataFrame([(d,) for d in days], "d int")
    got = [r.x for r in df.select(serial_date(F.col("d").cast("string")).alias("x")).collect()]
    assert got == [(datetime.date(1899, 12, 30) + datetime.timedelta(days=d)).isoformat() for d in days]


def test_column_letters_and_back(spark):
    df = spark.range(1, 16385).select("id", cells.column_letter(F.col("id")).alias("letters"))
    known = {1: "A", 26: "Z", 27: "AA", 702: "ZZ", 703: "AAA", 16384: "XFD"}
    found = {r.id: r.letters for r in df.where(F.col("id").isin(list(known))).collect()}
    assert found == known
    assert df.where(cells.column_index(F.col("letters")) != F.col("id")).count() == 0


def spans(spark, text):
    df = spark.createDataFrame([(1, text)], "doc_id int, text string")
    return [(r.start, r.end, r.status, r.json) for r in extract_json.json_spans(df).orderBy("start").collect()]


def test_braces_in_strings_do_not_count(spark):
    text = 'see {"a": "}{", "b": {"c": "\\"}"}} end'
    assert [s[:3] for s in spans(spark, text)] == [(4, text.rindex("}") + 1, "ok")]


def test_the_two_repairs_and_nothing_else(spark):
    text = '{"a": "two\nlines", } {"b": [1, 2,],} {c} {"cut": {"off": 1}'
    found = spans(spark, text)
    assert [s[2] for s in found] == ["repaired", "repaired", "unparseable", "unterminated"]
    assert found[0][3] == '{"a": "two lines"}' and found[1][3] == '{"b": [1, 2]}'
    assert found[3][1] == len(text)


def test_page_numbers_are_the_longest_run(spark):
    text = "a\n 4\nb\n17\n5\nc\n6\n[\n5\n]\n9"
    row = extract_text.strip_page_markers(
        spark.createDataFrame([(1, text), (2, "x\n7\ny")], "doc_id int, text string")
    ).orderBy("doc_id").collect()
    assert row[0].text == "a\nb\n17\nc\n[\n5\n]\n9"
    assert [(b.offset, b.number) for b in row[0].breaks] == [(2, 4), (7, 5), (9, 6)]
    assert row[0].first_page == 3
    # One bare number proves nothing.
    assert row[1].text == "x\n7\ny" and row[1].breaks == []


def test_page_chain_against_brute_force():
    rng = random.Random(5)

    def longest(numbers):
        sizes = []
        for i, number in enumerate(numbers):
            sizes.append(1 + max((sizes[j] for j in range(i) if numbers[j] == number - 1), default=0))
        return max(sizes, default=0)

    for _ in range(200):
        numbers = [rng.randint(1, 6) for _ in range(rng.randint(0, 12))]
        marks = extract_text.page_chain.func(pd.Series([[{"line": i, "number": n} for i, n in enumerate(numbers)]]))[0]
        size = longest(numbers)
        assert len(marks) == (size if size >= 2 else 0)
        assert all(numbers[b] == numbers[a] + 1 for a, b in zip(marks, marks[1:], strict=False))


def test_sections_end_where_the_next_begins(spark, rows):
    df = spark.createDataFrame([(1, "pre H1:one H2:two H1:three")], "doc_id int, text string")
    assert rows(extract_text.sections(df, ["H1:", "H2:"]), "header", "body_start", "body_end") == [
        ("H1:", 21, 26), ("H1:", 7, 11), ("H2:", 14, 18),
    ]


def test_offsets_before_the_first_break_take_the_default(spark, rows):
    offsets = spark.createDataFrame([(1, 0), (1, 7), (1, 30)], "doc_id int, offset int")
    breaks = spark.createDataFrame([(1, 7, "A"), (1, 20, "B")], "doc_id int, offset int, header string")
    got = extract_text.offset_asof(offsets, breaks, "header", F.lit(""))
    assert rows(got, "offset", "header") == [(0, ""), (30, "B"), (7, "A")]


def test_hints_are_partial_at_most_and_quoted_whole(spark, rows):
    text = "Dear reader. We retain\nnothing. Our Service  Providers and   third parties help! We retain it."
    docs = spark.createDataFrame([(1, text), (2, "Nothing here.")], "doc_id int, text string")
    found = extract_text.hint_grading(docs)
    assert rows(found, "doc_id", "category", "status", "evidence") == [
        (1, "RETENTION_PERIOD", "partial", "We retain"),
        (1, "THIRD_PARTIES_SHARED_WITH", "partial", "Our Service Providers and third parties help!"),
    ]
    complete = absent_completion(found, docs, "doc_id")
    assert complete.where("status = 'absent'").groupBy("doc_id").count().orderBy("doc_id").collect()[1]["count"] == 8


def test_sentences_need_a_stop_and_a_capital(spark, rows):
    text = "Data (e.g., address and i.e., PHI) is kept. We do not include it. • Call us"
    docs = spark.createDataFrame([(1, text)], "doc_id int, text string")
    assert rows(extract_text.quote_sentences(docs, "."), "seq", "sentence") == [
        (0, "Data (e.g., address and i.e., PHI) is kept."), (1, "We do not include it."), (2, "Call us"),
    ]


def test_a_doubled_heading_is_read_once(spark):
    assert one(spark, extract_text.undouble(F.lit("LLooyyaallttyy  DDeettaaiillss"))) == "Loyalty Details"
    assert one(spark, extract_text.undouble(F.lit("Card_nbr 1133"))) == "Card_nbr 1133"


def test_one_bad_basket_costs_one_warning(spark, rows):
    body = """{"customer": [{"basket": [5, {"date": "never"}, {"date": "2020-01-02", "items": [
        {"purchasedescription": "A", "retailamt": "$2.00"}, "junk", {"productupc": " "}]}]}]}"""
    docs = spark.createDataFrame([(1, body), (2, "{}"), (3, "not json")], "doc_id int, json string")
    txns, items, warnings = extract_json.nested_baskets(docs)
    assert rows(txns, "doc_id", "basket_pos", "occurred_at") == [(1, 2, "2020-01-02T00:00:00")]
    assert rows(items, "item_pos", "description_raw", "upc") == [(0, "A", None), (2, "", None)]
    assert rows(warnings, "doc_id", "message") == [
        (1, "Basket 0 was not an object and was skipped."),
        (1, "Basket 1 had no usable date and was skipped."),
        (1, "Item 1 of basket 2 was not an object."),
        (2, "The purchases section had no customer object."),
        (3, "The purchases section had no customer object."),
    ]


def test_headers_are_found_by_name(spark, rows):
    cell_rows = [
        (1, "S", 1, 1, "A title"), (1, "S", 2, 1, "net"), (1, "S", 3, 1, "Net"), (1, "S", 3, 2, " when  "), (1, "S", 3, 4, "NET"),
        (1, "S", 4, 2, "44000"), (1, "S", 4, 4, "2.5"),
    ]
    sheet = spark.createDataFrame(cell_rows, "doc_id int, sheet string, row_no int, col_no int, value string")
    columns = extract_cells.header_map(sheet, ["NET", "WHEN"], ["NET", "WHEN"])
    assert rows(columns, "header", "header_row", "col_no") == [("NET", 3, 4), ("WHEN", 3, 2)]
    assert rows(extract_cells.sheet_lines(sheet, columns, ["NET", "WHEN"]), "row_no", "NET", "WHEN") == [(4, "2.5", "44000")]


def test_a_column_is_redundant_only_if_every_row_says_so(spark, rows):
    pairs = [(1, "2.50", "3"), (1, "2.50", "2"), (1, "7.10", "7"), (2, "1", "1"), (2, "2", "x"), (2, "3", "3"), (2, "4", "4"),
             (3, "1", "1"), (3, None, "9"), (3, "2", "2")]
    df = spark.createDataFrame(pairs, "k int, amount_raw string, point_raw string")
    assert rows(extract_cells.column_redundancy(df, "k"), "k", "holds", "checked_rows") == [(1, True, 3), (2, False, 0), (3, False, 0)]


def test_repeated_warnings_are_counted(spark):
    df = spark.createDataFrame([(1, "info", "m", f"{n:02}") for n in range(8)], "r int, severity string, message string, seq string")
    got = [r.message for r in extract_cells.warning_cap(df, "r", "seq").collect()]
    assert sorted(got) == ["3 more lines like the above: m"] + ["m"] * 5


def test_a_fallback_never_beats_a_format_that_knows(spark, rows):
    scores = [(1, "generic", 0.9), (1, "a", 0.1), (2, "generic", 0.1), (2, "a", 0.0), (3, "a", float("nan")), (3, "b", 7.0),
              (4, "b", 0.5), (4, "a", 0.5), (5, "a", float("inf"))]
    df = spark.createDataFrame(scores, "bundle int, format string, score double")
    assert rows(bundles.format_select(df), "bundle", "format", "confidence", "is_confident") == [
        (1, "a", 0.1, False), (2, "generic", 0.1, False), (3, "b", 1.0, True), (4, "a", 0.5, True),
    ]


def test_an_impossible_capture_date_is_none(spark, rows):
    files = spark.createDataFrame([("x/shop_133120_2.png",), ("shop_022920.png",), ("cover.png",)], "original_filename string")
    assert rows(bundles.capture_files(files), "visit_key", "on_date", "part") == [
        ("cover", None, None), ("shop_022920", "2020-02-29", None), ("shop_133120", None, 2),
    ]


def test_very_deep_nesting_costs_its_own_span_only(spark):
    deep = "{\"a\":" * 30000 + "1" + "}" * 30000
    docs = spark.createDataFrame([(1, deep + ' {"b": 1}')], "doc_id long, text string")
    found = extract_json.json_spans(docs).orderBy("start").collect()
    assert [r.status for r in found] == ["unparseable", "ok"]
    walked = extract_json.json_walk(spark.createDataFrame([(1, deep), (2, '{"b": 1}')], "doc_id long, json string")).collect()
    assert [(r.doc_id, r.key, r.value) for r in walked] == [(2, "b", "1")]


def test_white_space_of_any_kind_is_stripped(spark):
    rows = spark.createDataFrame([("\t a b  \n",), ("\x1c",), (None,)], "t string")
    assert [r[0] for r in rows.select(strip(F.col("t"))).collect()] == ["a b", "", None]


def test_values_of_a_report_come_back_as_printed(spark):
    lines = ["Request details", "Request ref ID 11AABB Request type Know", "DDaattee ssuubbmmiitttteedd 2 / 2 2020 First name", "Last name  De   La", "Last name Roe",
             "Detailed Report", "Profile Details [card: 1 2]", "Card_nbr 1133", "AABB 1122", "a   b", "Phone", "1 / 2", "Email x@y.z"]
    docs = spark.createDataFrame([(1, n, line) for n, line in enumerate(lines)], "doc_id long, line_no int, line string")
    found = {(r.section, r.key): (r.value, r.page) for r in extract_text.report_fields(docs).collect()}
    assert found == {
        ("Request details", "Request ref ID"): ("11AABB", 1), ("Request details", "Request type"): ("Know", 1),
        ("Request details", "Date submitted"): ("2 / 2 2020", 1), ("Request details", "First name"): ("", 1), ("Request details", "Last name"): ("Roe", 1),
        ("Profile Details", "Card_nbr"): ("1133 AABB 1122 a   b", 1), ("Profile Details", "Phone"): ("", 1), ("Profile Details", "Email"): ("x@y.z", 2),
    }


def test_what_a_line_of_a_report_is_is_found_once(spark):
    docs = spark.createDataFrame([(1, 0, "Detailed Report"), (1, 1, "Profile Details"), (1, 2, "Card_nbr 1")], "doc_id long, line_no int, line string")
    fields = extract_text.report_fields(docs)
    assert r"\s*/\s*" not in fields._jdf.queryExecution().optimizedPlan().toString()
    assert [r.key for r in fields.collect()] == ["Card_nbr"]


def test_cells_become_lines_in_one_shuffle(spark, rows):
    cells = [(1, "S", 1, 1, "net "), (1, "S", 1, 2, "WHEN"), (1, "S", 2, 1, "5"), (1, "S", 2, 2, None), (1, "S", 3, 3, "x"), (None, "S", 1, 1, "NET"), (None, "S", 1, 2, "When")]
    sheet = spark.createDataFrame(cells, "doc_id long, sheet string, row_no int, col_no int, value string")
    columns = extract_cells.header_map(sheet, ["NET", "WHEN"], ["NET", "WHEN"])
    lines = extract_cells.sheet_lines(sheet, columns, ["NET", "WHEN"])
    shuffles = [s for s in sheet_plan(lines) if "Exchange hashpartitioning" in s and "value" not in s]
    assert rows(columns, "doc_id", "header_row", "header", "col_no") == [(1, 1, "NET", 1), (1, 1, "WHEN", 2)]
    assert rows(lines, "row_no", "NET", "WHEN") == [(2, "5", None)]
    assert sum("row_no" in s for s in shuffles) == 1


def sheet_plan(df):
    return df._jdf.queryExecution().executedPlan().toString().split("\n")


def test_identifiers_of_a_report(spark):
    from disclens.operators.report_identities import report_identities

    rows = [("Loyalty Store Visits Details", 1, 1, "Card_first_visit_dt", "2010-01-02"), ("Loyalty Profile Details", 2, 1, "Card_nbr", " 99 "),
            ("Loyalty Profile Details", 2, 2, "Customer_id", "I/ss"), ("Other Details", 3, 1, "Email", "a@b.c"), ("Preference Details", 4, 1, "os_cust_id", "7"),
            ("Loyalty Profile Details", 2, 3, "Address", "1 Main St"), ("Loyalty Profile Details", 2, 4, "Postal_zone_cd", "93721"),
            ("Request details", None, None, "Last name", "Roe"), ("Loyalty Profile Details", 2, 5, "Household_id", "99")]
    fields = spark.createDataFrame([(1, *r) for r in rows], "doc_id long, section string, section_no long, field_no long, key string, value string")
    assert {tuple(r)[1:] for r in report_identities(fields).collect()} == {
        ("loyalty_card", "99", None, "2010-01-02"), ("alternate_id", "7", None, None), ("household", "99", "household", None),
        ("name", "Roe", "individual", None), ("address", "1 Main St, 93721", "household", None),
    }
