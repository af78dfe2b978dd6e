import random
import re

import pytest
from pyspark.sql import functions as F

from disclens.fixed_values import HARVEST_RULES, PII_RULES
from disclens.operators import governance as gov


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts, start=1)), "doc_id int, text string")


def found(spark, text):
    return sorted((r.rule, r.matched) for r in gov.pii_scan(docs(spark, text)).collect())


@pytest.mark.parametrize(
    ("text", "rules"),
    [
        ("write to ann@shop.net or bob@example.com", [("EMAIL", "ann@shop.net")]),
        ("call (212) 200-1234 not 212-555-1234", [("PHONE", "(212) 200-1234")]),
        ("12 Old Mill Road, Fresno, CA 93721", [("STREET_ADDRESS", "12 Old Mill Road"), ("ZIP_WITH_STATE", "CA 93721")]),
        ("94103-1234", [("ZIP_PLUS_FOUR", "94103-1234")]),
        ("4111 1111 1111 1111 and 4111 1111 1111 1112", [("PAYMENT_CARD", "4111 1111 1111 1111")]),
        ("123-45-6789 but 000-45-6789", [("SSN", "123-45-6789")]),
        ("card 601234567890 x", [("LOYALTY_NUMBER", "601234567890")]),
        ("sha deadbeef601234567890deadbeefdeadbeef", []),
        ("pii-scan: allow a fixture\nann@shop.net", []),
        ("pii-scan: allow\nann@shop.net", [("EMAIL", "ann@shop.net")]),
    ],
)
def test_rules(spark, text, rules):
    assert found(spark, text) == rules


def test_every_rule_against_brute_force(spark):
    """Python's own engine over random lines built from the pieces the rules look for."""
    rng = random.Random(3)
    pieces = ["ann@shop.net", "x@a.example.com", "(212) 200-1234", "+1 415 201 9999", "12 Old Mill Road", "CA 93721-1234", "94103-1234",
              "4111111111111111", "4111 1111-1111 1111", "123-45-6789", "601234567890", "0123456789abcdef" * 3, "word", "ab4111111111111111cdef0123456789abcdef", "ab601234567890cdef0123456789abcdef", "\x01", "601234567890 ", ".", "-", "9",
              "123e4567-e89b-12d3-a456-426614174000"]
    lines = ["".join(rng.choice(pieces) + rng.choice(["", " ", ", "]) for _ in range(rng.randint(1, 6))) for _ in range(900)]
    lines.append("4111111111111111 and ab4111111111111111cdef0123456789abcdef 7")

    def luhn(digits):
        odd, even = [int(c) for c in digits[-1::-2]], [int(c) * 2 for c in digits[-2::-2]]
        return (sum(odd) + sum(x - 9 if x > 9 else x for x in even)) % 10 == 0

    def accepted(rule, m):
        text = m.group()
        in_hash = any(h.start() <= m.start() and m.end() <= h.end() for h in re.finditer(r"[0-9a-fA-F]{32,}", m.string))
        if rule == "EMAIL":
            return not text.endswith((".example", ".invalid", ".test", ".localhost", "@example.com"))
        if rule == "PHONE":
            return not re.search(r"555[-. ]\d{4}$", text)
        if rule == "PAYMENT_CARD":
            digits = re.sub(r"\D", "", text)
            return 13 <= len(digits) <= 19 and luhn(digits) and not in_hash
        return not (rule == "LOYALTY_NUMBER" and in_hash)

    expected = sorted(
        (n, rule, m.group()) for n, line in enumerate(lines, start=1) for rule, pattern in PII_RULES
        for m in re.finditer(pattern, line) if accepted(rule, m)
    )
    got = sorted((r.line_no, r.rule, r.matched) for r in gov.pii_scan(docs(spark, "\n".join(lines))).collect())
    assert got == expected


def test_mask(spark):
    df = spark.createDataFrame([("abcd",), (" abcdefg ",)], "x string")
    assert [r.m for r in df.select(gov.mask(F.col("x")).alias("m")).collect()] == ["****", "ab***fg"]


def test_denylist_against_brute_force(spark):
    rng = random.Random(9)
    vocabulary = ["ox", "oxen", "red", "mill", "élan", "a1", "a1b", "-", ".", "Zed"]
    text = lambda n: "".join(rng.choice(vocabulary) + rng.choice([" ", "", ", "]) for _ in range(n))
    lines = [text(12) for _ in range(150)]
    needles = sorted({t for n in range(120) if (t := text(1 + n % 4).strip())} | {"x", "en ", "red mill ox"})
    hits = gov.denylist_hits(docs(spark, "\n".join(lines)), spark.createDataFrame([(n,) for n in needles], "needle string"))
    got = sorted((r.line_no, r.needle) for r in hits.collect())
    listed = {n.strip().lower() for n in needles} - {""}
    assert got == sorted((i, n) for i, line in enumerate(lines, start=1) for n in listed if n in line.lower())


@pytest.mark.parametrize(
    ("value", "kept"),
    [("secret", True), ("short", False), ("Unknown", False), ("12345678", False), ("123-456-789", True), ("0000000", False), ("aaaaaaa", False)],
)
def test_worth_keeping(spark, value, kept):
    assert spark.range(1).select(gov.worth_keeping(F.lit(value)).alias("x")).first().x is kept


def test_harvest_against_brute_force(spark):
    text = "ann@shop.net 4155550000 12 Old Mill Bend 94103-1234 id 123456789012 v1.123456789012"
    got = sorted((r.bucket, r.value) for r in gov.harvest_text(docs(spark, text)).collect())
    assert got == sorted((b, m.group().strip()) for b, p in HARVEST_RULES for m in re.finditer(p, text))


def test_known_values_go_and_visit_dates_stay(spark, rows):
    values = spark.createDataFrame([("email addresses", "Ann@shop.net"), ("dates and times of a visit", "2020-01-02"), ("x", "new value")],
                                   "bucket string, value string")
    corpus = docs(spark, "released 2020-01-02 by ann@shop.net")
    assert rows(gov.denylist_split(values, corpus), "value", "known", "kept") == [
        ("2020-01-02", True, True), ("Ann@shop.net", True, False), ("new value", False, True),
    ]


def test_skeletons(spark):
    got = spark.range(1).select(
        gov.skeleton_text(F.lit("Card 60123,\nAnn!")).alias("text"),
        gov.skeleton_key(F.lit("60123456789")).alias("key"),
        gov.skeleton_key(F.lit("loyaltyNo")).alias("name"),
        gov.number_shape(F.lit(-4.99)).alias("number"),
        gov.string_shape(F.lit("3/7/2020")).alias("date"),
        gov.string_shape(F.lit("on 2020-01-02")).alias("words"),
    ).first()
    assert tuple(got) == ("a4 95,\na3!", "<key:len=11>", "loyaltyNo", "<num:-1e0>", "<date:2020-03>", "<str:len=13>")


def test_sources_of_the_denylist(spark):
    letters = docs(spark, 'See {"cardNumber": "600123",\n  12  \n"Status": "active-9", "city": "Elm Town"} and {"broken"')
    empty = spark.createDataFrame([], "key string, value string")
    visits = spark.createDataFrame([("2020-01-02T10:20:30",)], "occurred_at string")
    held = spark.createDataFrame([("1 Main Street, Fresno, CA 93721",), ("short",), (None,)], "value string")
    requests = spark.createDataFrame([("REF-2020-77",), (None,), ("no",)], "report_reference string")
    names = spark.createDataFrame([("in/Report RPT00123.v2.pdf",), ("AB12.txt",)], "original_filename string")
    found = {(r.bucket, r.value) for r in gov.denylist_build(letters, empty, visits, held, requests, names).collect()}
    assert {f for f in found if f[0] not in ("street addresses", "dates and times of a visit")} == {
        ("identifying JSON fields", "Elm Town"),
        ("identifiers the adapter found", "1 Main Street, Fresno, CA 93721"), ("identifiers the adapter found", "1 Main Street"),
        ("identifiers the adapter found", "Fresno"), ("identifiers the adapter found", "CA 93721"),
        ("report references", "REF-2020-77"), ("report references", "RPT00123"),
    }
