from decimal import Decimal

from pyspark.sql import functions as F

from disclens.operators import receipts as ops

FRAGMENT = "visit_key int, part int, complete boolean, clipped boolean, tax decimal(18,2), balance decimal(18,2)"
LINE = "visit_key int, part int, row_no bigint, description string, amount decimal(18,2)"


def captures(spark, *parts, tax=None):
    """Parts of one visit, each (lines, balance or None); a part with a balance is complete."""
    fragments, lines = [], []
    for n, (rows, balance) in enumerate(parts, start=1):
        d = None if balance is None else Decimal(str(balance))
        fragments.append((1, n, balance is not None, False, tax, d))
        lines += [(1, n, i, name, Decimal(str(a))) for i, (name, a) in enumerate(rows, start=1)]
    return spark.createDataFrame(fragments, FRAGMENT), spark.createDataFrame(lines, LINE)


def stitched(spark, *parts):
    found = ops.stitch(*captures(spark, *parts)).orderBy("receipt_no", "part", "row_no").collect()
    return [(r.receipt_no, r.description) for r in found]


A, B, C, D = ("A", 1), ("B", 2), ("C", 3), ("D", 4)


def test_a_repeat_that_makes_it_foot_is_a_seam(spark):
    assert stitched(spark, ([A, B], None), ([B, C], 6)) == [(0, "A"), (0, "B"), (0, "C")]


def test_a_repeat_that_was_bought_twice_stays(spark):
    assert stitched(spark, ([A, B], None), ([B, C], 8)) == [(0, "A"), (0, "B"), (0, "B"), (0, "C")]


def test_each_seam_is_trimmed_for_itself(spark):
    names = [n for _, n in stitched(spark, ([A, B], None), ([A, B, C], None), ([C, D], 13))]
    # A B + C + C D: the first seam repeats two lines, the second none.
    assert names == ["A", "B", "C", "C", "D"]


def test_nothing_foots_so_the_longest_runs_stand(spark):
    assert [n for _, n in stitched(spark, ([A, B], None), ([B, C], 99))] == ["A", "B", "C"]


def test_a_complete_capture_ends_its_receipt(spark):
    assert stitched(spark, ([A], 1), ([B], None), ([C], 5)) == [(0, "A"), (1, "B"), (1, "C")]


def test_two_part_seams_agree_with_the_general_way(spark):
    for balance in (6, 8, 99):
        fragments, lines = captures(spark, ([A, B], None), ([B, C], balance))
        trimmed = ops.seam_of_two(fragments, lines).first().repeated
        assert ops.stitch(fragments, lines).count() == 4 - trimmed


VISIT = "txn_id bigint, request_id bigint, occurred_at string, total_pre_discount decimal(18,2), tender_type string, division_code string"
RECEIPT = (
    "receipt_id bigint, request_id bigint, stamp string, named_date string, subtotal decimal(18,2), tax decimal(18,2),"
    " tax_inferred boolean, balance decimal(18,2), tender string, lane string"
)


def d(x):
    return None if x is None else Decimal(str(x))


def visits(spark, *rows):
    return spark.createDataFrame([(t, 1, at, d(total), None, None) for t, at, total in rows], VISIT)


def receipt(n, stamp, date, subtotal, tax=0, inferred=False):
    return (n, 1, stamp, date, d(subtotal), d(tax), inferred, d(subtotal + tax), "CARD", "L1")


def receipts(spark, *rows):
    return spark.createDataFrame(list(rows), RECEIPT)


def test_time_first_then_date_and_amount_only_when_one_fits(spark, rows):
    there = visits(
        spark, (1, "2020-01-01T10:00:00", 5), (2, "2020-01-02T10:00:00", 7), (3, "2020-01-03T10:00:00", 7),
        (4, "2020-01-03T18:00:00", 7),
    )
    here = receipts(
        spark, receipt(11, "2020-01-01T10:00:00", "2020-01-01", 99), receipt(12, None, "2020-01-02", 7),
        receipt(13, None, "2020-01-03", 7), receipt(14, None, "2020-01-01", 5),
    )
    assert rows(ops.receipt_match(here, there), "receipt_id", "txn_id", "by_filename") == [
        (11, 1, False), (12, 2, True), (14, 1, True),
    ]


def test_a_contradicted_visit_stays_free_for_the_next_slip(spark, rows):
    at = "2020-01-01T10:00:00"
    there = visits(spark, (1, at, 5), (2, at, 8))
    here = receipts(
        spark, receipt(11, at, None, 99), receipt(12, at, None, 4, tax=1, inferred=True), receipt(13, at, None, 8),
        receipt(14, at, None, 8),
    )
    shown, aside = ops.itemise_overlay(there, here)
    assert rows(shown, "txn_id", "receipt_id") == [(1, 12), (2, 13)]
    assert rows(aside, "receipt_id", "reason") == [(11, "disagree"), (14, "no visit")]


def test_overlay_keeps_what_disagrees_out(spark, rows):
    there = visits(spark, (1, "2020-01-01T10:00:00", 5), (2, "2020-01-02T10:00:00", 7), (3, "2020-01-03T10:00:00", None))
    here = receipts(
        spark,
        receipt(11, "2020-01-01T10:00:00", "2020-01-01", 4, tax=1, inferred=True),
        receipt(12, "2020-01-02T10:00:00", "2020-01-02", 6),
        receipt(13, "2020-01-03T10:00:00", "2020-01-03", 6),
        receipt(14, "2020-02-02T10:00:00", "2020-02-02", 6),
    )
    shown, aside = ops.itemise_overlay(there, here)
    assert rows(shown, "txn_id", "receipt_id", "item_total") == [(1, 11, Decimal("5.00")), (2, None, None), (3, None, None)]
    assert rows(aside, "receipt_id", "reason") == [(12, "disagree"), (13, "uncheckable"), (14, "no visit")]
    # Without a statement a sound receipt is a visit of its own.
    alone, _ = ops.itemise_overlay(there.where(F.lit(False)), here, statement=False)
    assert alone.count() == 4


def test_long_seams_past_any_list_of_choices(spark):
    seam = [(f"S{i}", 1) for i in range(40)]
    parts = [([("P", 5)] + seam, None), (seam + [("Q", 7)] + seam, None), (seam + [("R", 9)] + seam, None), (seam + [("Z", 3)], 5 + 7 + 9 + 3 + 6 * 40 - 97)]
    names = [n for _, n in stitched(spark, *parts)]
    assert len(names) == 4 + 6 * 40 - 97 and [n for n in names if n in "PQRZ"] == ["P", "Q", "R", "Z"]


def test_seams_spend_the_surplus_with_most_lines_and_the_first_seam_least():
    from itertools import product
    from random import Random

    rng = Random(3)
    for _ in range(300):
        openings = [[rng.randint(-2, 4) for _ in range(rng.randint(0, 4))] for _ in range(rng.randint(1, 4))]
        surplus = rng.randint(-2, 8)
        fits = [t for t in product(*(range(len(o) + 1) for o in openings)) if sum(sum(o[:n]) for o, n in zip(openings, t)) == surplus]
        expected = min(fits, key=lambda t: (-sum(t), t)) if fits else None
        found = ops._seams_that_spend(openings, surplus)
        assert found == (None if expected is None else list(expected))


def test_one_clipped_capture_sets_its_whole_receipt_aside(spark):
    fragments, lines = captures(spark, ([A], None), ([B], 3), ([C], None), ([D], 7))
    clipped = fragments.withColumn("clipped", F.col("part") == 3)
    sound, aside = ops.set_aside_clipped(clipped)
    assert {(r.part, r.receipt_no) for r in aside.collect()} == {(3, 1), (4, 1)}
    assert {(r.part, r.receipt_no) for r in sound.collect()} == {(1, 0), (2, 0)}
    assert sorted(r.description for r in ops.stitch(clipped, lines).collect()) == ["A", "B"]
