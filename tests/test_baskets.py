from decimal import Decimal

from helpers import items, txns

from disclens.operators import baskets as ops


def settled(spark, lines, visits):
    return {r.txn_id: r for r in ops.settle(ops.basket_totals(visits, lines)).collect()}


def test_basket_without_lines_has_no_figures_but_keeps_its_stated_total(spark):
    visits = txns(spark, (1, 1, "2020-01-01", 12.5))
    row = settled(spark, items(spark, ("x", 99, 9, "A", "1", None, 1, 1)), visits)[1]
    assert not row.lines_disclosed
    assert (row.shelf_total, row.paid_total, row.saved_total, row.stated_pre_discount_delta) == (None,) * 4
    assert row.total_pre_discount == Decimal("12.50")


def test_lines_without_any_shelf_price_keep_only_what_was_paid(spark):
    lines = items(spark, ("a", 1, 1, "A", "1", None, None, 2.29), ("b", 1, 1, "B", "2", None, None, 1))
    row = settled(spark, lines, txns(spark, (1, 1, "2020-01-01", 5)))[1]
    assert row.paid_total == Decimal("3.29")
    assert row.shelf_total is None and row.saved_total is None and row.stated_pre_discount_delta is None


def test_shelf_and_paid_are_summed_over_the_same_lines(spark):
    lines = items(
        spark,
        ("a", 1, 1, "A", "1", None, 2.49, 2.29),
        ("b", 1, 1, "B", "2", None, None, 1.00),
        ("c", 1, 1, "C", "3", None, 4.19, None),
        ("d", 1, 1, "D", "4", None, None, None),
    )
    row = settled(spark, lines, txns(spark, (1, 1, "2020-01-01", 8.00)))[1]
    assert (row.shelf_total, row.paid_total) == (Decimal("7.68"), Decimal("7.48"))
    assert row.saved_total == Decimal("0.20")
    assert row.stated_pre_discount_delta == Decimal("-0.32")


def test_footing_counts_over_and_under(spark):
    lines = items(spark, *[(f"l{t}", t, 1, "A", "1", None, 5, None) for t in (1, 2, 3)])
    visits = txns(spark, (1, 1, "2020-01-01", 5), (2, 1, "2020-01-02", 4), (3, 1, "2020-01-03", 7), (4, 1, "2020-01-04", 9))
    row = ops.footing_summary(ops.settle(ops.basket_totals(visits, lines))).first()
    assert (row.baskets, row.not_footing, row.over, row.under) == (4, 2, 1, 1)
    assert row.worst_delta == Decimal("2.00")


def test_search_takes_wildcards_literally(spark, rows):
    lines = items(spark, ("a", 1, 1, "2% MILK", "1", None, 1, 1), ("b", 2, 1, "MILK", "a_b", None, 1, 1))
    visits = txns(spark, (1, 1, "2020-01-01", None), (2, 1, "2020-01-02", None))
    assert rows(ops.basket_search(visits, lines, "%"), "txn_id") == [(1,)]
    assert rows(ops.basket_search(visits, lines, "_"), "txn_id") == [(2,)]
    assert rows(ops.basket_search(visits, lines, "mIlK"), "txn_id") == [(1,), (2,)]


def test_a_bare_closing_date_covers_its_day(spark, rows):
    visits = txns(spark, (1, 1, "2020-01-31T22:10:00", None), (2, 1, "2020-02-01", None))
    assert rows(ops.timeline_filter(visits, date_to="2020-01-31"), "txn_id") == [(1,)]


def test_months_never_mix_paid_and_stated(spark, rows):
    lines = items(spark, ("a", 1, 1, "A", "1", None, 5, 4))
    visits = txns(
        spark, (1, 1, "2020-01-05", 5), (2, 1, "2020-01-09", 50), (3, 1, "2020-03-01", 7), (4, 1, "2020-03-02", None)
    )
    months = ops.month_index(ops.settle(ops.basket_totals(visits, lines)))
    assert rows(months, "month", "visits", "itemised", "paid", "first_index") == [
        ("2020-01", 2, 1, Decimal("4.00"), 0),
        ("2020-03", 2, 0, Decimal("7.00"), 2),
    ]
    filled = ops.month_fill(months)
    assert rows(filled, "month", "visits", "first_index")[1] == ("2020-02", 0, -1)


def test_one_fractional_quantity_makes_them_all_measures(spark, rows):
    lines = items(
        spark, ("a", 1, 1, "A", "1", 2, 1, 1), ("b", 1, 1, "B", "1", 1.5, 1, 1), ("c", 2, 2, "C", "1", 3, 1, 1),
        ("d", 3, 3, "D", "1", None, 1, 1),
    )
    assert rows(ops.quantity_kind(lines), "request_id", "is_measure", "quantity_disclosed") == [
        (1, True, True), (2, False, True), (3, False, False),
    ]
