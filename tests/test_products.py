import pytest
from helpers import items, plan_of, txns
from pyspark.sql import functions as F

from disclens.functions.labels import clean_label, is_non_product
from disclens.operators import products as ops
from disclens.operators.scale import top_n


@pytest.mark.parametrize(
    ("raw", "clean"),
    [
        ("$4.99 OAT MILK", "OAT MILK"),
        ("(CHINESE BROCCOLI", "CHINESE BROCCOLI"),
        ("2% MILK", "2% MILK"),
        ("7UP", "7UP"),
        ("12 OZ SODA", "12 OZ SODA"),
        ("***", ""),
        ("한국 배추", "한국 배추"),
    ],
)
def test_clean_label(spark, raw, clean):
    assert spark.range(1).select(clean_label(F.lit(raw)).alias("x")).first().x == clean


@pytest.mark.parametrize(
    ("label", "charge"),
    [
        ("CRV DEPOSIT", True),
        ("carryout bag fee", True),
        ("BAG OF RICE", False),
        ("COLA 2L CRV", False),
        ("CRV SODA 12 PACK R1 TAX FS", True),
        ("DEPOSIT ST SODA SINGLE FS", True),
        ("CRV SODA 12OZ", False),
        ("", False),
    ],
)
def test_charges(spark, label, charge):
    assert spark.range(1).select(is_non_product(F.lit(label)).alias("x")).first().x is charge


def visits(spark, n):
    return txns(spark, *[(t, 1, f"2020-01-{t:02}", None) for t in range(1, n + 1)])


def test_a_stray_character_does_not_split_a_product(spark, rows):
    lines = items(
        spark,
        ("a", 1, 1, "(CHINESE BROCCOLI", None, None, 2, None),
        ("b", 2, 1, "CHINESE BROCCOLI", "", None, 2, None),
        ("c", 3, 1, "CHINESE BROCCOLI", None, None, 2, None),
    )
    dim = ops.product_dim(lines, visits(spark, 3))
    assert rows(dim, "key", "label", "match_name", "purchases", "joined", "first_seen", "last_seen") == [
        ("CHINESE BROCCOLI", "CHINESE BROCCOLI", "CHINESE BROCCOLI", 3, True, "2020-01-01", "2020-01-03")
    ]


def test_a_code_in_the_group_keeps_products_apart(spark, rows):
    lines = items(
        spark,
        ("a", 1, 1, "(RYE LOAF", None, None, 2, None),
        ("b", 2, 1, "RYE LOAF", None, None, 2, None),
        ("c", 3, 1, "RYE LOAF", "0007", None, 2, None),
    )
    index = ops.index_rows(ops.product_dim(lines, visits(spark, 3)))
    # Where cleaning would make rows alike, all of them show what was printed.
    assert rows(index, "key", "description", "shares_name") == [
        ("(RYE LOAF", "(RYE LOAF", False), ("0007", "RYE LOAF", True), ("RYE LOAF", "RYE LOAF", True),
    ]


def test_the_commonest_cleaned_spelling_names_a_product(spark):
    lines = items(
        spark,
        ("a", 1, 1, "$4.99 OAT MILK", "1", None, 2, None),
        ("b", 2, 1, "OAT MILK", "1", None, 2, None),
        ("c", 3, 1, "OATMLK", "1", None, 2, None),
    )
    row = ops.product_dim(lines, visits(spark, 3)).first()
    assert (row.label, row.raw) == ("OAT MILK", "OAT MILK")


def test_returns_placeholders_and_blank_names_are_no_purchases(spark):
    lines = items(
        spark,
        ("a", 1, 1, "A", "1", None, -6.99, None),
        ("b", 1, 1, "B", "2", None, 0, 0),
        ("c", 1, 1, "", "", None, 3, None),
        ("d", 1, 1, "D", None, None, None, 3),
    )
    assert [r.product_key for r in ops.purchases(lines).collect()] == ["D"]


def test_set_aside_rows_are_counted_and_stopped_uses_them(spark):
    lines = items(
        spark,
        ("a", 1, 1, "PEARS", "1", None, 2, None),
        ("b", 2, 1, "PEARS", "1", None, 2, None),
        ("c", 3, 1, "CRV DEPOSIT", None, None, 2, None),
    )
    when = txns(spark, (1, 1, "2019-01-01", None), (2, 1, "2019-01-02", None), (3, 1, "2020-01-01", None))
    dim = ops.product_dim(lines, when)
    totals = ops.index_totals(dim).first()
    assert (totals.total_products, totals.set_aside, totals.coverage_end) == (1, 1, "2020-01-01")
    assert totals.stale_before == "2019-07-05"
    assert ops.index_rows(dim).first().stopped is True


def test_cap_keeps_the_most_bought_and_says_what_went(spark, rows):
    names = [("A", 1), ("B", 3), ("C", 2), ("D", 2)]
    lines, n = [], 0
    for name, times in names:
        for _ in range(times):
            n += 1
            lines.append((f"i{n}", n, 1, name, name, None, 2, None))
    index = ops.index_rows(ops.product_dim(items(spark, *lines), visits(spark, n)))
    assert rows(ops.cap_rows(index, 2), "description", "rank") == [("B", 1), ("C", 2)]
    left = ops.cap_summary(index, 2).first()
    assert (left.left_out, left.left_out_max_purchases) == (2, 2)


def test_top_n_of_a_hot_group_is_exact(spark):
    df = spark.range(20000).select(F.lit(1).alias("g"), (F.col("id") * 7919 % 20011).alias("v"), "id")
    got = top_n(df, ["g"], [F.col("v").desc()], 1500, ["id"]).orderBy("rank").select("v", "rank").collect()
    expected = [r.v for r in df.orderBy(F.col("v").desc()).limit(1500).collect()]
    assert [r.v for r in got] == expected
    assert [r["rank"] for r in got] == list(range(1, 1501))


def test_one_request_of_most_rows_is_dealt_out_by_name(spark):
    """90 % of all products are one request's; names that repeat are found whatever the plan."""
    names = [(1, f"k{n}", f"label {n % 700}", n) for n in range(900)] + [(r, f"k{r}", "label 1", 1) for r in range(2, 102)]
    rows = [(r, k, None, label, f"{label} of {k}", n + 1, "2020-01-01", "2020-02-01", False) for r, k, label, n in names]
    dim = spark.createDataFrame(
        rows, "request_id long, key string, upc string, label string, match_name string, purchases long, first_seen string, last_seen string, refused boolean"
    )
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        index = ops.index_rows(dim)
        plan = index._jdf.queryExecution().executedPlan().toString()
        found = index.collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "hashpartitioning(request_id" in plan and "description" in plan.split("hashpartitioning(request_id", 1)[1][:60]
    assert not any(line.count("hashpartitioning(request_id") and "description" not in line for line in plan.splitlines())
    twice = {f"label {n}" for n in range(200)}
    for r in found:
        label = f"label {int(r.key[1:]) % 700}" if r.request_id == 1 else "label 1"
        alike = r.request_id == 1 and label in twice
        assert r.description == (f"{label} of {r.key}" if alike else label) and not r.shares_name


def test_entries_are_written_once_for_heads_and_prices(spark):
    lines = items(spark, ("a", 1, 1, "OAT MILK", None, None, 5, 5), ("b", 1, 1, "2% OAT", "0001", None, 3, 3))
    entry = ops.named(lines, txns(spark, (1, 1, "2020-01-01", 8)))[1].entry
    assert "Aggregate" not in plan_of(entry) and entry.count() == 2


def test_what_the_cap_left_out_is_counted_without_ranking_rows(spark, rows):
    """Only numbers of purchases are read, equal ones across the cap and requests within it included."""
    bought = [(1, 9, True), (1, 7, False), (1, 7, True), (1, 7, False), (1, 2, False), (2, 4, True), (3, 5, False), (3, 5, False), (3, 1, True)]
    index = spark.createDataFrame(bought, "request_id bigint, purchases bigint, stopped boolean")
    columns = ("request_id", "product_count", "stopped_count", "left_out", "left_out_max_purchases")
    assert rows(ops.cap_summary(index, 2), *columns) == [(1, 5, 2, 3, 7), (2, 1, 1, 0, 0), (3, 3, 1, 1, 1)]
