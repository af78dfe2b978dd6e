import numpy as np
import pytest
from helpers import items, plan_of, shopping, txns

from disclens.operators import prices as ops
from disclens.operators.products import identify
from disclens.sources import staging


def history(spark, amounts, **kw):
    lines, visits = shopping(spark, amounts, **kw)
    series = ops.series_points(ops.price_points(lines, visits), identify(lines, visits).heads)
    return series


@pytest.mark.parametrize(
    ("amounts", "kind"),
    [
        ([2.19, 2.25, 2.19, 2.29, 2.35], "unit"),
        ([2.00, 2.40, 2.90, 3.50, 4.00], "unit"),
        ([2.19, 2.19, 4.38, 2.19, 2.25], "multiple"),
        ([4.38, 4.38, 4.38, 2.19], "multiple"),
        ([5.12, 7.83, 6.41, 9.02, 4.77], "weight"),
        ([5.12, 7.83, 6.41], "unit"),
    ],
)
def test_shape(spark, amounts, kind):
    assert ops.price_shape(history(spark, amounts)).first().shape == kind


def test_a_single_divides_the_pair(spark):
    series = history(spark, [4.38, 4.38, 4.38, 2.19])
    priced = ops.product_prices(series)
    assert float(priced.first().base) == 2.19
    marks = {r.item_id: r.multiple_of for r in ops.marked_points(series, priced).collect()}
    assert [marks[k] for k in sorted(marks)] == [2, 2, 2, None]


def test_counts_divide_lines_and_measures_do_not(spark, rows):
    visits = txns(spark, (1, 1, "2020-01-01", None), (2, 2, "2020-01-01", None))
    lines = items(
        spark, ("a", 1, 1, "A", "1", 3, 4.50, 4.00), ("b", 2, 2, "A", "1", 2, 5, None), ("c", 2, 2, "B", "2", 0.5, 5, None)
    )
    points = ops.price_points(lines, visits)
    assert [(r.item_id, r["count"], float(r.unit_retail), float(r.unit_paid)) for r in points.orderBy("item_id").collect()] == [
        ("a", 3, 1.5, 1.3333), ("b", None, 5.0, 5.0), ("c", None, 5.0, 5.0),
    ]


# Fixed values of the series model: how prices drift and scatter by kind.
DRIFT_PER_YEAR, YEARS, JITTER = 0.061, 2.0, (0.96, 1.06)
MARKDOWN_RATE, MARKDOWN = 0.12, (0.70, 0.85)
WEIGHTS, DOUBLE_RATE, TIMES = (0.55, 1.75), 0.06, [2, 2, 2, 3]


def generated(count, seed=11):
    """Series whose kind is known; a double purchase that never happened leaves a unit series."""
    rng = np.random.default_rng(seed)
    for kind in rng.choice(["weight", "multiple", "unit"], count):
        n = int(rng.integers(4, 23))
        prices = rng.uniform(0.79, 16.99) * (1 + DRIFT_PER_YEAR * np.linspace(0, YEARS, n)) * rng.uniform(*JITTER, n)
        prices *= np.where(rng.random(n) < MARKDOWN_RATE, rng.uniform(*MARKDOWN, n), 1)
        doubled = (rng.random(n) < DOUBLE_RATE) & (kind == "multiple")
        prices *= np.where(doubled, rng.choice(TIMES, n), 1)
        if kind == "weight":
            prices *= rng.uniform(*WEIGHTS, n)
        if kind == "multiple" and not doubled.any():
            kind = "unit"
        yield [float(p) for p in np.round(np.maximum(prices, 0.10), 2)], str(kind)


@pytest.fixture(scope="module")
def scored(spark):
    labelled = list(generated(1200))
    lines, visits, at = [], [], 0
    for p, (amounts, _) in enumerate(labelled):
        for n, a in enumerate(amounts):
            at += 1
            lines.append((f"i{at:06}", at, 1, f"P{p}", f"{p:05}", None, a, None))
            visits.append((at, 1, f"2020-{1 + n // 28:02}-{1 + n % 28:02}", None))
    lines, visits = items(spark, *lines), txns(spark, *visits)
    series = ops.series_points(ops.price_points(lines, visits), identify(lines, visits).heads).cache()
    found = {int(r.key): r for r in ops.price_shape(series).collect()}
    return labelled, series, found


FIGURES = ("points", "low", "high", "median", "biggest", "base", "gap", "multiples", "shape", "clusters",
           "first_point", "last_point", "first_single", "last_single", "shelf_disclosed")


@pytest.mark.parametrize("chunk_prices", [9, 2])
def test_chunks_of_any_size_give_the_same_figures(scored, chunk_prices):
    _, series, found = scored
    in_chunks = {int(r.key): r for r in ops.price_shape(series, chunk_prices=chunk_prices).collect()}
    assert in_chunks.keys() == found.keys()
    for p, r in in_chunks.items():
        assert [r[f] for f in FIGURES] == [found[p][f] for f in FIGURES]


def test_a_wide_product_is_gathered_by_no_task(spark):
    """3,000 different prices of one product in chunks of about 200; clusters go on over their borders."""
    amounts = [round(1 + 0.01 * n, 2) for n in range(3000)]
    series = history(spark, amounts)
    histogram, last = ops._chunked(ops.amount_histogram(series), 200)
    sizes = [r["count"] for r in histogram.groupBy("chunk").count().collect()]
    assert last + 1 == len(sizes) >= 12 and max(sizes) <= 260
    whole, parts = ops.price_shape(series).first(), ops.price_shape(series, chunk_prices=200).first()
    assert [parts[f] for f in FIGURES] == [whole[f] for f in FIGURES]
    anchors, clusters = [], [float(c.anchor) for c in parts.clusters]
    for a in amounts:
        if not anchors or abs(a - anchors[-1]) / anchors[-1] > 0.03:
            anchors.append(a)
    assert clusters == anchors and sum(c.n for c in parts.clusters) == parts.points == 3000


def test_classifier_quality(scored):
    """PRC-14: regression floors of precision and recall."""
    labelled, _, found = scored
    truth = [kind for _, kind in labelled]
    told = [found[p].shape for p in range(len(labelled))]

    def score(kind):
        hit = sum(a == kind == b for a, b in zip(told, truth, strict=True))
        return hit / told.count(kind), hit / truth.count(kind)

    precision, recall = score("weight")
    assert recall >= 0.70 and precision >= 0.78
    precision, recall = score("unit")
    assert recall >= 0.95 and precision >= 0.70
    assert score("multiple")[0] >= 0.90


def test_the_stored_series_is_that_of_the_points(spark, rows):
    lines, visits = shopping(spark, [2, 2, 3], upc=None)
    more, later = shopping(spark, [4, 5], description="$1.00 OAT MILK", upc=None, start=9)
    lines, visits = lines.union(more), visits.union(later)
    found = identify(lines, visits)
    whole = ops.series_points(ops.price_points(lines, visits), found.heads)
    names = ["request_id", "key", "unit_amount", "unit_paid", "retail_amt", "place", "on_date", "item_id"]
    held = ops.stored_series(lines, visits, found)
    assert held.columns == names and rows(held, *names) == rows(whole, *names)
    assert {r.key for r in held.collect()} == {"OAT MILK"}


def test_end_points_are_not_written_where_nobody_reads_them(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(staging, "shared_folder", lambda spark: f"file://{tmp_path}")
    figures = ops.product_prices(history(spark, [2, 2, 3]))
    held = [set(spark.read.parquet(f"file://{p}").columns) for p in (tmp_path / "staged").iterdir()]
    assert {"request_id", "key", "unit_amount", "n"} in held
    assert "item_id" not in plan_of(figures.select("request_id", "key", "clusters", "base")).replace("item_id string", "")
    assert figures.select("first_point").first().first_point.item_id == "i0001"


def test_end_points_are_the_first_and_last_singles(spark):
    amounts = [4.38, 2.19, 2.25, 2.19, 4.38]
    r = ops.product_prices(history(spark, amounts), store=True).first()
    assert [float(r[c].unit_paid) for c in ("first_point", "last_point", "first_single", "last_single")] == [4.38, 4.38, 2.19, 2.19]
    assert (r.multiples, r.points, r.shelf_disclosed) == (2, 5, True)
