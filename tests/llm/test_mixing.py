import re
from collections import Counter
from fractions import Fraction

import pytest

from disclens.llm.mixing import mixed_documents, mixing_plan

SCHEMA = "source_document_id long, retailer_id string, text string, size int, _row string"


def documents(spark, rows):
    return spark.createDataFrame([(*r, 7, "other") for r in rows], SCHEMA)


def targets_of(rows, weights=(1, 2, 3), most=3):
    """Shares by weight, what lies above the most given to the others again and again, in exact fractions."""
    size = Counter()
    for _, retailer, text in rows:
        size[retailer] += len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    order = sorted((r for r in size if r is not None)) + [r for r in size if r is None]
    weight = {r: weights[n % len(weights)] for n, r in enumerate(order)}
    full: dict = {}
    while True:
        free = [r for r in order if r not in full]
        left = sum(size.values()) - sum(full.values())
        share = {r: Fraction(left * weight[r], sum(weight[x] for x in free)) for r in free}
        above = {r: Fraction(most * size[r]) for r in free if share[r] > most * size[r]}
        if not above:
            return size, share | full
        full |= above


def word(n):
    return " ".join(f"w{k}" for k in range(n))


CASES = {
    "even": [(i, f"r{i % 4}", word(5 + i % 7)) for i in range(200)],
    "hot": [(i, "big" if i % 3 else f"s{i}", word(i % 50)) for i in range(240)],
    "missing": [(None, None, word(3))] * 5 + [(None, "a", None), (1, "a", ""), (2, "b", " \t\n"), (3, "é", "x\x0by z q")],
    "wordless": [(1, "a", None), (2, "b", "")],
    "one": [(1, "a", word(10))],
    "none": [],
}


@pytest.mark.parametrize("case", CASES)
def test_targets_and_sizes_are_those_of_the_rounds(spark, case):
    rows = CASES[case]
    size, targets = targets_of(rows)
    found = mixing_plan(documents(spark, rows)).collect()
    assert len(found) == len(rows)
    for r in found:
        assert r.retailer_size == size[r.retailer_id]
        assert r.target == pytest.approx(float(targets[r.retailer_id]), rel=1e-12)
        assert r.rate == pytest.approx(float(targets[r.retailer_id] / size[r.retailer_id]) if size[r.retailer_id] else 0, rel=1e-12)
        assert r.copies in (int(r.rate), int(r.rate) + (r.rate > int(r.rate)))
        assert r.taken == r.copies * r.size <= 3 * r.size
    if size and sum(size.values()):
        assert sum(targets.values()) == sum(size.values())


def test_taken_words_come_near_the_targets_and_reruns_agree(spark, rows):
    given = [(i, f"r{i % 11}" if i % 3 else "hot", word(1 + i * 7919 % 90)) for i in range(12_000)]
    plan = mixing_plan(documents(spark, given))
    found = plan.collect()
    taken, target = Counter(), {}
    for r in found:
        taken[r.retailer_id] += r.taken
        target[r.retailer_id] = r.target
    assert all(abs(taken[r] - t) < 0.08 * t for r, t in target.items())
    again = mixing_plan(documents(spark, given[::-1]).repartition(7))
    assert rows(plan, "source_document_id", "taken") == rows(again, "source_document_id", "taken")
    other = mixing_plan(documents(spark, given), seed="other")
    assert rows(plan, "source_document_id", "taken") != rows(other, "source_document_id", "taken")


def test_the_mixture_holds_the_copies_with_all_columns(spark):
    given = CASES["hot"]
    mixed = mixed_documents(documents(spark, given))
    assert mixed.columns == ["source_document_id", "retailer_id", "text", "size", "_row", "copy"]
    held = Counter(r.source_document_id for r in mixed.collect())
    plan = {r.source_document_id: r.copies for r in mixing_plan(documents(spark, given)).collect()}
    assert held == Counter({i: n for i, n in plan.items() if n})
    assert {(r.size, r._row) for r in mixed.collect()} == {(7, "other")}


def test_other_weights_and_another_most(spark):
    given = CASES["even"]
    _, targets = targets_of(given, weights=(1, 5), most=2)
    found = {r.retailer_id: r.target for r in mixing_plan(documents(spark, given), weights=(1, 5), most=2).collect()}
    assert found == pytest.approx({r: float(t) for r, t in targets.items()})


def test_no_python_runs_on_the_executors(spark):
    plan = mixing_plan(documents(spark, CASES["even"]))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|Cartesian|NestedLoop", plan)
