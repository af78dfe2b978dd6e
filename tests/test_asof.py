import bisect
import random

import pytest
from pyspark.sql import functions as F

from disclens.operators.extract_text import offset_asof


def asof(spark, offsets, breaks):
    return offset_asof(
        spark.createDataFrame(offsets, "doc_id long, offset int"),
        spark.createDataFrame(breaks, "doc_id long, offset int, page string"),
        "page", F.lit("first"),
    )


@pytest.mark.parametrize("seed", range(3))
def test_as_bisection_of_each_document(spark, rows, seed):
    draw = random.Random(seed)
    # Nine of ten offsets are in one document.
    offsets = [(1 if draw.random() < 0.9 else draw.randrange(2, 9), draw.randrange(-3, 300)) for _ in range(3000)]
    breaks = sorted({(d, draw.randrange(300)) for d in range(1, 7) for _ in range(2 ** (d + seed))})
    known = {d: [o for e, o in breaks if e == d] for d in range(1, 9)}

    def page(doc, offset):
        n = bisect.bisect_right(known[doc], offset)
        return f"p{known[doc][n - 1]}" if n else "first"

    found = asof(spark, offsets, [(d, o, f"p{o}") for d, o in breaks])
    assert rows(found, "doc_id", "offset", "page") == sorted(((d, o, page(d, o)) for d, o in offsets), key=repr)


def test_no_breaks_missing_values_and_ties(spark, rows):
    assert rows(asof(spark, [(1, 5), (2, None)], []), "doc_id", "page") == [(1, "first"), (2, "first")]
    breaks = [(1, 0, "a"), (1, 3, None), (1, 4, "c"), (1, 4, "b"), (1, None, "z")]
    assert rows(asof(spark, [(1, o) for o in (-1, 0, 3, 4, 9)], breaks), "offset", "page") == sorted(
        [(-1, "first"), (0, "a"), (3, "a"), (4, "c"), (9, "c")], key=repr
    )


def test_no_window_over_a_document(spark):
    plan = asof(spark, [(1, 5)], [(1, 2, "a")])._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan
