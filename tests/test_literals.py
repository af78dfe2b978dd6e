import random

import pytest

from disclens.operators.governance import denylist_hits
from disclens.operators.literals import literal_hits


def lines_of(spark, texts):
    return spark.createDataFrame([(i, 1, t, "x") for i, t in enumerate(texts)], "doc_id long, line_no int, low string, key string")


def needles_of(spark, listed):
    return spark.createDataFrame([(n,) for n in listed], "needle string")


def brute_force(texts, listed):
    return sorted({(i, 1, n) for i, t in enumerate(texts) for n in listed if n and t is not None and n in t})


def random_case(seed):
    draw = random.Random(seed)
    alphabet = "ab é价-1" if seed % 2 else "abc"
    text = lambda most: "".join(draw.choice(alphabet) for _ in range(draw.randrange(most)))
    texts = [text(60) for _ in range(300)] + [None, "", "a"]
    listed = [text(14) for _ in range(80)] + [t[5:30] for t in texts[:20]] + ["", None, "a", "é"]
    return texts, listed


@pytest.mark.parametrize("seed", range(6))
def test_hits_are_those_of_brute_force(spark, rows, seed):
    # A small table lets lines through that hold nothing; the join sorts them out.
    bits = 5 if seed % 3 == 0 else 24
    texts, listed = random_case(seed)
    found = literal_hits(lines_of(spark, texts).repartition(3), needles_of(spark, listed), filter_bits=bits)
    assert rows(found, "doc_id", "line_no", "needle") == sorted(brute_force(texts, listed), key=repr)


def test_nothing_listed_nothing_read_and_no_needle_present(spark):
    assert literal_hits(lines_of(spark, ["a"]), needles_of(spark, ["", None])).collect() == []
    assert literal_hits(lines_of(spark, []).limit(0), needles_of(spark, ["a"])).collect() == []
    assert literal_hits(lines_of(spark, ["abc"]), needles_of(spark, ["zzzzzzzzzz"])).collect() == []


def test_parts_of_words_whole_words_and_hot_pieces(spark, rows):
    texts = ["lorem ipsum 2003-01-15 dolor"] * 400 + ["on 2003-01-16 and 2003-02-15", "unbreakable xyz", "UNBREAKABLE"]
    docs = spark.createDataFrame([(i, 1, t) for i, t in enumerate(texts)], "doc_id long, n int, text string")
    found = denylist_hits(docs, needles_of(spark, ["2003-01-16", " Break ", "ABLE XY", "em ip"]))
    assert rows(found.where("needle <> 'em ip'"), "doc_id", "needle") == [(400, "2003-01-16"), (401, "able xy"), (401, "break"), (402, "break")]
    assert found.where("needle = 'em ip'").count() == 400


def test_only_lines_with_a_rare_piece_leave_a_task(spark):
    """Dates share most of their pieces; the piece that tells them apart is the one that is met."""
    texts = [f"seen on 2003-{m:02}-{d:02} again" for m in range(1, 13) for d in range(1, 29)]
    needles = needles_of(spark, ["2003-05-29", "2003-13-01", "2003-07-14"])
    found = literal_hits(lines_of(spark, texts), needles)
    assert [r.needle for r in found.collect()] == ["2003-07-14"]
    plan = found._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("Generate explode") <= 1 and "Cartesian" not in plan and "NestedLoop" not in plan
