import random

from disclens.llm.leaks import best_match, block_of, passages_in, pieces_of, words_of

DOCUMENTS = "source_document_id long, text string, item_id long, items string"
PASSAGES = "item_id long, text string, source string"


def slow_match(pattern, window):
    """The least edit distance to any stretch of the window, by the whole table."""
    row = [0] * (len(window) + 1)
    for i, x in enumerate(pattern, 1):
        row, before = [i], row
        for j, y in enumerate(window, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
    return min(row)


def test_bit_parallel_distance_equals_the_table():
    rng = random.Random(3)
    for _ in range(600):
        pattern = [rng.randint(1, 4) for _ in range(rng.randint(1, 90 if rng.random() < 0.1 else 12))]
        window = [rng.randint(0, 4) for _ in range(rng.randint(0, 40))]
        assert best_match(pattern, window)[0] == slow_match(pattern, window)


def test_pieces_cover_a_passage():
    for n in range(1, 70):
        for budget in range(0, n):
            cut = pieces_of(n, budget)
            assert len(cut) == budget + 1 and sum(k for _, k in cut) == n
            assert [a for a, _ in cut] == [sum(k for _, k in cut[:i]) for i in range(len(cut))]


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        at = rng.randrange(len(words) or 1)
        kind = rng.randrange(3)
        if not words or kind == 2:
            words.insert(at, "added")
        elif kind == 0:
            words[at] = "changed"
        else:
            del words[at]
    return words


def test_equals_comparing_every_passage_with_every_text(spark):
    rng = random.Random(7)
    vocabulary = ["".join(rng.choices("abcdefghij", k=3)) for _ in range(250)]
    items = [(n, " ".join(rng.choices(vocabulary, k=rng.randint(1, 45)))) for n in range(25)]
    texts = []
    for n in range(120):
        own = rng.choices(vocabulary, k=rng.randint(0, 60))
        if n % 2:
            own += edited(rng, items[rng.randrange(25)][1].split(), rng.randint(0, 12)) + rng.choices(vocabulary, k=5)
        texts.append(", ".join(own).upper() if n % 3 else " ".join(own))
    rows = [(n, t) for n, t in enumerate(texts)] + [(500, None), (501, ""), (None, items[3][1]), (4, texts[4])]
    documents = spark.createDataFrame([(*r, 1, "x") for r in rows], DOCUMENTS)
    passages = spark.createDataFrame([(*i, "s") for i in items] + [(None, "a b", "s"), (90, None, "s"), (91, "", "s"), (*items[0], "s")], PASSAGES)
    expected = []
    for doc, text in rows:
        words = words_of(text or "")
        for item, passage in items:
            own = words_of(passage)
            if (d := slow_match(own, words)) <= int(0.2 * len(own)):
                expected.append((doc or -1, item, d))
    for at_once in (1000, 7):
        found = passages_in(documents, passages, items_at_once=at_once).collect()
        assert len(found) == len(rows)
        assert sorted((r[0] or -1, i.item_id, i.distance) for r in found for i in r.items) == sorted(expected)
        assert all(r.n_items == len(r.items) and (r.least_distance is None) == (not r.items) for r in found)
    assert len(expected) > 40


def test_very_long_passage_and_empty_tables(spark):
    long = " ".join(f"w{i}" for i in range(3000))
    documents = spark.createDataFrame([(1, "x " * 5000 + long + " y", 1, "x")], DOCUMENTS)
    passages = spark.createDataFrame([(8, long.replace("w7 ", ""), "s")], PASSAGES)
    assert [(i.item_id, i.distance) for i in passages_in(documents, passages).first().items] == [(8, 1)]
    assert passages_in(documents, spark.createDataFrame([], PASSAGES)).first().n_items == 0
    assert passages_in(spark.createDataFrame([], DOCUMENTS), passages).collect() == []
    assert block_of([(1, "...")], 0.2).passages == []
