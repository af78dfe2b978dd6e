import hashlib
import random

import numpy as np
import pytest

from disclens.llm import suffix_levels
from disclens.llm.suffix_levels import covered, remove_repeats, suffix_entries

SCHEMA = "source_document_id long, text string, head string"


def directly(texts, match):
    """Removed bytes, spans and digest of each text, by counting every window."""
    times = {}
    for t in texts:
        for i in range(len(t) - match + 1):
            times[t[i : i + match]] = times.get(t[i : i + match], 0) + 1
    found = []
    for t in texts:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - match + 1):
            if times[t[i : i + match]] > 1:
                gone[i : i + match] = True
        kept = bytes(b for b, g in zip(t, gone) if not g)
        spans = int((np.diff(np.concatenate([[0], gone.astype(int), [0]])) == 1).sum())
        found.append((len(t), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return found


def removed(spark, texts, **options):
    documents = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], SCHEMA)
    rows = {r[0]: r for r in remove_repeats(documents, **options).collect()}
    return [
        (r.n_bytes, sum(s.n_bytes for s in r.spans), len(r.spans), hashlib.sha256(r.kept).hexdigest())
        for _, r in sorted(rows.items())
    ]


def test_windows_of_a_text_are_all_in_one_entry():
    data = bytes(random.Random(5).choices(b"abc", k=700)) + b"z" * 90
    entries = suffix_entries(data, 40, 12)
    starts = [first + i for _, _, first, _, n, _ in entries for i in range(n)]
    assert starts == list(range(len(data) - 40 + 1))
    assert all(0 <= offset <= 28 and offset - n + 1 >= 0 for _, _, _, offset, n, _ in entries)


@pytest.mark.parametrize("few", [1, 4, 16])
def test_equals_counting_every_window(spark, monkeypatch, few):
    monkeypatch.setattr(suffix_levels, "FEW_RUNS", few)
    rng = random.Random(9)
    word = lambda: "".join(rng.choices("aeiouäß", k=rng.randint(1, 6)))
    text = lambda n: " ".join(word() for _ in range(n))
    passages = [text(12) for _ in range(4)]
    texts = [None, "", "kurz", "é" * 120, passages[0] * 3]
    for _ in range(40):
        parts = [text(rng.randint(0, 15))]
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(passages)
            cut = rng.randint(0, len(p) // 2)
            parts += [p[cut : cut + rng.randint(20, len(p))], text(rng.randint(0, 6))]
        texts.append("".join(parts))
    texts += [texts[10], texts[11], texts[10] + texts[12]]
    expected = directly([(t or "").encode() for t in texts], 40)
    batches = {1: 4, 4: 1, 16: 5}[few]
    assert removed(spark, texts, match=40, seed=12, batches=batches) == expected


def test_repeated_rows_and_missing_ids_lose_what_they_share(spark):
    text = " ".join(f"line {i} of the answer" for i in range(40))
    rows = [(7, text, None), (7, text, None), (None, text[5:], None), (None, "only here " * 2, None)]
    found = remove_repeats(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r[0] or 0, len(r.spans), len(r.kept)) for r in found) == [(0, 0, 20), (0, 1, 0), (7, 1, 0), (7, 1, 0)]


def test_empty_table(spark):
    assert remove_repeats(spark.createDataFrame([], SCHEMA)).collect() == []


def test_covered_joins_touching_stretches():
    marks = [{"first": 2, "n_windows": 3, "windows": None}, {"first": 5, "n_windows": 9, "windows": [0, 8]}]
    assert covered(30, marks, 4) == [(2, 7), (13, 4)]
