import random

import numpy as np

from disclens.llm.toxicity import DEFAULT_PRIOR, _train, fit, toxicity

DOCUMENTS = "source_document_id long, text string, score string, toxic int"
MARKS = "source_document_id long, quality int, toxic int"
LEARN = "not (crc32(cast(source_document_id as string)) % 3 = 1)"


def letters(rng, n):
    words = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 7))) for _ in range(400)]
    rows = []
    for i in range(n):
        own, bad = rng.choices(words, k=rng.randint(20, 120)), i % 8 == 0
        if bad:
            for w in rng.choices(["vilely", "vilest", "crass!", "CRASS", "oafish"], k=rng.randint(2, 5)):
                own.insert(rng.randrange(len(own)), w)
        rows.append((i, " ".join(own), int(bad)))
    return rows


def test_held_out_accuracy_with_few_marks(spark):
    rows = letters(random.Random(4), 900)
    documents = spark.createDataFrame([(i, t, None, 0) for i, t, _ in rows], DOCUMENTS)
    marks = spark.createDataFrame([(i, 1, y) for i, _, y in rows if i % 2 == 0], MARKS)
    found = {r[0]: r for r in toxicity(documents, marks, LEARN).collect()}
    held = {r[0] for r in documents.where(f"not ({LEARN})").select("source_document_id").collect()}
    right = [found[i].predicted == y for i, _, y in rows if i in held]
    assert sum(right) / len(right) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in found.values())


def test_marks_of_the_held_out_part_change_nothing(spark):
    rows = letters(random.Random(5), 240)
    documents = spark.createDataFrame([(i, t, None, 0) for i, t, _ in rows], DOCUMENTS)
    marks = spark.createDataFrame([(i, 1, y) for i, _, y in rows], MARKS)
    turned = marks.selectExpr("source_document_id", "quality", f"if({LEARN}, toxic, 1 - toxic) as toxic")
    one, two = fit(documents, marks, LEARN), fit(documents, turned, LEARN)
    assert np.array_equal(one.features, two.features) and np.allclose(one.weights, two.weights)


def test_training_keeps_confirmed_examples_among_the_unlabelled_apart():
    rng = np.random.default_rng(1)
    x = (rng.random((1000, 6)) < 0.2).astype(np.float32)
    toxic = rng.random(1000) < 0.2
    x[:, 0] = toxic
    confirmed = x[toxic][:60]
    rows, positive = np.concatenate([confirmed, x]), np.arange(1060) < 60
    weights, bias = _train(rows, positive, 0.2, 3)
    assert weights[0] > 2 and bias < -1 and np.abs(weights[1:]).max() < weights[0] / 2


def test_odd_rows_and_empty_tables(spark):
    rows = [(1, None, None, 0), (2, "", None, 0), (None, "some text", None, 0), (2, "", None, 0), (3, "word", None, 0)]
    documents = spark.createDataFrame(rows, DOCUMENTS)
    none = spark.createDataFrame([], MARKS)
    found = toxicity(documents, none).collect()
    assert len(found) == 5 and all(abs(r.score - DEFAULT_PRIOR) < 1e-9 and r.predicted == 0 for r in found)
    odd = spark.createDataFrame([(77, None, 1), (None, 1, 1), (3, 1, None), (3, 1, 1), (1, 1, 1)], MARKS)
    assert len(toxicity(documents, odd).collect()) == 5
    assert toxicity(spark.createDataFrame([], DOCUMENTS), none).collect() == []
