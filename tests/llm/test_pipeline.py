import hashlib
import random

import public_tokenizers
import pytest
import tiktoken

import corpus_pipeline
from disclens.llm import queries
from disclens.llm.byte_bpe import ranks_of

EXTRA = "doc_id long, text string, lang string, source string, n_chars long, removed int, items string, key_a long, _row int"
MARKS = "doc_id long, quality int, toxic int"


def prose(rng, n):
    return " ".join("".join(rng.choices("abcdefghijklmnop", k=rng.randint(3, 8))) for _ in range(n))


@pytest.fixture
def tables(spark, tmp_path):
    def write(texts, marks, items):
        rows = [(i, t, "en", "s", None if t is None else len(t), 1, "x", 2, 3) for i, t in texts]
        spark.createDataFrame(rows, EXTRA).write.parquet(f"{tmp_path}/documents.parquet")
        spark.createDataFrame(marks, MARKS).write.parquet(f"{tmp_path}/labels.parquet")
        spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
        return str(tmp_path)

    return write


def test_stages_take_effect_and_keep_clean_documents(spark, tables):
    rng = random.Random(5)
    texts = {i: prose(rng, 60) for i in range(60)}
    bad = [i for i in range(60) if i % 6 == 0]
    for i in bad:
        texts[i] += " vilest oafish crass vilest"
    item = prose(rng, 30)
    texts[7] += "\n" + item
    near = texts[8].split()
    near[5] = near[5] + "x"
    texts[61] = texts[8] + "\n" + prose(rng, 40)
    texts[62] = " ".join(near)
    texts |= {70: None, 71: "", 72: "short"}
    rows = [*texts.items(), (None, prose(rng, 20)), (9, texts[9])]
    marks = [(i, 1, int(i in bad)) for i in range(60)]
    sf = tables(rows, marks, [(1, item)])
    docs, sizes = spark.read.parquet(f"{sf}/documents.parquet"), []
    stages = {}
    for n, (name, step) in enumerate(corpus_pipeline.STAGES):
        before = docs
        docs = spark.createDataFrame(step(spark, docs, sf).collect(), None if n == 4 else EXTRA)
        if n < 4:
            assert docs.columns == before.columns
        stages[name] = {r.doc_id: r for r in docs.collect()}
        sizes.append(len(stages[name]))
    names = list(stages)
    assert names == ["toxicity", "line dedup", "SimHash near-dedup", "benchmark decontamination", "byte-level BPE"]
    kept = stages["toxicity"]
    clean = [i for i in range(60) if i not in bad]
    assert all(i in kept for i in clean) and {70, 71, 72, None, 61} <= set(kept)
    lines = stages["line dedup"]
    assert set(lines) == set(kept) and lines[61].text == texts[61].split("\n")[1] and lines[61].n_chars == len(lines[61].text)
    assert all(lines[i].text == texts[i] for i in clean)
    alone = stages["SimHash near-dedup"]
    assert [i for i in (70, 71, 62) if i in alone] in ([70], [62]) and None in alone
    assert set(clean) <= set(alone)
    held = stages["benchmark decontamination"]
    assert set(alone) - set(held) == {7}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks_of(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    for i, r in stages["byte-level BPE"].items():
        text = held[i].text or ""
        ids = library.encode_ordinary(text)
        assert r.n_tokens == len(ids) and r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()


def test_run_equals_its_stages_and_empty_tables_pass(spark, tables):
    sf = tables([], [], [])
    assert corpus_pipeline.run(spark, sf).collect() == []


def test_every_operator_has_its_query():
    numbers = sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES)
    assert numbers == list(range(1, 14)) and set(queries.CHECKS) <= set(queries.QUERIES)


def test_unlike_texts_of_one_id_stay_and_copies_without_an_id_go(spark):
    rng = random.Random(15)
    one, two, three = (prose(rng, 60) for _ in range(3))
    rows = [(1, one), (1, two), (1, two), (2, one), (None, three), (None, three), (None, two)]
    docs = spark.createDataFrame([(i, t, "en") for i, t in rows], "doc_id long, text string, lang string")
    kept = corpus_pipeline.drop_near_copies(spark, docs.repartition(3), "")
    assert kept.columns == docs.columns
    assert {(r.doc_id, r.text) for r in kept.collect()} == {(1, one), (1, two), (None, three)} and kept.count() == 3
