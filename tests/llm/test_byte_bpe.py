import random

import public_tokenizers
import pytest
import tiktoken

from disclens.llm import byte_bpe
from disclens.llm.byte_bpe import LONGEST_FOLDED, cuckoo, encode_and_decode, merged, ranks_of

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
SCHEMA = "source_document_id long, text string, ids string, words string"


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks_of(PATH), special_tokens={})


def test_every_entry_lies_at_one_of_its_places():
    rng = random.Random(1)
    entries = [(n, (rng.randrange(256), rng.randrange(256))) for n in range(90)]
    table = cuckoo(entries, 8)
    assert all(n in (table[a], table[b]) for n, (a, b) in entries)
    with pytest.raises(ValueError):
        cuckoo([(n, (0, 1)) for n in range(3)], 8)


@pytest.mark.parametrize("characters, frequent", [(1, 5), (2_000, 0), (1 << 24, 100_000)])
def test_equals_the_library_and_decodes_to_the_text(spark, library, monkeypatch, characters, frequent):
    monkeypatch.setattr(byte_bpe, "FREQUENT_WORDS", frequent)
    rng = random.Random(2)
    alphabet = list("abcdefghijklmnopqrstuvwxyzABC  \n\n'\"\\,.-0123456789äöüßéñçàの日本語привет😀") + ["\x00", "\x01", " ", " ", "\x85", "\x1c", "'s", "<|endoftext|>", "́"]
    texts = [None, "", " ", "a", "\x01", "\x01\x01 \x01x", "'", "\\", "aa" * 700, "x" * 99, "don't I'LL we're '"]
    texts += ["".join(rng.choices(alphabet, k=rng.randint(1, 300))) for _ in range(60)]
    texts += [" ".join("".join(rng.choices("etaoinshr", k=rng.randint(1, 14))) for _ in range(200)) for _ in range(10)]
    rows = [(n, t, "x", "x") for n, t in enumerate(texts)] + [(None, texts[-1], "x", "x"), (3, "a", "x", "x")]
    found = encode_and_decode(spark.createDataFrame(rows, SCHEMA), PATH, public_tokenizers.PATTERN, characters).collect()
    assert len(found) == len(rows)
    for r in found:
        text = (texts[-1] if r[0] is None else texts[r[0]]) or ""
        ids = library.encode_ordinary(text)
        assert (r.ids, r.n_tokens, bytes(r.decoded)) == (",".join(map(str, ids)), len(ids), text.encode())


def test_very_long_words(spark, library):
    rng = random.Random(3)
    texts = ["".join(rng.choices("etaoinshr", k=100_000)), "a" * 100_000, "é" * (LONGEST_FOLDED // 2), "é" * (LONGEST_FOLDED // 2 + 1), "=" * 3_000 + " b"]
    found = encode_and_decode(spark.createDataFrame(list(enumerate(texts)), "source_document_id int, text string"), PATH, public_tokenizers.PATTERN)
    assert {r[0]: r.ids for r in found.collect()} == {n: ",".join(map(str, library.encode_ordinary(t))) for n, t in enumerate(texts)}


def test_the_heap_merges_as_the_library_does(library):
    rng = random.Random(4)
    for _ in range(300):
        word = "".join(rng.choices("abcdeöß日", k=rng.randint(2, 60)))
        own = ranks_of(PATH)
        if word.encode() not in own:
            assert merged(word.encode(), own) == library.encode_ordinary(word)


def test_empty_table(spark):
    assert encode_and_decode(spark.createDataFrame([], SCHEMA), PATH, public_tokenizers.PATTERN).collect() == []
