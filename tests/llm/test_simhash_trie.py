import random
import re

import numpy as np
import xxhash

from disclens.llm.simhash_trie import fingerprint, linked_codes, near_copies, trie_links

SCHEMA = "source_document_id long, text string, fingerprint string, component_id int"


def slow_fingerprint(text):
    words = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m.group().lower(), text))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if hashes and 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def clustered(rng, n):
    """Codes of which a third share a long prefix, with near ones among them."""
    hot = rng.integers(0, 2**24, n // 3, dtype=np.uint64) | np.uint64(0xABCDEF << 40)
    base = np.concatenate([hot, rng.integers(0, 2**64, n, dtype=np.uint64)])
    near = base ^ (np.uint64(1) << rng.integers(0, 64, len(base), dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, len(base), dtype=np.uint64))
    return np.unique(np.concatenate([base, near]))


def all_pairs(codes):
    near = np.bitwise_count(codes[:, None] ^ codes[None, :]) <= 2
    return {frozenset((int(codes[i]), int(codes[j]))) for i, j in zip(*np.nonzero(np.triu(near, 1)))}


def test_fingerprint_equals_counting_bits():
    rng = random.Random(3)
    texts = ["", " \t\n", "One", "one two", "A b C d", "É é ß", "x" * 5000] + [" ".join(rng.choices(["a", "B", "cc", "dé"], k=n)) for n in (3, 4, 50, 999)]
    assert [fingerprint(t) for t in texts] == [slow_fingerprint(t) for t in texts]


def test_trie_links_equal_all_pairs():
    codes = clustered(np.random.default_rng(1), 300)
    a, b = trie_links(codes, codes, 2, True)
    assert len(a) == len(all_pairs(codes)) and {frozenset((int(x), int(y))) for x, y in zip(a, b)} == all_pairs(codes)
    left, right = codes[::2], codes[1::2]
    a, b = trie_links(left, right, 2, False)
    across = {p for p in all_pairs(codes) if len(p & set(map(int, left))) == 1}
    assert {frozenset((int(x), int(y))) for x, y in zip(a, b)} == across


def test_distributed_links_equal_all_pairs_with_a_hot_prefix(spark):
    codes = clustered(np.random.default_rng(2), 150)
    rows = spark.createDataFrame([(int(c),) for c in codes.view(np.int64)], "code long")
    found = linked_codes(rows, cell_rows=24).collect()
    unsigned = lambda x: x % 2**64
    pairs = [frozenset((unsigned(r.code_a), unsigned(r.code_b))) for r in found]
    assert len(pairs) == len(set(pairs)) and set(pairs) == all_pairs(codes)


def test_groups_of_documents(spark):
    rng = random.Random(5)
    long = " ".join("".join(rng.choices("abcdefgh", k=5)) for _ in range(400))
    other = " ".join("".join(rng.choices("abcdefgh", k=5)) for _ in range(400))
    rows = [(9, long), (4, long), (7, long.upper()), (3, other), (8, None), (6, ""), (2, " "), (None, long), (4, long)]
    documents = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    found = near_copies(documents, cell_rows=2).collect()
    assert len(found) == len(rows)
    groups = {(r[0], r.component_id) for r in found}
    assert groups == {(9, 4), (4, 4), (7, 4), (None, 4), (3, 3), (8, 2), (6, 2), (2, 2)}
    assert {r.fingerprint for r in found if r[0] in (8, 6, 2)} == {0}


def test_empty_table(spark):
    assert near_copies(spark.createDataFrame([], SCHEMA)).collect() == []
