import zlib
from collections import Counter

import pytest

from disclens.llm.sharding import shard_documents

SCHEMA = "source_document_id long, text string, shard int, slot long"


def shares(spark, rows, **options):
    documents = spark.createDataFrame([(*r, 99, None) for r in rows], SCHEMA)
    return shard_documents(documents, ring_bits=10, **options).collect()


def check(found, rows, shards):
    assert Counter((r[0], r.size, r.text_crc32) for r in found) == Counter(
        (i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows
    )
    counts = Counter(r.shard for r in found)
    assert set(counts) <= set(range(shards))
    sizes = [counts[s] for s in range(shards)]
    assert max(sizes) - min(sizes) <= 1
    for s in range(shards):
        assert sorted(r.slot for r in found if r.shard == s) == list(range(counts[s]))


@pytest.mark.parametrize(("n", "shards", "virtual_nodes"), [(0, 4, 8), (3, 16, 8), (500, 16, 16), (501, 7, 1), (90, 1, 4)])
def test_counts_are_at_most_one_apart_and_slots_gapless(spark, n, shards, virtual_nodes):
    rows = [(i, f"é{i}" if i % 3 else None) for i in range(n)]
    check(shares(spark, rows, shards=shards, virtual_nodes=virtual_nodes), rows, shards)


def test_missing_ids_and_repeated_rows(spark):
    rows = [(None, None)] * 20 + [(None, "a")] * 7 + [(5, "same")] * 30 + [(i, "") for i in range(40)]
    check(shares(spark, rows, shards=5), rows, 5)


def test_keys_stay_where_there_is_room_and_go_on_clockwise(spark):
    """Against placing the keys one by one: own shards first, then the waiting line around the ring."""
    from disclens.llm.sharding import ring, virtual_nodes_of
    from pyspark.sql import functions as F

    n, shards, bits = 200, 5, 10
    found = {r[0]: r for r in shares(spark, [(i, "x") for i in range(n)], shards=shards, virtual_nodes=3)}
    nodes = virtual_nodes_of(spark, shards, 3, bits)
    lap = sorted((r.node, r.shard) for r in nodes.collect())
    home = {r.cell: (r.node, r.shard) for r in ring(nodes, bits).collect()}
    keys = sorted((r.h % 2**64 >> (64 - bits), r.h, r.id) for r in spark.range(n).select("id", F.xxhash64("id").alias("h")).collect())
    load = Counter(home[c][1] for c, _, _ in keys)
    order = sorted(range(shards), key=lambda s: (-load[s], s))
    room = {s: n // shards + (k < n % shards) for k, s in enumerate(order)}
    held, waiting, expected = Counter(), {}, {}
    for cell, _, key in keys:
        node, shard = home[cell]
        if held[shard] < room[shard]:
            expected[key] = (shard, held[shard], False)
            held[shard] += 1
        else:
            waiting.setdefault((node, shard), []).append(key)
    line = []
    for first_lap in (True, False):
        for node in lap:
            line += waiting.get(node, []) if first_lap else []
            while line and held[node[1]] < room[node[1]]:
                expected[line.pop(0)] = (node[1], held[node[1]], True)
                held[node[1]] += 1
    assert {k: (r.shard, r.slot, r.moved) for k, r in found.items()} == expected


def test_a_further_shard_moves_few_documents(spark):
    rows = [(i, "x") for i in range(2000)]
    one = {r[0]: r.shard for r in shares(spark, rows, shards=8)}
    two = {r[0]: r.shard for r in shares(spark, rows, shards=9)}
    assert sum(one[i] != two[i] for i in one) < 0.45 * len(rows)
