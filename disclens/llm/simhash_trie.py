"""Near copies by SimHash: fingerprints meet in a self-join of their binary trie."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from disclens.llm.shared import ID, TEXT, components, rows_of, source_text
from disclens.sources.staging import stage

SHINGLE_WORDS = 3
BIT_BUDGET = 2
CELL_ROWS = 2048
STEP = 4
HASH_SEED = 42
HASHES_AT_ONCE = 1 << 16


def fingerprint(text: str, words: int = SHINGLE_WORDS) -> int:
    """The 64 majority bits of the hashes of a text's word shingles; zero for a text without words."""
    found = text.encode().lower().split()
    if not found:
        return 0
    digest, n = xxhash.xxh64_intdigest, max(1, len(found) - words + 1)
    set_bits = np.zeros(64, np.int64)
    for at in range(0, n, HASHES_AT_ONCE):
        end = min(n, at + HASHES_AT_ONCE)
        if n == 1:
            hashes = [digest(b" ".join(found), HASH_SEED)]
        else:
            part = found[at : end + words - 1]
            hashes = [digest(b" ".join(s), HASH_SEED) for s in zip(*(part[i:] for i in range(words)))]
        bits = np.unpackbits(np.array(hashes, np.uint64).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        set_bits += bits.sum(axis=0, dtype=np.int64)
    return sum(1 << int(i) for i in np.flatnonzero(2 * set_bits > n))


def fingerprints(documents: DataFrame, words: int = SHINGLE_WORDS) -> DataFrame:
    """``(source_document_id, fingerprint)`` of every document, the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = np.array([fingerprint(t, words) for t in batch.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(codes)], [ID, "fingerprint"])

    rows = source_text(documents)
    return rows.mapInArrow(run, f"{ID} {rows.schema[ID].dataType.simpleString()}, fingerprint long")


def _prefix(code: Column, depth: int) -> Column:
    return F.shiftrightunsigned(code, 64 - depth) if depth else F.shiftrightunsigned(F.shiftrightunsigned(code, 63), 1)


def trie_cells(codes: DataFrame, cell_rows: int) -> tuple[DataFrame, DataFrame]:
    """The trie's nodes down to subtrees of at most ``cell_rows`` codes, and the subtree of each code.

    A node with more codes than that is opened, however deep it lies, so a
    third of all codes under one long prefix still ends in small subtrees.
    Nodes: ``(depth, prefix, leaf)``; codes: ``(depth, prefix, code)``.
    """
    depth, rest, nodes, placed = 0, codes, [], []
    while True:
        keyed = rest.withColumn("prefix", _prefix(F.col("code"), depth))
        level = stage(
            keyed.groupBy("prefix").agg((F.count(F.lit(1)) <= cell_rows).alias("leaf")).withColumn("depth", F.lit(depth))
        )
        if depth == 64:
            level = level.withColumn("leaf", F.lit(True))
        nodes.append(level.select("depth", "prefix", "leaf"))
        split = stage(keyed.join(level, "prefix").select("depth", "prefix", "code", "leaf"))
        placed.append(split.where("leaf").drop("leaf"))
        rest = split.where("not leaf").select("code")
        if depth == 64 or rest.isEmpty():
            break
        depth += STEP
    union = lambda parts: parts[0] if len(parts) == 1 else parts[0].unionByName(union(parts[1:]))
    return union(nodes), union(placed)


def meeting_cells(nodes: DataFrame, budget: int) -> DataFrame:
    """Pairs of subtrees that may hold linked codes.

    The trie is walked by pairs of nodes together from the root; a pair goes on
    only while its prefixes differ in at most ``budget`` bits.
    """
    tree = nodes.select("depth", "prefix", "leaf")
    depths = [r[0] for r in tree.select("depth").distinct().orderBy("depth").collect()]
    side = lambda s: [F.col(c).alias(f"{c}_{s}") for c in ("depth", "prefix", "leaf")]
    root = tree.where("depth = 0")
    pairs = root.select(*side("a"), *side("b"))
    for depth in depths[1:]:
        below = tree.where(F.col("depth") == depth)
        for s in ("a", "b"):
            child = below.select(*[F.col(c).alias(f"{c}_n") for c in ("depth", "prefix", "leaf")])
            child = child.withColumn("parent", F.shiftrightunsigned("prefix_n", STEP))
            keep = [c for c in pairs.columns if not c.endswith(f"_{s}")]
            opened = pairs.where(f"not leaf_{s}").withColumn("same", F.lit(False) if s == "a" else F.col("same"))
            if s == "a":
                opened = opened.withColumn("same", F.expr("depth_a = depth_b and prefix_a = prefix_b"))
            opened = opened.join(child, F.col(f"prefix_{s}") == F.col("parent"))
            opened = opened.select(*keep, *[F.col(f"{c}_n").alias(f"{c}_{s}") for c in ("depth", "prefix", "leaf")], "same")
            closed = pairs.where(f"leaf_{s}")
            if s == "a":
                closed = closed.withColumn("same", F.lit(False))
            columns = ["depth_a", "prefix_a", "leaf_a", "depth_b", "prefix_b", "leaf_b", "same"]
            pairs = opened.select(*columns).union(closed.select(*columns))
        shared = F.least("depth_a", "depth_b")
        cut = lambda s: F.expr(f"shiftrightunsigned(prefix_{s}, cast(depth_{s} - least(depth_a, depth_b) as int))")
        differing = F.when(shared == 0, 0).otherwise(F.bit_count(cut("a").bitwiseXOR(cut("b"))))
        pairs = stage(pairs.where(differing <= budget).where("not same or prefix_a <= prefix_b").drop("same"))
    return pairs.select("depth_a", "prefix_a", "depth_b", "prefix_b")


def trie_links(a: np.ndarray, b: np.ndarray, budget: int, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Codes of ``a`` and ``b`` within ``budget`` bits; ``same``: both are one subtree, each pair once.

    Ranges of the sorted codes are the trie's nodes. Pairs of nodes go down one
    bit at a time, adding up differing bits; small ones are compared outright.
    """
    a, b = np.sort(a), np.sort(b)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    front = np.array([[0, len(a), 0, len(b), 0]], np.int64)
    for bit in range(63, -2, -1):
        if not len(front):
            break
        small = (front[:, 1] - front[:, 0]) * (front[:, 3] - front[:, 2]) <= (64 if bit >= 0 else 1 << 62)
        found.append(_compared(a, b, front[small], budget, same))
        front = front[~small]
        if bit < 0 or not len(front):
            break
        one = np.uint64(1 << bit)
        mask = np.uint64(~((1 << bit) - 1) & (2**64 - 1))
        mid_a = np.clip(np.searchsorted(a, (a[front[:, 0]] & mask) | one), front[:, 0], front[:, 1])
        mid_b = np.clip(np.searchsorted(b, (b[front[:, 2]] & mask) | one), front[:, 2], front[:, 3])
        lo_a, hi_a, lo_b, hi_b, used = front.T
        twin = same & (lo_a == lo_b) & (hi_a == hi_b)
        front = np.concatenate(
            [
                np.stack([lo_a, mid_a, lo_b, mid_b, used], 1),
                np.stack([mid_a, hi_a, mid_b, hi_b, used], 1),
                np.stack([lo_a, mid_a, mid_b, hi_b, used + 1], 1),
                np.stack([mid_a, hi_a, lo_b, mid_b, used + 1], 1)[~twin],
            ]
        )
        front = front[(front[:, 0] < front[:, 1]) & (front[:, 2] < front[:, 3]) & (front[:, 4] <= budget)]
    left, right = (np.concatenate(x) for x in zip(*found)) if found else (a[:0], b[:0])
    return left, right


def _compared(a: np.ndarray, b: np.ndarray, front: np.ndarray, budget: int, same: bool) -> tuple[np.ndarray, np.ndarray]:
    wide = front[:, 3] - front[:, 2]
    n = (front[:, 1] - front[:, 0]) * wide
    row = np.repeat(np.arange(len(front)), n)
    step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    i, j = front[row, 0] + step // wide[row], front[row, 2] + step % wide[row]
    near = np.bitwise_count(a[i] ^ b[j]) <= budget
    if same:
        near &= i < j
    return a[i[near]], b[j[near]]


def linked_codes(codes: DataFrame, budget: int = BIT_BUDGET, cell_rows: int = CELL_ROWS) -> DataFrame:
    """Pairs ``(code_a, code_b)`` of different codes of ``codes(code)`` within ``budget`` bits, each once.

    A code has at most 2,080 others within two bits, so the pairs are bounded by
    the codes. A task sees two subtrees of at most ``cell_rows`` codes each.
    """
    nodes, placed = trie_cells(codes, cell_rows)
    cells = meeting_cells(stage(nodes), budget)
    cells = stage(cells.withColumn("task", F.xxhash64("depth_a", "prefix_a", "depth_b", "prefix_b")))
    sides = []
    for s, flag in (("a", 0), ("b", 1)):
        meets = cells.where("depth_a <> depth_b or prefix_a <> prefix_b") if flag else cells
        meets = meets.select("depth_a", "prefix_a", "depth_b", "prefix_b", F.col(f"depth_{s}").alias("depth"), F.col(f"prefix_{s}").alias("prefix"))
        sides.append(placed.join(meets, ["depth", "prefix"]).select("depth_a", "prefix_a", "depth_b", "prefix_b", F.lit(flag).alias("side"), "code"))

    def meet(table: pa.Table) -> pa.Table:
        codes = table.column("code").to_numpy().astype(np.int64).view(np.uint64)
        right = table.column("side").to_numpy() == 1
        a, b = codes[~right], codes[right]
        same = not right.any()
        x, y = trie_links(a, a if same else b, budget, same)
        return pa.table({"code_a": pa.array(x.view(np.int64)), "code_b": pa.array(y.view(np.int64))})

    task = ["depth_a", "prefix_a", "depth_b", "prefix_b"]
    return sides[0].union(sides[1]).groupBy(*task).applyInArrow(meet, "code_a long, code_b long")


def near_copies(
    documents: DataFrame, words: int = SHINGLE_WORDS, budget: int = BIT_BUDGET, cell_rows: int = CELL_ROWS
) -> DataFrame:
    """Groups of source documents whose SimHash fingerprints are linked.

    ``documents(source_document_id long, text)``; other columns are ignored.
    Returns ``(source_document_id, fingerprint, component_id)``, one row for
    each input row: the fingerprint as a signed long, and the smallest id that
    links reach. Texts that are missing, empty or without words have
    fingerprint zero and link like any other; rows that repeat or share an id
    are one document; rows without an id take part in no link and belong to
    the group of their fingerprint. An empty table gives no rows.
    """
    found = stage(fingerprints(documents, words))
    held = stage(found.groupBy(F.col("fingerprint").alias("code")).agg(F.min(ID).alias("first_id")))
    links = linked_codes(held.select("code"), budget, cell_rows)
    left = held.select(F.col("code").alias("code_a"), F.col("first_id").alias("a"))
    right = held.select(F.col("code").alias("code_b"), F.col("first_id").alias("b"))
    edges = links.join(left, "code_a").join(right, "code_b").where("a is not null and b is not null").select("a", "b")
    groups = components(edges).distinct()
    of_code = held.join(groups, held["first_id"] == groups["node"], "left").select(
        F.col("code").alias("fingerprint"), F.coalesce("component", "first_id").alias("component_id")
    )
    # Written first, so that both sides of the join are plain shuffles, of which a hot fingerprint's part is split.
    return found.join(stage(of_code), "fingerprint").select(ID, "fingerprint", "component_id")
