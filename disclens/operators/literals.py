"""Very many literals looked up in very many lines, by the rarest piece of each.

A literal is met through one of its pieces of 1, 2, 4 or 8 bytes, read as a
number: the one whose bucket is least frequent in the lines. Tasks go through
the bytes of whole batches of lines at once and let through only lines that
hold a chosen piece, by a bit table of fixed size. What leaves a task is the few
lines that may hold a literal, never their words or pieces.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from disclens.sources.staging import stage

SIZES = (1, 2, 4, 8)
COUNT_BITS = 16
FILTER_BITS = 24
_SPREAD = np.uint64(0x9E3779B97F4A7C15)


def _bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all strings of a column in a row, and where each begins, the end last."""
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def _pieces(data: np.ndarray, size: int) -> np.ndarray:
    """The piece of ``size`` bytes at each offset, as a number."""
    keys, step = data.astype(np.uint64), 1
    while step < size and len(keys) > step:
        keys = keys[:-step] | (keys[step:] << np.uint64(8 * step))
        step *= 2
    return keys if step >= size else keys[:0]


def _bucket(keys: np.ndarray, size: int, bits: int) -> np.ndarray:
    return ((keys + np.uint64(size)) * _SPREAD) >> np.uint64(64 - bits)


def _within(at: np.ndarray, starts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Of pieces at ``at``, those that lie within one string, and which string."""
    row = np.searchsorted(starts, at, side="right") - 1
    inside = at + size <= starts[row + 1]
    return at[inside], row[inside]


def _listed(filter_bits: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from _pieces_of(batch, filter_bits)

    return pieces


def _pieces_of(batch: pa.RecordBatch, filter_bits: int) -> Iterator[pa.RecordBatch]:
    """All pieces of each needle, of the largest size that fits."""
    needles = batch.column(0)
    data, starts = _bytes_of(needles)
    lengths = np.diff(starts)
    for size, above in zip(SIZES, [*SIZES[1:], 1 << 62]):
        at, row = _within(np.arange(max(0, len(data) - size + 1)), starts, size)
        fits = (lengths[row] >= size) & (lengths[row] < above)
        keys = _pieces(data, size)[at[fits]]
        columns = [
            needles.take(pa.array(row[fits])),
            pa.array(np.full(len(keys), size, np.int32)),
            pa.array(_bucket(keys, size, COUNT_BITS).astype(np.int32)),
            pa.array(keys.view(np.int64)),
            pa.array(_bucket(keys, size, filter_bits).astype(np.int32)),
        ]
        yield pa.RecordBatch.from_arrays(columns, names=["needle", "size", "bucket", "key", "slot"])


def _counts(sizes: list[int]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = {size: np.zeros(1 << COUNT_BITS, np.int64) for size in sizes}
        for batch in batches:
            data, _ = _bytes_of(batch.column(0))
            for size in sizes:
                n[size] += np.bincount(_bucket(_pieces(data, size), size, COUNT_BITS).astype(np.int64), minlength=1 << COUNT_BITS)
        for size, own in n.items():
            held = np.flatnonzero(own)
            columns = [pa.array(np.full(len(held), size, np.int32)), pa.array(held.astype(np.int32)), pa.array(own[held])]
            yield pa.RecordBatch.from_arrays(columns, names=["size", "bucket", "n"])

    return count


def _candidates(table: np.ndarray, sizes: list[int], keys_of: list[str], filter_bits: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The lines that hold a piece of the bit table, each with its pieces."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            low = batch.column(batch.schema.get_field_index("low"))
            data, starts = _bytes_of(low)
            rows, found = [], []
            for size in sizes:
                keys = _pieces(data, size)
                slot = _bucket(keys, size, filter_bits)
                at = np.flatnonzero((table[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1)
                at, row = _within(at, starts, size)
                rows.append(row)
                found.append(keys[at])
            row, key = np.concatenate(rows), np.concatenate(found)
            if not len(row):
                continue
            pairs = np.unique(np.stack([row.astype(np.int64), key.view(np.int64)]), axis=1)
            lines, first = np.unique(pairs[0], return_index=True)
            keys = pa.ListArray.from_arrays(pa.array(np.append(first, pairs.shape[1]), pa.int32()), pa.array(pairs[1], pa.int64()))
            taken = batch.take(pa.array(lines))
            yield pa.RecordBatch.from_arrays([*taken.columns, keys], names=[*keys_of, "low", "keys"])

    return search


def literal_hits(
    lines: DataFrame,
    needles: DataFrame,
    keys: tuple[str, ...] = ("doc_id", "line_no"),
    texts: DataFrame | None = None,
    filter_bits: int = FILTER_BITS,
) -> DataFrame:
    """Which needles stand literally in which lines: ``(*keys, needle)``.

    ``lines(*keys, low)`` and ``needles(needle)`` are compared as they are; empty
    needles and missing lines give nothing, a needle is found once a line. The
    lines are read twice, first for how often pieces occur; ``texts(low)``, the
    texts they are cut from, serves for that where it is given. The driver holds
    a bit table of ``2 ** filter_bits`` bits, whatever the number of needles; if
    they fill it, more lines pass on to the join, and the result is the same.
    """
    listed = needles.where("needle <> ''").select("needle").distinct()
    pieces = stage(listed.mapInArrow(_listed(filter_bits), "needle string, size int, bucket int, key long, slot int"))
    sizes = sorted(r.size for r in pieces.select(F.col("size").alias("size")).distinct().collect())
    kept = lines.where(F.col("low").isNotNull())
    if not sizes:
        return kept.select(*keys, F.col("low").alias("needle")).where("false")
    counted = (kept if texts is None else texts.where("low is not null")).select("low").mapInArrow(_counts(sizes), "size int, bucket int, n long")
    often = counted.groupBy("size", "bucket").agg(F.sum("n").alias("n"))
    rated = pieces.join(often, ["size", "bucket"], "left").select("needle", F.coalesce("n", F.lit(0)).alias("n"), "key", "slot")
    best = rated.groupBy("needle").agg(F.min(F.struct("n", "key", "slot")).alias("best"))
    # A needle with a piece that no line has cannot stand anywhere.
    anchors = stage(best.where("best.n > 0").select("needle", F.col("best.key").alias("key"), F.col("best.slot").alias("slot")))
    table = np.zeros(1 << (filter_bits - 3), np.uint8)
    for r in anchors.groupBy(F.shiftright("slot", 3).alias("at")).agg(F.bit_or(F.expr("1 << (slot & 7)")).alias("bits")).toLocalIterator():
        table[r["at"]] = r["bits"]
    found = kept.select(*keys, "low").mapInArrow(
        _candidates(table, sizes, list(keys), filter_bits),
        ", ".join(f"{c} {t}" for c, t in kept.select(*keys).dtypes) + ", low string, keys array<long>",
    )
    met = found.select(*keys, "low", F.explode("keys").alias("key")).join(anchors.select("needle", "key"), "key")
    return met.where(F.contains("low", F.col("needle"))).select(*keys, "needle")
