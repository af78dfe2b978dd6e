"""Long byte strings that occur more than once, through a logarithmic family of suffix arrays."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from disclens.llm.shared import ID, TEXT, source_text
from disclens.sources.staging import stage

MATCH_BYTES = 200
SEED_BYTES = 40
BATCHES = 4
FEW_RUNS = 16
SEGMENT = 1 << 22
SUFFIX = ["head", "tail"]
# A run names its suffix by the hash alone: no column that orders suffixes is carried on.
RUN = ["tail", "offset", "n_windows", "run_hash"]
ENTRY = "text_key long, head long, tail long, first int, offset int, n_windows int, run_hash long"
_ODD = [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F]


def suffix_entries(data: bytes, match: int = MATCH_BYTES, seed: int = SEED_BYTES) -> list[tuple[int, int, int, int, int, int]]:
    """The sampled suffixes of one text as ``(head, tail, first, offset, n_windows, run_hash)``.

    Of the suffixes that start in a ``match``-byte window and whose first
    ``seed`` bytes lie in it, the one with the least hash is the window's
    suffix, so equal windows have equal suffixes at equal offsets. Windows with
    one suffix are neighbours and make one entry: its first eight bytes and the
    hash of its first ``seed`` bytes, by which suffixes are ordered; the first
    window's start, the suffix's distance from it, the number of windows, and
    the hash of all their bytes.
    """
    found = []
    for base in range(0, max(0, len(data) - match + 1), SEGMENT):
        part = data[base : base + SEGMENT + match - 1]
        found += _segment_entries(part, base, match, seed)
    return found


def _segment_entries(part: bytes, base: int, match: int, seed: int) -> list[tuple[int, int, int, int, int, int]]:
    n, wide = len(part) - seed + 1, match - seed + 1
    padded = np.frombuffer(part + bytes(8), np.uint8)
    eight = np.empty(len(part) - 7, np.uint64)
    for i in range(8):
        views = padded[i : i + (len(eight) - i + 7) // 8 * 8].view("<u8")
        eight[i::8] = views[: len(eight[i::8])]
    hashed = np.zeros(n, np.uint64)
    for i in range(0, seed - 7, 8):
        hashed = (hashed ^ eight[i : i + n]) * np.uint64(_ODD[i // 8 % 5])
        hashed ^= hashed >> np.uint64(31)
    if seed % 8:
        hashed = (hashed ^ eight[seed - 8 : seed - 8 + n]) * np.uint64(_ODD[4])
        hashed ^= hashed >> np.uint64(31)
    least = (hashed & np.uint64(~0xFFFFFF & (2**64 - 1))) | np.arange(n, dtype=np.uint64)
    span = 1
    while 2 * span <= wide:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < wide:
        least = np.minimum(least[: len(least) - (wide - span)], least[wide - span :])
    at = (least & np.uint64(0xFFFFFF)).astype(np.int64)
    firsts = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    sizes = np.diff(np.append(firsts, len(at)))
    places = at[firsts]
    head = (eight[places].byteswap() ^ np.uint64(1 << 63)).view(np.int64).tolist()
    tail = hashed[places].view(np.int64).tolist()
    digest = xxhash.xxh3_64_intdigest
    made = []
    for h, t, first, size, place in zip(head, tail, firsts.tolist(), sizes.tolist(), places.tolist()):
        run = digest(part[first : first + size - 1 + match]) - (1 << 63)
        made.append((h, t, base + first, place - first, size, run))
    return made


def _entries(rows: DataFrame, match: int, seed: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["text_key", *SUFFIX, "first", "offset", "n_windows", "run_hash"]
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64()]
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                found, owner = [], []
                for i, text in enumerate(some.column(TEXT).to_pylist()):
                    own = suffix_entries(text.encode(), match, seed)
                    found += own
                    owner += [i] * len(own)
                if found:
                    who = pa.array(owner, pa.int64())
                    made = [pa.array(c, k) for c, k in zip(zip(*found), kinds)]
                    yield pa.RecordBatch.from_arrays([some.column("text_key").take(who), *made], names)

    return rows.select("text_key", TEXT).mapInArrow(run, ENTRY)


def suffix_level(entries: DataFrame) -> DataFrame:
    """The suffix array of a batch: its sampled suffixes in order, equal ones as one row with their number."""
    return stage(entries.groupBy(*SUFFIX).agg(F.count(F.lit(1)).alias("n")).sortWithinPartitions(*SUFFIX), "zstd")


def merged_level(one: DataFrame, other: DataFrame) -> DataFrame:
    """Two levels as the next larger one."""
    both = one.union(other).groupBy(*SUFFIX).agg(F.sum("n").alias("n"))
    return stage(both.sortWithinPartitions(*SUFFIX), "zstd")


def repeated_suffixes(entries: DataFrame, batches: int) -> DataFrame:
    """The sampled suffixes whose first bytes occur more than once, from arrays that come batch by batch.

    Each batch gets its suffix array and is merge-scanned against every level
    of the family; then it joins as a level of its own. Before a batch comes,
    levels of equal size are merged, so there are at most about ``log2`` of the
    number of batches, and a suffix is rewritten as often at most.
    """
    levels: list[tuple[int, DataFrame]] = []
    found = []
    for number in range(batches):
        while len(levels) > 1 and levels[-1][0] == levels[-2][0]:
            (size, newer), (_, older) = levels.pop(), levels.pop()
            levels.append((2 * size, merged_level(older, newer)))
        array = suffix_level(entries.where(F.pmod(F.xxhash64("text_key"), F.lit(batches)) == number))
        found.append(array.where("n > 1").select(*SUFFIX))
        if levels:
            held = reduce(DataFrame.union, [level.select(*SUFFIX) for _, level in levels])
            found.append(array.select(*SUFFIX).join(held, SUFFIX, "left_semi"))
        levels.append((1, array))
    return stage(reduce(DataFrame.union, found).distinct())


def _run_bytes(rows: DataFrame, open_runs: DataFrame, match: int) -> DataFrame:
    """``RUN`` columns, ``n``, ``n_runs`` and all bytes of each open run, read from one text that holds it."""
    by_text = open_runs.groupBy("place.text_key").agg(
        F.collect_list(F.struct(*RUN, "n", "n_runs", F.col("place.first").alias("first"))).alias("runs")
    )
    # Rows that repeat give their runs once each, of which the groups below take any.
    texts = rows.select("text_key", TEXT).join(by_text, "text_key").select(TEXT, "runs")
    names = [*RUN, "n", "n_runs"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
        for batch in batches:
            for i in range(batch.num_rows):
                data = batch.column(0)[i].as_py().encode()
                made = [
                    (*(r[c] for c in names), data[r["first"] : r["first"] + r["n_windows"] - 1 + match])
                    for r in batch.column(1)[i].as_py()
                ]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*made), kinds)], [*names, "bytes"])

    schema = "tail long, offset int, n_windows int, run_hash long, n long, n_runs long, bytes binary"
    return texts.mapInArrow(run, schema)


def common_windows(runs: list[tuple[int, int, int, bytes]], match: int) -> list[list[int]]:
    """For runs ``(offset, n_windows, n, bytes)`` of one suffix, the windows of each that occur again, as numbers.

    Two windows at equal offsets are equal if what the runs share before the
    suffix and after it reaches that far, so each pair of runs is compared once.
    """
    repeated = [set(range(size)) if n > 1 else set() for _, size, n, _ in runs]
    before = [data[:offset][::-1] for offset, _, _, data in runs]
    after = [data[offset:] for offset, _, _, data in runs]
    for i in range(len(runs)):
        for j in range(i):
            left, right = _alike(before[i], before[j]), _alike(after[i], after[j])
            low = max(match - right, *(runs[k][0] - runs[k][1] + 1 for k in (i, j)))
            high = min(left, runs[i][0], runs[j][0])
            for k in (i, j):
                repeated[k].update(range(runs[k][0] - high, runs[k][0] - low + 1))
    return [sorted(r) for r in repeated]


def _alike(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    return int(np.argmax(np.frombuffer(a, np.uint8, n) != np.frombuffer(b, np.uint8, n)))


def _windows_of_few(contents: DataFrame, match: int) -> DataFrame:
    """``RUN`` columns and repeated windows where a suffix has few runs: those are compared with each other."""
    few = contents.groupBy("tail").agg(F.collect_list(F.struct(*RUN, "n", "bytes")).alias("runs"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int32())]
        for batch in batches:
            made = []
            for runs in batch.column(0).to_pylist():
                found = common_windows([(r["offset"], r["n_windows"], r["n"], r["bytes"]) for r in runs], match)
                made += [(*(r[c] for c in RUN), own) for r, own in zip(runs, found) if own]
            columns = list(zip(*made)) or [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], [*RUN, "windows"])

    schema = "tail long, offset int, n_windows int, run_hash long, windows array<int>"
    return few.select("runs").mapInArrow(run, schema)


def _windows_of_many(contents: DataFrame, match: int) -> DataFrame:
    """The same where a suffix has many runs: their windows meet by hash, so no group of runs is gathered."""
    runs = contents.select(*RUN, "n", "bytes")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_64_intdigest
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                made = []
                for r in batch.slice(low, 256).to_pylist():
                    data, times, offset = r["bytes"], min(r["n"], 2), r["offset"]
                    for w in range(r["n_windows"]):
                        made.append((r["tail"], r["run_hash"], times, offset - w, digest(data[w : w + match]) - (1 << 63)))
                columns = [pa.array(c, k) for c, k in zip(zip(*made), kinds)]
                yield pa.RecordBatch.from_arrays(columns, ["tail", "run_hash", "times", "at", "window_hash"])

    schema = "tail long, run_hash long, times long, at int, window_hash long"
    windows = stage(runs.mapInArrow(run, schema))
    again = windows.groupBy("window_hash", "at").agg(F.sum("times").alias("times")).where("times > 1").drop("times")
    held = windows.drop("times").join(again, ["window_hash", "at"], "left_semi")
    by_run = held.groupBy("tail", "run_hash").agg(F.collect_set("at").alias("ats"))
    found = runs.select(*RUN).join(by_run, ["tail", "run_hash"])
    return found.select(*RUN, F.transform("ats", lambda a: F.col("offset") - a).alias("windows"))


def repeated_windows(rows: DataFrame, entries: DataFrame, repeated: DataFrame, match: int) -> DataFrame:
    """``(text_key, first, n_windows, windows)``: each entry's repeated windows, null for all.

    Entries with an equal run share all their windows, so a run that occurs
    twice is repeated as a whole. Where the runs of one suffix differ, one text
    of each run is read again and the runs are compared.
    """
    held = stage(entries.select("text_key", "tail", "first", "offset", "n_windows", "run_hash").join(repeated.select("tail"), "tail", "left_semi"), "zstd")
    place = F.struct("text_key", "first")
    runs = stage(held.groupBy(*RUN).agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("place")))
    mixed = runs.groupBy("tail").agg(F.count(F.lit(1)).alias("n_runs")).where("n_runs > 1")
    contents = stage(_run_bytes(rows, runs.join(mixed, "tail"), match), "zstd")
    few = _windows_of_few(contents.where(F.col("n_runs") <= FEW_RUNS), match)
    many = _windows_of_many(contents.where(F.col("n_runs") > FEW_RUNS), match)
    whole = runs.where("n > 1").select(*RUN)
    part = few.union(many).join(whole, RUN, "left_anti")
    # Written first, so that both sides of the join are plain shuffles, of which a hot run's part is split.
    marks = stage(whole.withColumn("windows", F.lit(None).cast("array<int>")).union(part))
    # A run's hash and its suffix tell the rest of it.
    return held.join(marks.select("tail", "run_hash", "windows"), ["tail", "run_hash"]).select("text_key", "first", "n_windows", "windows")


def remove_repeats(
    documents: DataFrame, match: int = MATCH_BYTES, seed: int = SEED_BYTES, batches: int = BATCHES
) -> DataFrame:
    """Every source document without the bytes that long repeats cover.

    ``documents(source_document_id, text)``; other columns are ignored. A byte
    goes if a string of ``match`` bytes that covers it also starts anywhere
    else, in this text or another; strings may overlap, never cross texts, and
    are judged on the input. Returns, for each row, ``source_document_id``;
    ``n_bytes`` of UTF-8; ``spans``: the maximal removed stretches as ``first``
    and ``n_bytes``; ``kept``: the remaining bytes.

    A missing text is empty; an empty or short text keeps all; rows that
    repeat are texts of their own, so they lose what they share; an empty
    table gives no rows. A text's spans are fewer than its bytes and are the
    only rows gathered, each text's by itself.
    """
    if not 8 <= seed < match:
        raise ValueError("a seed has eight bytes at least and fewer than a match")
    rows = source_text(documents).withColumn("text_key", F.xxhash64(ID, TEXT))
    entries = stage(_entries(rows, match, seed), "zstd")
    repeated = repeated_suffixes(entries, batches)
    marked = repeated_windows(rows, entries, repeated, match)
    by_text = marked.groupBy("text_key").agg(F.collect_set(F.struct("first", "n_windows", "windows")).alias("marks"))
    joined = rows.join(by_text, "text_key", "left").select(ID, TEXT, "marks")
    kind = rows.schema[ID].dataType.simpleString()
    schema = f"{ID} {kind}, n_bytes long, spans array<struct<first:long,n_bytes:long>>, kept binary"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        listed = pa.list_(pa.struct([("first", pa.int64()), ("n_bytes", pa.int64())]))
        for batch in batches:
            sizes, spans, kept = [], [], []
            for text, marks in zip(batch.column(1).to_pylist(), batch.column(2)):
                data = text.encode()
                own = covered(len(data), marks.as_py() or [], match)
                left, at = [], 0
                for first, n in own:
                    left.append(data[at:first])
                    at = first + n
                sizes.append(len(data))
                spans.append([{"first": f, "n_bytes": n} for f, n in own])
                kept.append(b"".join([*left, data[at:]]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(spans, listed), pa.array(kept, pa.binary())], [ID, "n_bytes", "spans", "kept"])

    return joined.mapInArrow(cut, schema)


def covered(size: int, marks: list[dict], match: int) -> list[tuple[int, int]]:
    """The maximal stretches that the marked windows cover, as first byte and length."""
    edge = np.zeros(size + 1, np.int64)
    for mark in marks:
        first, windows = mark["first"], mark["windows"]
        if windows is None:
            edge[first] += 1
            edge[first + mark["n_windows"] - 1 + match] -= 1
        else:
            starts = first + np.array(windows, np.int64)
            np.add.at(edge, starts, 1)
            np.add.at(edge, starts + match, -1)
    inside = np.concatenate([[0], (np.cumsum(edge[:-1]) > 0).astype(np.int8), [0]])
    turns = np.flatnonzero(np.diff(inside))
    return [(int(a), int(b - a)) for a, b in zip(turns[::2], turns[1::2])]
