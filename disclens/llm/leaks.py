"""Reference passages found in documents within an edit budget."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from disclens.llm.shared import ID, TEXT, source_text
from disclens.sources.staging import stage

ERROR_SHARE = 0.2
ITEMS_AT_ONCE = 20_000
WORD = re.compile(r"\w+")
MIX = 0x9E3779B97F4A7C15


def words_of(text: str) -> list[str]:
    """Letters and digits of the text, in lower case."""
    return WORD.findall(text.lower())


def pieces_of(n_words: int, budget: int) -> list[tuple[int, int]]:
    """``budget + 1`` neighbouring stretches of a passage as ``(start, length)``: with so few errors, one stays whole."""
    cuts = [i * n_words // (budget + 1) for i in range(budget + 2)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def best_match(pattern: list[int], window: list[int]) -> tuple[int, int]:
    """The least edit distance between the pattern and any stretch of the window, and where that stretch ends.

    Bit-parallel after Myers: one machine word of any length holds the vertical
    steps of a whole column, and each word of the window costs a few operations.
    """
    m = len(pattern)
    masks: dict[int, int] = defaultdict(int)
    for i, word in enumerate(pattern):
        masks[word] |= 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    up, down, distance = full, 0, m
    best, end = m, 0
    for j, word in enumerate(window, 1):
        match = masks.get(word, 0)
        diagonal = (((match & up) + up) ^ up) | match | down
        right_up = down | (~(diagonal | up) & full)
        right_down = up & diagonal
        if right_up & top:
            distance += 1
        elif right_down & top:
            distance -= 1
        right_up = right_up << 1 & full
        right_down = right_down << 1 & full
        up = right_down | (~((match | down) | right_up) & full)
        down = right_up & (match | down)
        if distance < best:
            best, end = distance, j
    return best, end


class Block(NamedTuple):
    """Passages to look for together: their words by number, and per piece length the hashes of pieces in order."""

    numbers: dict[str, int]
    passages: list[tuple[object, list[int], int]]
    pieces: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]


def block_of(items: list[tuple[object, str]], error_share: float) -> Block:
    numbers: dict[str, int] = {}
    passages, by_length = [], defaultdict(list)
    for item, text in items:
        words = [numbers.setdefault(w, len(numbers) + 1) for w in words_of(text)]
        if not words:
            continue
        budget = int(error_share * len(words))
        for start, length in pieces_of(len(words), budget):
            if length:
                piece = np.array(words[start : start + length], np.uint64)
                by_length[length].append((int(_hashes(piece, length)[0]), len(passages), start))
        passages.append((item, words, budget))
    pieces = {}
    for length, rows in by_length.items():
        rows.sort()
        pieces[length] = (np.array([r[0] for r in rows], np.uint64), np.array([r[1] for r in rows]), np.array([r[2] for r in rows]))
    return Block(numbers, passages, pieces)


def _hashes(words: np.ndarray, length: int) -> np.ndarray:
    """A hash of every stretch of ``length`` word numbers."""
    n = len(words) - length + 1
    if n <= 0:
        return words[:0]
    made = np.zeros(n, np.uint64)
    for i in range(length):
        made = (made ^ words[i : i + n]) * np.uint64(MIX)
        made ^= made >> np.uint64(29)
    return made


def found_in(text: str, block: Block) -> list[tuple[object, int, int]]:
    """``(item, distance, last word)`` of the passages that a text holds within their budget, the best place of each."""
    words = np.array([block.numbers.get(w, 0) for w in words_of(text)], np.uint64)
    if not words.any():
        return []
    spots: dict[int, set[int]] = defaultdict(set)
    for length, (hashes, owner, offset) in block.pieces.items():
        own = _hashes(words, length)
        if not len(own):
            continue
        low = np.searchsorted(hashes, own)
        for at in np.flatnonzero(hashes[np.minimum(low, len(hashes) - 1)] == own):
            k = low[at]
            while k < len(hashes) and hashes[k] == own[at]:
                spots[int(owner[k])].add(int(at) - int(offset[k]))
                k += 1
    found = []
    for which, starts in sorted(spots.items()):
        item, pattern, budget = block.passages[which]
        best = None
        for low, high in _stretches(starts, len(pattern), budget, len(words)):
            distance, end = best_match(pattern, words[low:high].tolist())
            if distance <= budget and (best is None or distance < best[0]):
                best = (distance, low + end - 1)
        if best:
            found.append((item, *best))
    return found


def _stretches(starts: set[int], n: int, budget: int, size: int) -> Iterator[tuple[int, int]]:
    """The parts of a text in which passages suspected at the starts may lie; parts that overlap are one."""
    low = high = None
    for start in sorted(starts):
        a, b = max(0, start - budget), min(size, start + n + budget)
        if high is not None and a <= high:
            high = max(high, b)
        else:
            if high is not None:
                yield low, high
            low, high = a, b
    if high is not None:
        yield low, high


def passages_in(
    documents: DataFrame, passages: DataFrame, error_share: float = ERROR_SHARE, items_at_once: int = ITEMS_AT_ONCE
) -> DataFrame:
    """Which reference passages every source document holds, whole documents against all passages.

    ``documents(source_document_id, text)``, ``passages(item_id, text)``; other
    columns are ignored. The records hold no reference passages of their own,
    so those are a parameter. A passage of ``m`` words may differ in
    ``int(error_share * m)`` words that are changed, missing or added. It is cut
    into one piece more than that; each piece that stands in a document word
    for word is a suspicion, and the edit distance decides.

    Returns a row for each document: ``source_document_id``; ``items``: the
    passages' ids, sorted, with their ``distance`` and ``last_word`` there;
    ``n_items``; ``least_distance``, or null. Passages go to the tasks in
    blocks of about ``items_at_once``, each a scan of the documents, so what a
    task holds does not grow with the passages.

    Texts or passages that are missing, empty or without words match nothing;
    passages that repeat or share an id count once per id and document; rows
    without an item id are left out; documents that repeat are searched one by
    one; an empty table of either gives no matches.
    """
    found = None
    for search in searches(passages, error_share, items_at_once):
        rows = source_text(documents).select(ID, F.xxhash64(TEXT).alias("text_key"), search(F.col(TEXT)).alias("items"))
        if found is None:
            found = rows
            continue
        found = stage(found)
        more = rows.where(F.size("items") > 0).distinct().select(F.col(ID).alias("other_id"), F.col("text_key").alias("other_key"), F.col("items").alias("more"))
        same = F.col(ID).eqNullSafe(F.col("other_id")) & (F.col("text_key") == F.col("other_key"))
        both = F.array_sort(F.concat("items", F.coalesce("more", F.array().cast(found.schema["items"].dataType))))
        found = found.join(more, same, "left").select(ID, "text_key", both.alias("items"))
    return found.select(
        ID,
        "items",
        F.size("items").cast("long").alias("n_items"),
        F.array_min(F.transform("items", lambda i: i["distance"])).alias("least_distance"),
    )


def searches(
    passages: DataFrame, error_share: float = ERROR_SHARE, items_at_once: int = ITEMS_AT_ONCE
) -> Iterator[Callable[[Column], Column]]:
    """For each block of passages, the passages found in a column of texts as an array, smallest id first."""
    wanted = passages.where("item_id is not null and text is not null").select("item_id", "text").distinct()
    n_blocks = max(1, -(-wanted.count() // items_at_once))
    kind = wanted.schema["item_id"].dataType.simpleString()
    for n in range(n_blocks):
        some = wanted.where(F.pmod(F.xxhash64("item_id"), F.lit(n_blocks)) == n).collect()
        block = block_of(sorted((r[0], r[1]) for r in some), error_share)
        yield _search_of(wanted.sparkSession.sparkContext.broadcast(block), kind)


def _search_of(block: Broadcast, kind: str) -> Callable[[Column], Column]:
    typed = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind]
    listed = pa.list_(pa.struct([("item_id", typed), ("distance", pa.int32()), ("last_word", pa.int32())]))

    @F.arrow_udf(f"array<struct<item_id:{kind},distance:int,last_word:int>>")
    def search(texts: pa.Array) -> pa.Array:
        found = []
        for text in texts.to_pylist():
            best: dict[object, tuple[int, int]] = {}
            for item, distance, last in found_in(text or "", block.value):
                best[item] = min(best.get(item, (distance, last)), (distance, last))
            found.append([{"item_id": i, "distance": d, "last_word": w} for i, (d, w) in sorted(best.items())])
        return pa.array(found, listed)

    return search
