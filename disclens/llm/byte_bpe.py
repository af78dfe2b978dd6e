"""Byte-level BPE: merges folded over the distinct words of a block of texts, a merge of every word at a time."""

from __future__ import annotations

import base64
from collections import Counter
from collections.abc import Callable, Iterator
from functools import cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from disclens.llm.shared import ID, TEXT, rows_of, source_text
from disclens.sources.staging import stage

BLOCK_CHARACTERS = 1 << 22
# Rows held as Python values at a time.
ROWS_AT_ONCE = 128
FREQUENT_WORDS = 100_000
SAMPLED_DOCUMENTS = 16_000
LONGEST_FREQUENT = 64
LONGEST_FOLDED = 512
NO_RANK = 2147483647
PAIR_BITS = 18
_FACTORS = (1_640_531_527, 1_812_433_253)
_SHIFTS = (13, 23)


@cache
def ranks_of(rank_path: str) -> dict[bytes, int]:
    with open(rank_path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


def cuckoo(entries: list[tuple[int, tuple[int, int]]], bits: int) -> list[int]:
    """A table of ``2 ** bits`` places in which each entry lies at one of its two places; -1 is an empty place."""
    table, places = [-1] * (1 << bits), dict(entries)
    for entry, own in entries:
        at, moving = own[0], entry
        for _ in range(500):
            table[at], moving = moving, table[at]
            if moving == -1:
                break
            first, second = places[moving]
            at = second if at == first else first
        else:
            raise ValueError("the table is too full")
    return table


def _pair_places(key: int, bits: int = PAIR_BITS) -> tuple[int, int]:
    one, two = ((key * f >> s) & ((1 << bits) - 1) for f, s in zip(_FACTORS, _SHIFTS))
    return one, two


@cache
def pair_table(rank_path: str) -> np.ndarray:
    """The rank map: for each pair of tokens whose bytes make a token, pair and rank in one number, hashed."""
    ranks = ranks_of(rank_path)
    if len(ranks) > 1 << 16 or any(bytes([b]) not in ranks for b in range(256)):
        raise ValueError("a vocabulary of at most 65,536 tokens with all single bytes is needed")
    entries = []
    for token, rank in ranks.items():
        for cut in range(1, len(token)):
            left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
            if left is not None and right is not None:
                key = left << 16 | right
                entries.append((key << 16 | rank, _pair_places(key)))
    return np.array(cuckoo(entries, PAIR_BITS), np.int64)


def pair_ranks(left: np.ndarray, right: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """The rank of each pair of tokens; ``NO_RANK`` where they make no token."""
    key = left << 16 | right
    one, two = (pairs[key * f >> s & (1 << PAIR_BITS) - 1] for f, s in zip(_FACTORS, _SHIFTS))
    return np.where(one >> 16 == key, one & 65535, np.where(two >> 16 == key, two & 65535, NO_RANK))


def folded(words: list[bytes], single: np.ndarray, pairs: np.ndarray) -> list[str]:
    """The tokens of each word in decimal, joined by commas.

    ``single`` has the token of each byte, ``pairs`` is the rank map. A step
    takes the least rank in each word, the first of equal ones, puts the
    merged token there and looks its two new pairs up; words without a merge
    are left behind.
    """
    if not words:
        return []
    ids = single[np.frombuffer(b"".join(words), np.uint8)]
    owner = np.repeat(np.arange(len(words)), np.fromiter(map(len, words), np.int64, len(words)))
    # The rank of a token with the next one of its word.
    ranks = np.full(len(ids), NO_RANK, np.int64)
    inner = np.flatnonzero(owner[:-1] == owner[1:])
    ranks[inner] = pair_ranks(ids[inner], ids[inner + 1], pairs)
    ended = []
    while len(ids):
        first = np.flatnonzero(np.diff(owner, prepend=-1))
        least = np.minimum.reduceat(ranks << 32 | np.arange(len(ids)), first)
        merging = least >> 32 < NO_RANK
        live = np.repeat(merging, np.diff(first, append=len(ids)))
        ended.append((owner[~live], ids[~live]))
        at = (np.cumsum(live) - 1)[least[merging] & 0xFFFFFFFF]
        ids, owner, ranks = ids[live], owner[live], ranks[live]
        ids[at] = least[merging] >> 32
        kept = np.ones(len(ids), bool)
        kept[at + 1] = False
        ids, owner, ranks = ids[kept], owner[kept], ranks[kept]
        # One token went in each word before.
        at = at - np.arange(len(at))
        ranks[at] = NO_RANK
        for left in (at[at > 0] - 1, at[at + 1 < len(ids)]):
            left = left[owner[left] == owner[left + 1]]
            ranks[left] = pair_ranks(ids[left], ids[left + 1], pairs)
    owner, ids = (np.concatenate(x) for x in zip(*ended))
    ids = ids[np.argsort(owner, kind="stable")].astype(str).tolist()
    ends = np.cumsum(np.bincount(owner, minlength=len(words))).tolist()
    return [",".join(ids[a:b]) for a, b in zip([0, *ends], ends)]


def single_tokens(ranks: dict[bytes, int]) -> np.ndarray:
    return np.array([ranks[bytes([b])] for b in range(256)], np.int64)


def frequent_words(rows: DataFrame, rank_path: str, pattern: str) -> dict[str, str]:
    """The most frequent words of a bounded sample, with their ids in decimal joined by commas.

    They only spare folding the same word in many blocks and change no result.
    The sample has at most ``SAMPLED_DOCUMENTS`` texts and gives at most
    ``FREQUENT_WORDS`` words of up to ``LONGEST_FREQUENT`` bytes.
    """
    ranks = ranks_of(rank_path)
    drawn = rows.select(ID).distinct().orderBy(F.xxhash64(F.lit("draw"), ID), ID).limit(SAMPLED_DOCUMENTS)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, counts = regex.compile(pattern).findall, Counter()
        for (text,) in rows_of(batches, TEXT):
            counts.update(found(text))
        own = [(w, n) for w, n in counts.items() if len(e := w.encode()) <= LONGEST_FREQUENT and e not in ranks]
        yield pa.record_batch([pa.array([w for w, _ in own], pa.string()), pa.array([n for _, n in own], pa.int64())], names=["word", "n"])

    single, pairs = single_tokens(ranks), pair_table(rank_path)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            told = folded([w.encode() for w in batch.column("word").to_pylist()], single, pairs)
            yield pa.record_batch([batch.column("word"), pa.array(told, pa.string())], names=["word", "folded"])

    counted = rows.join(F.broadcast(drawn), ID).select(TEXT).mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    most = stage(counted.orderBy(F.desc("n"), "word").limit(FREQUENT_WORDS).select("word").repartition(64, "word"))
    listed = most.mapInArrow(fold, "word string, folded string").toArrow()
    return dict(zip(listed.column("word").to_pylist(), listed.column("folded").to_pylist()))


class Places(dict):
    """Where a word's ids are: a vocabulary token at ``-1 - rank``, any other word at its place among the block's words."""

    def __init__(self, ranks: dict[bytes, int], known: dict[str, str]):
        self.ranks, self.known = ranks, known
        self.told, self.fold = [], []

    def __missing__(self, word: str) -> int:
        text = self.known.get(word)
        if text is None:
            own = word.encode()
            rank = self.ranks.get(own)
            if rank is not None:
                self[word] = place = -1 - rank
                return place
            if len(own) > LONGEST_FOLDED:
                text = ",".join(map(str, merged(own, self.ranks)))
            else:
                self.fold.append(own)
        self.told.append(text)
        self[word] = place = len(self.told) - 1
        return place


def merged(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The tokens of one very long word: the same merges, the next one from a heap, so that the cost is that of a sort."""
    ends = list(range(1, len(word) + 1))
    before = list(range(-1, len(word) - 1))

    def pair(at: int) -> tuple[int, int, int] | None:
        if at < 0 or ends[at] >= len(word):
            return None
        end = ends[ends[at]]
        rank = ranks.get(word[at:end])
        return None if rank is None else (rank, at, end)

    waiting = [p for p in map(pair, range(len(word) - 1)) if p]
    heapify(waiting)
    while waiting:
        rank, at, end = heappop(waiting)
        if pair(at) != (rank, at, end):
            continue
        ends[ends[at]], ends[at] = len(word), end
        if end < len(word):
            before[end] = at
        for p in (pair(before[at]), pair(at)):
            if p:
                heappush(waiting, p)
    tokens, at = [], 0
    while at < len(word):
        tokens.append(ranks[word[at : ends[at]]])
        at = ends[at]
    return tokens


def encode_blocks(
    ranks: dict[bytes, int], pairs: np.ndarray, known: dict[str, str], pattern: str, characters: int
) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Blocks of whole texts: each text's ids in decimal, and the pieces of these ids one after another."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, single = regex.compile(pattern).findall, single_tokens(ranks)
        pieces = {str(rank): token for token, rank in ranks.items()}
        # Counted from the end, so that the place -1 - rank is the token of that rank.
        by_rank = [str(rank) for rank in range(max(ranks.values()), -1, -1)]
        kind, block, held, places = None, [], 0, Places(ranks, known)

        def whole_block() -> Iterator[pa.RecordBatch]:
            fold = iter(folded(places.fold, single, pairs))
            texts = [next(fold) if t is None else t for t in places.told]
            decoded = [b"".join(map(pieces.__getitem__, t.split(","))) for t in texts] + [pieces.get(r, b"") for r in by_rank]
            counts = np.array([t.count(",") + 1 for t in texts] + [1] * len(by_rank), np.int64)
            texts += by_rank
            for first in range(0, len(block), ROWS_AT_ONCE):
                some = block[first : first + ROWS_AT_ONCE]
                own = [at.tolist() for _, at in some]
                columns = [
                    pa.array([row for row, _ in some], kind),
                    pa.array([counts[at].sum() for _, at in some], pa.int64()),
                    pa.array([",".join(map(texts.__getitem__, at)) for at in own], pa.string()),
                    pa.array([b"".join(map(decoded.__getitem__, at)) for at in own], pa.binary()),
                ]
                yield pa.record_batch(columns, names=[ID, "n_tokens", "ids", "decoded"])

        for batch in batches:
            kind = batch.schema.field(ID).type
            parts = (batch.slice(at, ROWS_AT_ONCE) for at in range(0, batch.num_rows, ROWS_AT_ONCE))
            for row, text in rows_of(parts, ID, TEXT):
                words = found(text)
                block.append((row, np.fromiter(map(places.__getitem__, words), np.int32, len(words))))
                held += len(text)
                if held >= characters:
                    yield from whole_block()
                    block, held, places = [], 0, Places(ranks, known)
        if block:
            yield from whole_block()

    return encode


def encode_and_decode(documents: DataFrame, rank_path: str, pattern: str, characters: int = BLOCK_CHARACTERS) -> DataFrame:
    """Byte-level BPE tokens of every whole source text, and the bytes they decode to.

    ``documents(source_document_id, text)``; other columns are ignored.
    ``rank_path`` is a rank file that the driver can read, ``pattern`` the
    expression that splits texts before the merges; words are encoded apart,
    without special tokens. Returns ``(source_document_id, n_tokens, ids,
    decoded)``: the ids in decimal joined by commas, and the decoded bytes.

    A task takes its texts in blocks of about ``characters`` characters, or of
    one longer text. The distinct words of a block that are no token themselves
    are folded once, a merge of every word at a time over a hashed rank map, and
    their ids go to all their places in the block. No row leaves its task, so
    nothing is shuffled, and a lost executor costs its own blocks.

    A fold takes a step for each merge of its longest word: words of more than
    ``LONGEST_FOLDED`` bytes are merged from a heap in place of it, to the same
    tokens. A missing or empty text has no tokens; rows that repeat are encoded
    one by one; an empty table gives no rows.
    """
    ranks, rows = ranks_of(rank_path), source_text(documents)
    known = frequent_words(rows, rank_path, pattern)
    token = T.StructType().add(ID, documents.schema[ID].dataType).add("n_tokens", "long").add("ids", "string").add("decoded", "binary")
    return rows.mapInArrow(encode_blocks(ranks, pair_table(rank_path), known, pattern, characters), token)
