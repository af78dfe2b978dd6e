"""Text quality by how well public vocabularies fit a document."""

from __future__ import annotations

import base64
import functools
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from disclens.llm.shared import ID, TEXT

SYMBOLS = "#*$%&|<>"
WINDOW_WORDS = 3
LEAST_WORDS = 50
MOST_REPEATED_PERCENT = 50
WORDS_KEPT = 400_000
WHITE = bytes([0x20, *range(0x09, 0x0E)]).decode()

# Rejection bands: the least characters per piece and per rank token, the most of either, the largest share of pieces
# that are single fallback bytes, and the least entropy of the pieces in bits.
BANDS = {
    "latin": (1.4, 1.4, 9.0, 0.10, 4.0),
    "greek": (0.4, 0.4, 9.0, 0.60, 3.5),
    "cyrillic": (0.4, 0.4, 9.0, 0.30, 4.0),
    "other": (0.2, 0.2, 9.0, 0.95, 3.0),
    "en": (1.6, 1.85, 9.0, 0.05, 4.5),
    "de": (1.6, 1.85, 9.0, 0.05, 4.5),
    "es": (1.5, 1.72, 9.0, 0.05, 4.5),
    "fr": (1.5, 1.72, 9.0, 0.05, 4.5),
}
SCRIPTS = (("latin", 0x0041, 0x024F), ("greek", 0x0370, 0x03FF), ("cyrillic", 0x0400, 0x052F))

FIELDS = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean,"
    " band string, piece_chars double, rank_chars double, byte_share double, bits double, kept boolean"
)


class Fit:
    """Token figures of words under a piece vocabulary and a rank vocabulary, remembered per word.

    Neither vocabulary merges across the start of a word, so a text's tokens
    are those of its words. At most ``WORDS_KEPT`` words, or
    those of one text, are remembered.
    """

    def __init__(self, piece_path: str, rank_path: str, pattern: str):
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=piece_path)
        with open(rank_path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.ranks = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.fallback = {i for i in range(self.pieces.vocab_size()) if self.pieces.is_byte(i)}
        self.ids: dict[str, list[int]] = {}
        self.n_ranks: dict[str, int] = {}

    def learn(self, words: set[str]) -> None:
        """Remember piece ids and number of rank tokens of those words that are new."""
        new = [w for w in words if w not in self.ids]
        if len(self.ids) + len(new) > WORDS_KEPT:
            self.ids.clear()
            self.n_ranks.clear()
            new = list(words)
        ranks = self.ranks.encode_ordinary
        self.ids.update(zip(new, self.pieces.encode(new, num_threads=1)))
        self.n_ranks.update((w, len(ranks(" " + w))) for w in new)


@functools.cache
def _fit(piece_path: str, rank_path: str, pattern: str) -> Fit:
    return Fit(piece_path, rank_path, pattern)


def words_of(text: str) -> list[str]:
    """The text's runs of characters other than ASCII white space."""
    return [w.decode() for w in text.encode().split()]


def base_figures(text: str, words: list[str]) -> tuple[int, int, int, int]:
    """Code points in words, symbols, lines with a word that repeat an earlier line, words in repeated windows."""
    white = sum(map(text.count, WHITE))
    symbols = sum(map(text.count, SYMBOLS))
    lines = text.split("\n")
    repeats = 0
    if len(lines) > 1:
        lines = [line for line in lines if line.strip(WHITE)]
        repeats = len(lines) - len(set(lines))
    return len(text) - white, symbols, repeats, _repeated_words(words)


def _repeated_words(words: list[str]) -> int:
    windows = list(zip(*(words[i:] for i in range(WINDOW_WORDS))))
    times = Counter(windows)
    if len(times) == len(windows):
        return 0
    hit = np.fromiter((times[w] > 1 for w in windows), bool, len(windows))
    covered = np.zeros(len(words), bool)
    for i in range(WINDOW_WORDS):
        covered[i : i + len(windows)] |= hit
    return int(covered.sum())


def band_of(text: str, language: str | None, bands: dict[str, tuple[float, ...]]) -> str:
    """The language's band where it has one, else that of the script most letters are in."""
    if language in bands:
        return language
    seen = Counter(text)
    sizes = {name: sum(n for c, n in seen.items() if lo <= ord(c) <= hi and c.isalpha()) for name, lo, hi in SCRIPTS}
    sizes["other"] = sum(n for c, n in seen.items() if c.isalpha()) - sum(sizes.values())
    return max(sizes, key=sizes.get)


def token_figures(words: list[str], word_chars: int, fit: Fit) -> tuple[float, float, float, float]:
    """Characters per piece, characters per rank token, share of fallback bytes, entropy in bits."""
    fit.learn(set(words))
    tokens = Counter(chain.from_iterable(map(fit.ids.__getitem__, words)))
    n_ranks = sum(map(fit.n_ranks.__getitem__, words))
    n_bytes = sum(tokens[i] for i in fit.fallback & tokens.keys())
    total = tokens.total()
    if not total:
        return 0.0, 0.0, 0.0, 0.0
    share = np.fromiter(tokens.values(), float, len(tokens)) / total
    return word_chars / total, word_chars / max(1, n_ranks), n_bytes / total, -float((share * np.log2(share)).sum())


def quality_figures(
    documents: DataFrame,
    piece_path: str,
    rank_path: str,
    pattern: str,
    language: str | None = None,
    bands: dict[str, tuple[float, ...]] | None = None,
) -> DataFrame:
    """Figures and verdict of each source document, read whole, in one pass without a shuffle.

    ``documents(source_document_id, text[, language])``; ``language`` names a
    column with the text's language where there is one. The vocabularies are
    files that every executor can read. Returns ``source_document_id`` and the
    columns of ``FIELDS``. ``base_failed``: under 50 words, or over half of
    them in three-word windows that occur more than once. ``kept`` is false
    for those, else whether the vocabulary figures lie in the band.

    A missing or empty text has no words and is not kept; an unknown or missing
    language is judged by its script; rows that repeat are judged one by one;
    an empty table gives no rows.
    """
    held = BANDS if bands is None else bands
    columns = [F.col(ID), F.coalesce(F.col(TEXT), F.lit("")).alias(TEXT)]
    columns.append((F.col(language) if language else F.lit(None)).cast("string").alias("language"))
    rows = documents.select(*columns)
    names = [f.split()[0] for f in FIELDS.split(", ")]
    kind = rows.schema[ID].dataType.simpleString()
    schema = f"{ID} {kind}, {FIELDS}"

    def judge(text: str, spoken: str | None, fit: Fit) -> tuple:
        words = words_of(text)
        chars, symbols, dup_lines, repeated = base_figures(text, words)
        failed = len(words) < LEAST_WORDS or 100 * repeated > MOST_REPEATED_PERCENT * len(words)
        band = band_of(text, spoken, held)
        least_piece, least_rank, most, most_bytes, least_bits = held[band]
        figures = token_figures(words, chars, fit)
        pieces, ranks, byte_share, bits = figures
        fits = pieces >= least_piece and ranks >= least_rank and max(pieces, ranks) <= most
        fits = fits and byte_share <= most_bytes and bits >= least_bits
        return len(words), chars, symbols, dup_lines, repeated, failed, band, *figures, fits and not failed

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fit = _fit(piece_path, rank_path, pattern)
        for batch in batches:
            texts, spoken = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            found = [judge(t, s, fit) for t, s in zip(texts, spoken)]
            columns = zip(*found) if found else [[] for _ in names]
            made = [pa.array(list(c), kind) for c, kind in zip(columns, kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *made], [ID, *names])

    arrow = {"long": pa.int64(), "boolean": pa.bool_(), "string": pa.string(), "double": pa.float64()}
    kinds = [arrow[f.split()[1]] for f in FIELDS.split(", ")]
    return rows.mapInArrow(run, schema)
