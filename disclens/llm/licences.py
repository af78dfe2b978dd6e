"""Licence notices in the text of source documents, by ordered signature rules."""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from disclens.llm.shared import ID, source_text

# The phrases whose places are always counted, and their labels.
BASE_PHRASES = {
    "cc by": "cc-by",
    "general public license": "gpl",
    "all rights reserved": "reserved",
}

# Signatures: label, keywords of which every text that holds the name has one, the name as words of a notice have it (a regular expression), the versions it comes in, and the
# identifier's words. "{v}" stands for the version's words.
FAMILIES = (
    ("apache-{v}", "apache", r"apache(?: software)?(?: foundation)? licen[sc]e(?: version)?(?: {v})", ("1 0", "1 1", "2 0"), "apache {v}"),
    ("mpl-{v}", "mozilla", r"mozilla public licen[sc]e(?: version)?(?: v)?(?: {v})", ("1 0", "1 1", "2 0"), "mpl {v}"),
    ("gpl-{v}", "gpl|general public", r"(?:gnu )?(?:gpl|general public licen[sc]e)(?: version)?(?: v)?(?: {v})", ("1", "2", "3"), "gpl {v} 0"),
    ("lgpl-{v}", "gpl|general public", r"(?:gnu )?(?:lgpl|(?:lesser|library) general public licen[sc]e)(?: version)?(?: v)?(?: {v})", ("2", "2 1", "3"), "lgpl {v}"),
    ("agpl-{v}", "gpl|general public", r"(?:gnu )?(?:agpl|affero general public licen[sc]e)(?: version)?(?: v)?(?: {v})", ("1", "3"), "agpl {v} 0"),
    ("epl-{v}", "eclipse", r"eclipse public licen[sc]e(?: version)?(?: v)?(?: {v})", ("1 0", "2 0"), "epl {v}"),
    ("cddl-{v}", "common development", r"common development and distribution licen[sc]e(?: version)?(?: {v})", ("1 0", "1 1"), "cddl {v}"),
    ("eupl-{v}", "european union", r"european union public licen[sc]e(?: version)?(?: v)?(?: {v})", ("1 0", "1 1", "1 2"), "eupl {v}"),
    ("artistic-{v}", "artistic", r"artistic licen[sc]e(?: version)?(?: {v})", ("1 0", "2 0"), "artistic {v}"),
    ("bsd-{v}-clause", "bsd", r"{v} clause bsd licen[sc]e", ("2", "3", "4"), "bsd {v} clause"),
    ("gfdl-{v}", "free documentation", r"(?:gnu )?free documentation licen[sc]e(?: version)?(?: {v})", ("1 1", "1 2", "1 3"), "gfdl {v}"),
    ("cc-by-{v}", "cc by|attribution", r"(?:creative commons )?(?:cc by|attribution)(?: {v})(?: international| unported)?", ("1 0", "2 0", "2 5", "3 0", "4 0"), "cc by {v}"),
    ("cc-by-sa-{v}", "cc by|attribution", r"(?:creative commons )?(?:cc by sa|attribution share ?alike)(?: {v})(?: international| unported)?", ("1 0", "2 0", "2 5", "3 0", "4 0"), "cc by sa {v}"),
    ("cc-by-nd-{v}", "cc by|attribution", r"(?:creative commons )?(?:cc by nd|attribution no ?derivatives)(?: {v})(?: international| unported)?", ("1 0", "2 0", "2 5", "3 0", "4 0"), "cc by nd {v}"),
    ("cc-by-nc-{v}", "cc by|attribution", r"(?:creative commons )?(?:cc by nc|attribution non ?commercial)(?: {v})(?: international| unported)?", ("1 0", "2 0", "2 5", "3 0", "4 0"), "cc by nc {v}"),
    ("cc-by-nc-sa-{v}", "cc by|attribution", r"(?:creative commons )?(?:cc by nc sa|attribution non ?commercial share ?alike)(?: {v})(?: international| unported)?", ("1 0", "2 0", "2 5", "3 0", "4 0"), "cc by nc sa {v}"),
    ("cc-by-nc-nd-{v}", "cc by|attribution", r"(?:creative commons )?(?:cc by nc nd|attribution non ?commercial no ?derivatives)(?: {v})(?: international| unported)?", ("1 0", "2 0", "2 5", "3 0", "4 0"), "cc by nc nd {v}"),
    ("apache", "apache", r"apache(?: software)? licen[sc]e", ("",), "apache"),
    ("mpl", "mozilla", r"mozilla public licen[sc]e", ("",), "mpl"),
    ("gpl", "gpl|general public", r"(?:gnu )?(?:gpl|general public licen[sc]e)", ("",), "gpl"),
    ("lgpl", "gpl|general public", r"(?:gnu )?(?:lgpl|(?:lesser|library) general public licen[sc]e)", ("",), "lgpl"),
    ("agpl", "gpl|general public", r"(?:gnu )?(?:agpl|affero general public licen[sc]e)", ("",), "agpl"),
    ("cc-by", "cc by|attribution", r"(?:creative commons attribution|cc by)", ("",), "cc by"),
    ("cc-by-sa", "cc by|attribution", r"(?:creative commons attribution share ?alike|cc by sa)", ("",), "cc by sa"),
    ("cc-by-nc", "cc by|attribution", r"(?:creative commons attribution non ?commercial|cc by nc)", ("",), "cc by nc"),
    ("cc-by-nd", "cc by|attribution", r"(?:creative commons attribution no ?derivatives|cc by nd)", ("",), "cc by nd"),
    ("cc0", "cc0|commons zero", r"(?:cc0(?: 1 0)?(?: universal)?|creative commons zero)", ("",), "cc0 1 0"),
    ("mit", "mit licen|expat", r"(?:mit|expat) licen[sc]e", ("",), "mit"),
    ("isc", "isc licen", r"isc licen[sc]e", ("",), "isc"),
    ("bsd", "bsd", r"(?:modified |simplified |new |original )?bsd(?: style)? licen[sc]e", ("",), "bsd"),
    ("zlib", "zlib", r"zlib(?: libpng)? licen[sc]e", ("",), "zlib"),
    ("bsl-1.0", "boost", r"boost software licen[sc]e", ("",), "bsl 1 0"),
    ("unlicense", "unlicense", r"(?:the )?unlicense", ("",), "unlicense"),
    ("ofl-1.1", "open font", r"sil open font licen[sc]e", ("",), "ofl 1 1"),
    ("odbl", "open database", r"open database licen[sc]e", ("",), "odbl 1 0"),
    ("proprietary", "proprietary|commercial licen", r"(?:proprietary|commercial) licen[sc]e", ("",), "proprietary"),
)

# How a notice names a licence, the most certain first: the rule's kind, its pattern around the name and its weight.
FORMS = (
    ("identifier", r"spdx licen[sc]e identifier {words}", 1.0),
    ("grant", r"(?:licen[sc]ed|released|distributed|available|published|shared) under (?:the )?(?:terms of )?(?:the |a |an )?{name}", 0.95),
    ("terms", r"under (?:the )?terms (?:and conditions )?of (?:the )?{name}", 0.9),
    ("name", r"{name}", 0.7),
)

# Notices that name no licence of the families; they stand after every form above.
LOOSE = (
    ("reserved", "reserved", r"all rights reserved", 0.6),
    ("copyright", "copyright", r"copyright(?: c)? (?:19|20)[0-9]{2}", 0.5),
    ("permission", "permission", r"permission is hereby granted(?: free of charge)?", 0.8),
    ("warranty", "warranty", r"(?:without warranty of any kind|provided as is)", 0.4),
    ("public-domain", "domain", r"(?:in|into|to) the public domain", 0.8),
    ("no-copying", "reproduced", r"(?:may|must) not be (?:copied|reproduced|redistributed)", 0.6),
    ("terms-of-use", "terms", r"terms of (?:use|service) apply", 0.4),
    ("license", "licen", r"(?:licensed under|under (?:the|a) licen[sc]e)", 0.3),
)
SPACED = bytes(32 if b < 0x30 or 0x3A <= b <= 0x40 or 0x5B <= b <= 0x60 or 0x7B <= b <= 0x7F else b for b in range(256))


class Rule(NamedTuple):
    """A signature: its label, rank (0 first), keywords of which one must occur, pattern over spaced words, weight."""

    label: str
    rank: int
    keywords: tuple[bytes, ...]
    pattern: re.Pattern[bytes]
    weight: float


@functools.cache
def rules() -> tuple[Rule, ...]:
    """All signatures in order: each family in each version, in each form, then the loose notices."""
    made = []
    for kind, (_, form, weight) in enumerate(FORMS):
        for label, keys, name, versions, words in FAMILIES:
            for v in versions:
                filled, ident = name.replace("{v}", v), words.replace("{v}", v)
                pattern = form.replace("{name}", f"(?:{filled})").replace("{words}", ident)
                gate = ("identifier" if "{words}" in form else keys).encode().split(b"|")
                rank = 2 * kind + (not v)
                made.append(Rule(label.replace("{v}", v.replace(" ", ".")), rank, tuple(gate), _compiled(pattern), weight))
    last = 2 * len(FORMS)
    made += [Rule(label, last, (key.encode(),), _compiled(p), weight) for label, key, p, weight in LOOSE]
    return tuple(made)


def _compiled(pattern: str) -> re.Pattern[bytes]:
    return re.compile(rb"(?<= )(?:" + pattern.encode() + rb")(?= )")


def spaced_words(text: str) -> tuple[bytes, int]:
    """The text's words in lower case (A-Z), each between single spaces, and how many there are."""
    words = text.encode().translate(SPACED).lower().split()
    return b" " + b" ".join(words) + b" " if words else b" ", len(words)


def places(words: bytes, phrase: str) -> list[int]:
    """The word numbers at which the phrase's words stand one after another."""
    needle, found, at, seen, before = f" {phrase} ".encode(), [], -1, 0, 0
    while (at := words.find(needle, at + 1)) >= 0:
        seen += words.count(b" ", before, at)
        before = at
        found.append(seen)
    return found


def detections(words: bytes) -> list[tuple[int, int, Rule]]:
    """What the rules find, without detections that lie inside one of a rule before them.

    A rule runs only where one of its keywords occurs. A detection gives way to
    one that contains it if the other's rank is before its own, or the ranks
    are equal and the other is longer or its rule stands first.
    """
    present: dict[bytes, bool] = {}
    found = []
    for order, rule in enumerate(rules()):
        for key in rule.keywords:
            if key not in present:
                present[key] = key in words
        if any(present[k] for k in rule.keywords):
            found += [(rule.rank, m.start(), -m.end(), order) for m in rule.pattern.finditer(words)]
    kept, start, reach = [], np.zeros(0, np.int64), np.zeros(0, np.int64)
    found.sort()
    for rank in sorted({f[0] for f in found}):
        own = []
        furthest = -1
        for f in (f for f in found if f[0] == rank):
            at = np.searchsorted(start, f[1], "right") - 1
            if -f[2] > furthest and (at < 0 or reach[at] < -f[2]):
                own.append(f)
            furthest = max(furthest, -f[2])
        kept += own
        merged = sorted((f[1], -f[2]) for f in kept)
        start = np.array([m[0] for m in merged], np.int64)
        reach = np.maximum.accumulate(np.array([m[1] for m in merged], np.int64)) if merged else start
    return [(s, -e, rules()[order]) for _, s, e, order in sorted(kept, key=lambda f: (f[1], f[2]))]


DETECTION = T.StructType([T.StructField(n, t) for n, t in (("label", T.StringType()), ("first_word", T.LongType()), ("n_words", T.LongType()), ("weight", T.DoubleType()))])


def licence_notices(documents: DataFrame) -> DataFrame:
    """Licence notices of every source document, read whole, in one pass without a shuffle.

    ``documents(source_document_id, text)``; other columns are ignored. Returns
    ``source_document_id``; ``n_words``; ``n_base``, ``first_word`` and
    ``last_word``: how often a base phrase occurs, and the first and last word
    at which one starts; ``base_labels``; ``labels``: those and the rules' own,
    sorted; ``detections``: what the rules keep, in text order; ``score``: the
    largest weight among them, at least 0.5 with a base phrase, else 0.

    A missing or empty text has no words, labels or detections and score 0;
    rows that repeat are scanned one by one; an empty table gives no rows.
    """
    rows = source_text(documents)
    kind = rows.schema[ID].dataType
    longs = ("n_words", "n_base", "first_word", "last_word")
    labels = T.ArrayType(T.StringType())
    schema = T.StructType(
        [T.StructField(ID, kind), *(T.StructField(n, T.LongType()) for n in longs), T.StructField("base_labels", labels)]
        + [T.StructField("labels", labels), T.StructField("detections", T.ArrayType(DETECTION)), T.StructField("score", T.DoubleType())]
    )
    arrow = [pa.int64()] * 4 + [pa.list_(pa.string())] * 2
    arrow.append(pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("n_words", pa.int64()), ("weight", pa.float64())])))
    arrow.append(pa.float64())

    def scan(text: str) -> tuple:
        words, n = spaced_words(text)
        hits = {phrase: places(words, phrase) for phrase in BASE_PHRASES}
        starts = [w for found in hits.values() for w in found]
        base = {BASE_PHRASES[p] for p, found in hits.items() if found}
        kept = detections(words)
        told, seen, before = [], 0, 0
        for start, end, rule in kept:
            seen += words.count(b" ", before, start)
            before = start
            told.append({"label": rule.label, "first_word": seen - 1, "n_words": words.count(b" ", start, end) + 1, "weight": rule.weight})
        score = max([0.5 if base else 0.0, *(d["weight"] for d in told)])
        all_labels = sorted(base | {d["label"] for d in told})
        return n, len(starts), min(starts, default=None), max(starts, default=None), sorted(base), all_labels, told, score

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [scan(t) for t in batch.column(1).to_pylist()]
            columns = zip(*found) if found else [[] for _ in arrow]
            made = [pa.array(list(c), t) for c, t in zip(columns, arrow)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *made], schema.names)

    return rows.mapInArrow(run, schema)
