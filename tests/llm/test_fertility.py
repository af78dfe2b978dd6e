import re
from collections import Counter

import public_tokenizers
import pytest

from disclens.llm.fertility import BANDS, band_of, base_figures, quality_figures, token_figures, words_of
from disclens.llm.fertility import Fit

SCHEMA = "source_document_id long, text string, language string, kept string"
PATHS = (
    public_tokenizers.path("piece_bpe_32k.model"),
    public_tokenizers.path("byte_bpe_multi_50k.tiktoken"),
    public_tokenizers.PATTERN,
)
LETTER = (
    "Thank you for your request of last month. We looked through our records of your visits and found the baskets that"
    " are listed below, each with its date, the store and what you paid. Some lines carry no price because the register"
    " did not keep one. If a number seems wrong to you, write to the address above and we will look again at the slip."
)


@pytest.fixture(scope="module")
def fit():
    return Fit(*PATHS)


def slow_base(text):
    words = re.findall("[^\x20\x09-\x0d]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    times, hit = Counter(windows), set()
    for i, w in enumerate(windows):
        if times[w] > 1:
            hit |= {i, i + 1, i + 2}
    lines, seen, repeats = text.split("\n"), set(), 0
    for line in lines:
        if re.search("[^\x20\x09-\x0d]", line):
            repeats += line in seen
            seen.add(line)
    return sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), repeats, len(hit)


def test_base_figures_equal_plain_counts():
    texts = ["", "\n\n", "a b a b a b", "x\x0by z\x85w\nx\x0by z\x85w\n \n \n", "# a | b\n# a | b\nc <d>", "a a a a a", LETTER + "\n" + LETTER]
    for text in texts:
        assert base_figures(text, words_of(text)) == slow_base(text)


def test_tokens_of_words_are_the_tokens_of_the_text(fit):
    for text in (LETTER, "Größe über 12 straße", "日本語 text 😀 mixed"):
        words = words_of(text)
        pieces = fit.pieces.encode(" ".join(words))
        chars, _, _, _ = base_figures(text, words)
        own = token_figures(words, chars, fit)
        assert own[0] == pytest.approx(chars / len(pieces))
        assert own[2] == pytest.approx(sum(fit.pieces.is_byte(i) for i in pieces) / len(pieces))
        assert own[1] == pytest.approx(chars / len(fit.ranks.encode_ordinary(" " + " ".join(words))))


def test_bands_by_language_and_script():
    assert band_of("hello", "en", BANDS) == "en"
    assert band_of("hello", None, BANDS) == band_of("hello", "xx", BANDS) == "latin"
    assert band_of("привет hi", None, BANDS) == "cyrillic"
    assert band_of("日本語", None, BANDS) == "other"


def test_verdicts(spark):
    noise = " ".join(w + "%%%***" for w in LETTER.split())
    rows = [
        (1, LETTER, "en", ""), (2, LETTER, None, ""), (3, noise, "en", ""), (4, "all the same words " * 40, "en", ""),
        (5, None, "en", ""), (6, "", None, ""), (7, "short text", "en", ""), (1, LETTER, "en", ""), (None, LETTER, "en", ""),
    ]
    found = quality_figures(spark.createDataFrame(rows, SCHEMA), *PATHS, language="language").collect()
    assert len(found) == len(rows)
    kept = {(r[0], r.base_failed, r.kept) for r in found}
    assert kept == {
        (1, False, True), (2, False, True), (3, False, False), (4, True, False), (5, True, False), (6, True, False),
        (7, True, False), (None, False, True),
    }


def test_empty_table(spark):
    assert quality_figures(spark.createDataFrame([], SCHEMA), *PATHS).collect() == []
