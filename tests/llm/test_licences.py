import re

from disclens.llm.licences import BASE_PHRASES, FAMILIES, detections, licence_notices, rules, spaced_words

SCHEMA = "source_document_id long, text string, labels string"


def labels(text):
    return [r.label for _, _, r in detections(spaced_words(text)[0])]


def test_hundreds_of_rules_each_behind_a_keyword():
    assert len(rules()) > 300 and all(r.keywords for r in rules())
    assert len({r.rank for r in rules()}) > 5 and rules()[-1].rank == max(r.rank for r in rules())


def test_every_family_is_found_in_every_version():
    for label, _, _, versions, words in FAMILIES:
        for v in versions:
            assert labels("SPDX license identifier " + words.replace("{v}", v)) == [label.replace("{v}", v.replace(" ", "."))]


def test_contained_detections_give_way():
    assert labels("Licensed under the Apache License, Version 2.0.") == ["apache-2.0"]
    assert labels("released under CC BY-NC-SA 4.0, all rights reserved") == ["cc-by-nc-sa-4.0", "reserved"]
    assert labels("the GNU Lesser General Public License") == ["lgpl"]
    assert labels("an attribution to no one") == []


def test_base_places_equal_a_plain_search(spark):
    texts = [
        "CC BY cc-by;  all rights reserved. All Rights\nReserved",
        "General Public Licenses; general public license général",
        "",
        None,
        "ccby cc  by\x00by",
        "all rights reserved " * 3,
    ]
    rows = [(n, t, "x") for n, t in enumerate(texts)] + [(None, texts[0], "x"), (0, texts[0], "x")]
    found = licence_notices(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(found) == len(rows)
    for r in found:
        text = texts[r[0] or 0] or ""
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), text))
        starts = [i for p in BASE_PHRASES for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
        assert (r.n_words, r.n_base) == (len(words), len(starts))
        assert (r.first_word, r.last_word) == ((min(starts), max(starts)) if starts else (None, None))
        assert set(r.base_labels) <= set(r.labels) and r.labels == sorted(set(r.labels)) and 0 <= r.score <= 1
        for d in r.detections:
            assert 0 <= d.first_word < d.first_word + d.n_words <= len(words)


def test_empty_table(spark):
    assert licence_notices(spark.createDataFrame([], SCHEMA)).collect() == []
