import random
import re
import subprocess
import sys
from collections import Counter, defaultdict

import pyarrow as pa
import pytest

from disclens.llm.divergence import retailer_divergence

SCHEMA = "source_document_id long, statute string, retailer_id string, text string, term string, n int"
COLUMNS = ("statute", "retailer_id", "part", "item", "value", "rank")


def documents(spark, rows):
    return spark.createDataFrame([(i, *r, "x", 1) for i, r in enumerate(rows)], SCHEMA)


def brute_force(rows, least, top=50):
    groups, held = defaultdict(Counter), defaultdict(Counter)
    for statute, retailer, text in rows:
        plain = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", plain)
        groups[statute or "", retailer or ""].update(terms)
        held[statute or ""].update(set(terms))
    out = []
    for statute in held:
        kept = sorted(t for t, n in held[statute].items() if n >= least)
        own = {r: c for (s, r), c in groups.items() if s == statute}
        whole = sum(own.values(), Counter())
        share = lambda c: {t: 1 + 10**9 * (c[t] + 5) // (sum(c[x] for x in kept) + 5 * len(kept)) for t in kept}
        shares, q = {r: share(c) for r, c in own.items()}, share(whole)
        for r, p in shares.items():
            pair = [(o, sum(abs(p[t] - other[t]) for t in kept)) for o, other in shares.items() if o != r]
            term = [(t, p[t] - q[t]) for t in kept if own[r][t] and p[t] > q[t]]
            for part, found, most in (("pair", pair, None), ("term", term, top)):
                order = sorted(found, key=lambda f: (-f[1], f[0].encode()))[:most]
                out += [(statute, r, part, item, value, n) for n, (item, value) in enumerate(order, 1)]
    return sorted(out, key=repr)


def texts(seed, n=400):
    draw = random.Random(seed)
    words = [*(f"Word{c}" for c in "abcdefghijkl"), "É", "naïve", "цена", "价格", "a-b", "x1y"]
    rows = []
    for _ in range(n):
        statute = draw.choice(["CCPA", "CCPA", "TDPSA", None])
        retailer = draw.choice(["north", "north", "north", "east", "süd", None, "lone" if statute else "none"])
        rows.append((statute, retailer, " ".join(draw.choice(words[: 6 + 12 * (retailer == "east")]) for _ in range(draw.randrange(12)))))
    return rows


@pytest.mark.parametrize(("group_block", "term_block", "least"), [(16, 2048, 5), (1, 1, 3), (2, 3, 30), (3, 2, 1000)])
def test_equals_brute_force_whatever_the_blocks(spark, rows, group_block, term_block, least):
    given = texts(group_block)
    found = retailer_divergence(documents(spark, given), least_documents=least, top=4, group_block=group_block, term_block=term_block)
    assert rows(found, *COLUMNS) == brute_force(given, least, top=4)


def test_missing_texts_wordless_groups_and_hot_retailers(spark, rows):
    given = [("CCPA", "hot", "same words here")] * 900 + [("CCPA", "silent", None), ("CCPA", "signs", "12 -- 3"), (None, None, None), ("", "", "same")]
    given += [("CCPA", f"r{k}", f"same k{k}") for k in range(25)]
    found = retailer_divergence(documents(spark, given), least_documents=20, group_block=4, term_block=2)
    assert rows(found, *COLUMNS) == brute_force(given, 20)


def test_empty_table_and_a_single_group(spark, rows):
    assert rows(retailer_divergence(documents(spark, []).limit(0)), *COLUMNS) == []
    assert rows(retailer_divergence(documents(spark, [("CCPA", "a", "x")]), least_documents=1), *COLUMNS) == []


def test_parts_that_fill_up_are_passed_on(spark, rows, monkeypatch):
    monkeypatch.setattr("disclens.llm.divergence.ENTRIES_HELD", 5)
    given = texts(9, 150)
    assert rows(retailer_divergence(documents(spark, given), least_documents=4), *COLUMNS) == brute_force(given, 4)


def test_a_cell_needs_nothing_that_another_module_loads(tmp_path):
    cell = pa.table({"retailer_id": ["a", "b", "a", "b"], "term": [None, None, "x", "y"], "p": [1, 1, 5, 3], "block": [0] * 4, "terms": [2] * 4})
    with pa.ipc.new_file(str(tmp_path / "cell"), cell.schema) as file:
        file.write_table(cell)
    # A worker that has loaded this module alone and gets its cell from Spark.
    code = f"""
import types, pyarrow as pa
from disclens.llm.divergence import _cell
key = [types.SimpleNamespace(as_py=lambda k=k: k) for k in ("CCPA", 0, 0, 0)]
print(_cell(key, pa.ipc.open_file({str(tmp_path / "cell")!r}).read_all())["value"].to_pylist())"""
    assert subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True).stdout.strip() == "[6]"
