"""How differently retailers word their answers: term shares compared over a cube of tasks."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from disclens.llm.shared import TEXT, rows_of
from disclens.sources.staging import stage

STATUTE, RETAILER = "statute", "retailer_id"
LEAST_DOCUMENTS = 30
ADDED = 5
SCALE = 1_000_000_000
TOP = 50
GROUP_BLOCK = 16
TERM_BLOCK = 2_048
ENTRIES_HELD = 200_000
#: Letters of ASCII in lower case and every other byte of UTF-8 beyond it; the rest separates.
TERMS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences and documents of each term of each group in a part of the documents, and one row without a term for each group."""
    words: dict[tuple[str, str], Counter] = {}
    documents: dict[tuple[str, str], Counter] = {}

    def held() -> pa.RecordBatch:
        rows = [(s, r, t, n, documents[s, r][t]) for (s, r), own in words.items() for t, n in own.items()]
        rows += [(s, r, b"", 0, 0) for s, r in words]
        columns = list(zip(*rows)) or [[]] * 5
        types = (pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64())
        read = [pa.array(c, pa.binary()).cast(pa.string()) if n == 2 else pa.array(c, t) for n, (c, t) in enumerate(zip(columns, types))]
        return pa.RecordBatch.from_arrays(read, names=[STATUTE, RETAILER, "term", "n", "documents"])

    entries = 0
    for statute, retailer, text in rows_of(batches, STATUTE, RETAILER, TEXT):
        own = words.setdefault((statute, retailer), Counter())
        entries -= len(own)
        found = text.encode().translate(TERMS).split()
        own.update(found)
        documents.setdefault((statute, retailer), Counter()).update(set(found))
        entries += len(own)
        if entries > ENTRIES_HELD:
            yield held()
            words.clear()
            documents.clear()
            entries = 0
    yield held()


def _share(n: Column, words: Column, terms: Column) -> Column:
    """``1 + floor(SCALE * (n + ADDED) / (words + ADDED * terms))`` in whole numbers; 0 where there are no terms."""
    above = (n + ADDED).cast("decimal(20,0)") * F.lit(SCALE)
    below = (words + terms * ADDED).cast("decimal(20,0)")
    return F.when(terms > 0, F.call_function("div", above, below) + 1).otherwise(0).cast("long")


def _cell(key: tuple, cell: pa.Table) -> pa.Table:
    """A cell of the cube: partial divergences of the pairs between two blocks of groups, over one block of terms."""
    statute, i, j, _ = (k.as_py() for k in key)
    head = cell.filter(pc.is_null(cell["term"]))
    names = head[RETAILER].to_pylist()
    order = sorted(range(len(names)), key=names.__getitem__)
    names = [names[k] for k in order]
    base, block, kept = (head[c].to_numpy()[order] for c in ("p", "block", "terms"))
    rows = cell.filter(pc.is_valid(cell["term"]))
    terms = rows["term"].combine_chunks().dictionary_encode()
    at = {name: k for k, name in enumerate(names)}
    shares = np.repeat(base[:, None], len(terms.dictionary), axis=1)
    shares[[at[r] for r in rows[RETAILER].to_pylist()], terms.indices.to_numpy()] = rows["p"].to_numpy()
    own, other = np.flatnonzero(block == i), np.flatnonzero(block == j)
    out: list[tuple] = []
    for a in own:
        met = other[other > a] if i == j else other
        partial = np.abs(shares[met] - shares[a]).sum(axis=1)
        out += [(statute, names[a], names[b], int(v), len(terms.dictionary), int(kept[a]), abs(int(base[a] - base[b]))) for b, v in zip(met, partial)]
    types = [pa.string()] * 3 + [pa.int64()] * 4
    columns = list(zip(*out)) or [[]] * 7
    return pa.table([pa.array(c, t) for c, t in zip(columns, types)], names=["statute", "a", "b", "value", "met", "terms", "unmet"])


def retailer_divergence(
    documents: DataFrame,
    least_documents: int = LEAST_DOCUMENTS,
    top: int = TOP,
    group_block: int = GROUP_BLOCK,
    term_block: int = TERM_BLOCK,
) -> DataFrame:
    """Divergence between retailers' source documents under each statute, and the terms that set a retailer apart.

    ``documents(statute, retailer_id, text)``, statute and retailer being those
    of the document's request; other columns are ignored. Terms are runs of
    letters, ASCII ones in lower case. A statute keeps the V terms that
    ``least_documents`` of its documents hold. A retailer's share of a kept term,
    ``1 + floor(10^9 * (n + 5) / (N + 5 V))``, is smoothed so that no term has none.

    Returns ``(statute, retailer_id, part, item, value, rank)``. Part ``pair``:
    the sum of absolute differences of shares from every other retailer of the
    statute. Part ``term``: kept terms that the retailer has, with the excess of
    its share over the statute's, the ``top`` ones. Ranks from 1 by falling
    value, then item.

    Missing text, statute and retailer are read as ''; a retailer without terms
    is compared all the same; without kept terms every divergence is 0; a
    document that repeats counts each time; an empty table gives no rows.

    Pairs are worked out over a cube: a task owns a block of retailers against
    another, over one block of terms, and holds at most that slice; slices are
    replicated to the cells of their block, and partial sums meet per pair.
    Blocks are dealt by hashes, their number follows the groups and terms of
    the statute, so no task grows with a hot group.
    """
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    told = documents.select(empty(STATUTE), empty(RETAILER), empty(TEXT))
    counted = told.mapInArrow(_counted, f"{STATUTE} string, {RETAILER} string, term string, n long, documents long")
    counts = stage(counted.groupBy(STATUTE, RETAILER, "term").agg(F.sum("n").alias("n"), F.sum("documents").alias("documents")))
    terms = stage(
        counts.where("term <> ''")
        .groupBy(STATUTE, "term")
        .agg(F.sum("n").alias("statute_n"), F.sum("documents").alias("documents"))
        .where(F.col("documents") >= least_documents)
        .select(STATUTE, "term", "statute_n")
    )
    kept = stage(counts.select(STATUTE, RETAILER, "term", "n").join(terms, [STATUTE, "term"]))
    groups = _groups(counts, terms, kept)
    shares = kept.join(groups, [STATUTE, RETAILER]).withColumn("p", _share(F.col("n"), F.col("words"), F.col("terms")))
    pairs = _pairs(shares, groups, group_block, term_block)
    apart = shares.withColumn("q", _share(F.col("statute_n"), F.col("statute_words"), F.col("terms"))).where("p > q")
    apart = apart.select(STATUTE, RETAILER, F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    place = F.row_number().over(Window.partitionBy(STATUTE, RETAILER).orderBy(F.desc("value"), "item")).alias("rank")
    return pairs.select("*", place).union(apart.select("*", place).where(F.col("rank") <= top))


def _groups(counts: DataFrame, terms: DataFrame, kept: DataFrame) -> DataFrame:
    """Each retailer of each statute with its words of kept terms, and the statute's retailers, terms and words."""
    known = counts.where("term = ''").select(STATUTE, RETAILER)
    words = kept.groupBy(STATUTE, RETAILER).agg(F.sum("n").alias("words"))
    whole = terms.groupBy(STATUTE).agg(F.count(F.lit(1)).alias("terms"), F.sum("statute_n").alias("statute_words"))
    retailers = known.groupBy(STATUTE).agg(F.count(F.lit(1)).alias("retailers"))
    joined = known.join(words, [STATUTE, RETAILER], "left").join(whole, STATUTE, "left").join(retailers, STATUTE)
    return stage(joined.na.fill(0, ["words", "terms", "statute_words"]))


def _pairs(shares: DataFrame, groups: DataFrame, group_block: int, term_block: int) -> DataFrame:
    blocks = F.ceil(F.col("retailers") / group_block)
    slices = F.greatest(F.lit(1), F.ceil(F.col("terms") / term_block))
    block = F.pmod(F.xxhash64(RETAILER), blocks)
    others = F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)).alias("facing")
    part = F.pmod(F.xxhash64("term"), slices)
    held = shares.select(STATUTE, RETAILER, "term", "p", "terms", block.alias("block"), part.alias("slice"), others)
    base = _share(F.lit(0).cast("long"), F.col("words"), F.col("terms"))
    heads = groups.select(STATUTE, RETAILER, F.lit(None).cast("string").alias("term"), base.alias("p"), "terms", block.alias("block"), slices.alias("slices"), others)
    heads = heads.select(STATUTE, RETAILER, "term", "p", "terms", "block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slices") - 1)).alias("slice"), "facing")
    cells = held.unionByName(heads).withColumns({"i": F.least("block", "facing"), "j": F.greatest("block", "facing")}).drop("facing")
    partial = cells.groupBy(STATUTE, "i", "j", "slice").applyInArrow(
        _cell, "statute string, a string, b string, value long, met long, terms long, unmet long"
    )
    # Kept terms that neither has differ by what smoothing alone gives them.
    sums = partial.groupBy("statute", "a", "b").agg(F.sum("value").alias("value"), F.sum("met").alias("met"), F.max("terms").alias("terms"), F.max("unmet").alias("unmet"))
    sums = sums.withColumn("value", F.col("value") + (F.col("terms") - F.col("met")) * F.col("unmet"))
    sides = F.explode(F.array(F.struct(F.col("a").alias("own"), F.col("b").alias("item")), F.struct(F.col("b").alias("own"), F.col("a").alias("item"))))
    return sums.select("statute", "value", sides.alias("side")).select(
        F.col("statute").alias(STATUTE), F.col("side.own").alias(RETAILER), F.lit("pair").alias("part"), "side.item", "value"
    )
