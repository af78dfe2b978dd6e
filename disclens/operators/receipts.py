"""Receipt captures: runs, seams, footing, and matching receipts to visits."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

RECEIPT = ["visit_key", "receipt_no"]


def receipt_runs(fragments: DataFrame) -> DataFrame:
    """EXT-35: a fragment that reached the end of its page closes its receipt."""
    before = (
        Window.partitionBy("visit_key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    )
    return fragments.withColumn(
        "receipt_no", F.coalesce(F.sum(F.col("complete").cast("bigint")).over(before), F.lit(0)).cast("bigint")
    )


def set_aside_clipped(fragments: DataFrame) -> tuple[DataFrame, DataFrame]:
    """EXT-42: a receipt of which any capture is clipped leaves whole, before any arithmetic, which it would satisfy by chance.

    Both sides come numbered by receipt, with the numbers all captures together give.
    """
    runs = receipt_runs(fragments)
    cut = runs.groupBy(*RECEIPT).agg(F.max(F.coalesce("clipped", F.lit(False))).alias("_cut"))
    judged = runs.join(cut, RECEIPT)
    return judged.where(~F.col("_cut")).drop("_cut"), judged.where("_cut").drop("_cut")


def _overlap(before: list, after: list) -> int:
    """The longest beginning of ``after`` that ``before`` ends with, in one walk over the borders of ``after``."""
    border, k = [0] * len(after), 0
    for i in range(1, len(after)):
        while k and after[i] != after[k]:
            k = border[k - 1]
        k += after[i] == after[k]
        border[i] = k
    k = 0
    for line in before if after else []:
        while k and (k == len(after) or after[k] != line):
            k = border[k - 1]
        k += after[k] == line
    return k


def _seams_that_spend(openings: list[list], surplus) -> list[int] | None:
    """Trims, one for each seam, whose amounts come to ``surplus``: as many lines as can be, then the fewest at the first seam.

    From the last seam back, every sum that trims can reach is kept with the
    most lines that reach it, so no choice of trims is listed.
    """
    reach = [{0: 0}]
    for amounts in reversed(openings):
        spent, onward = 0, {}
        for n in range(len(amounts) + 1):
            spent += amounts[n - 1] if n else 0
            for rest, lines in reach[-1].items():
                onward[rest + spent] = max(onward.get(rest + spent, 0), lines + n)
        reach.append(onward)
    if surplus not in reach[-1]:
        return None
    trims = []
    for amounts, here, later in zip(openings, reach[:0:-1], reach[-2::-1], strict=True):
        spent, most = 0, here[surplus]
        for n in range(len(amounts) + 1):
            spent += amounts[n - 1] if n else 0
            if later.get(surplus - spent, -len(amounts) - most - 1) + n == most:
                break
        trims.append(n)
        surplus -= spent
    return trims


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def seam_trims(parts: pd.Series, owed: pd.Series) -> pd.Series:
    """How many opening lines each later fragment repeats.

    ``parts`` holds each fragment's lines as (description, amount) in order and
    ``owed`` what the joined lines should come to, or NULL. The longest
    overlaps with what is already joined stand if they add up, or if nothing
    does; else those overlaps of neighbours that add up and leave out the most.
    """

    def trims(fragments, total) -> list[int]:
        lines = [[(x["description"], x["amount"]) for x in f["lines"]] for f in fragments]
        joined, longest = list(lines[0]), []
        for after in lines[1:]:
            longest.append(_overlap(joined, after))
            joined += after[longest[-1] :]
        if total is None or sum(amount for _, amount in joined) == total:
            return longest
        openings = [[amount for _, amount in b[: _overlap(a, b)]] for a, b in zip(lines, lines[1:], strict=False)]
        surplus = sum(amount for f in lines for _, amount in f) - total
        return _seams_that_spend(openings, surplus) or longest

    return pd.Series([trims(f, t) for f, t in zip(parts, owed, strict=True)])


def stitch(fragments: DataFrame, lines: DataFrame) -> DataFrame:
    """EXT-36: the lines of each receipt with the repeats at its seams left out.

    Receipts with a clipped capture are set aside first. Only receipts of several
    fragments are gathered, one receipt's lines at a time; the rest pass through untouched.
    """
    runs, _ = set_aside_clipped(fragments)
    held = lines.join(runs.select("visit_key", "part", "receipt_no"), ["visit_key", "part"])
    totals = runs.groupBy(*RECEIPT).agg(
        F.count(F.lit(1)).alias("fragments"),
        F.max_by("balance", F.when(F.col("balance").isNotNull(), F.col("part"))).alias("balance"),
        F.max_by("tax", F.when(F.col("tax").isNotNull(), F.col("part"))).alias("tax"),
    )
    several = totals.where(F.col("fragments") > 1)
    per_part = (
        held.join(several.select(*RECEIPT), RECEIPT, "left_semi")
        .groupBy(*RECEIPT, "part")
        .agg(F.array_sort(F.collect_list(F.struct("row_no", "description", "amount"))).alias("lines"))
    )
    trims = (
        per_part.groupBy(*RECEIPT)
        .agg(F.array_sort(F.collect_list(F.struct("part", "lines"))).alias("parts"))
        .join(several, RECEIPT)
        .withColumn("trims", seam_trims("parts", F.col("balance") - F.coalesce("tax", F.lit(0).cast("decimal(18,2)"))))
        .select(*RECEIPT, F.posexplode("parts").alias("_at", "_p"), "trims")
        .where(F.col("_at") > 0)
        .select(*RECEIPT, F.col("_p.part").alias("part"), F.get("trims", F.col("_at") - 1).alias("repeated"))
    )
    # Rows are numbered from one inside a fragment, so a repeat is a row at or below the trim.
    return (
        held.join(trims, [*RECEIPT, "part"], "left")
        .where(F.col("row_no") > F.coalesce("repeated", F.lit(0)))
        .drop("repeated")
    )


def seam_of_two(fragments: DataFrame, lines: DataFrame) -> DataFrame:
    """EXT-36 for receipts of two fragments, in array expressions alone."""
    per_part = lines.groupBy("visit_key", "part").agg(
        F.array_sort(F.collect_list(F.struct("row_no", "description", "amount"))).alias("rows")
    )
    line = lambda r: F.struct(r["description"].alias("d"), r["amount"].alias("a"))
    pair = (
        per_part.groupBy("visit_key")
        .agg(
            F.max(F.when(F.col("part") == 1, F.transform("rows", line))).alias("before"),
            F.max(F.when(F.col("part") == 2, F.transform("rows", line))).alias("after"),
        )
        .where(F.col("before").isNotNull() & F.col("after").isNotNull())
    )
    owed = fragments.groupBy("visit_key").agg(
        (F.max("balance") - F.coalesce(F.max("tax"), F.lit(0).cast("decimal(18,2)"))).alias("owed")
    )
    total = lambda rows: F.aggregate(
        rows, F.lit(0).cast("decimal(38,2)"), lambda acc, r: (acc + r["a"]).cast("decimal(38,2)")
    )
    size = F.least(F.size("before"), F.size("after"))
    repeats = lambda k: F.slice("before", F.size("before") - k + 1, k) == F.slice("after", F.lit(1), k)
    longest = F.coalesce(F.array_max(F.filter(F.sequence(F.lit(1), size), repeats)), F.lit(0))
    candidates = F.filter(
        F.sequence(F.lit(0), F.col("longest")),
        lambda k: total("before") + total("after") - total(F.slice("after", F.lit(1), k)) == F.col("owed"),
    )
    return (
        pair.join(owed, "visit_key")
        .withColumn("longest", longest)
        .select("visit_key", F.coalesce(F.array_max(candidates), F.col("longest")).cast("bigint").alias("repeated"))
    )


def receipt_foots(receipts: DataFrame) -> DataFrame:
    """EXT-37: by how much lines and tax miss the balance; NULL where they meet it."""
    difference = F.col("subtotal") + F.coalesce("tax", F.lit(0).cast("decimal(18,2)")) - F.col("balance")
    return receipts.withColumn(
        "difference",
        F.when(F.col("balance").isNull(), F.col("subtotal")).otherwise(
            F.nullif(difference, F.lit(0).cast("decimal(18,2)"))
        ),
    )


# The slips of one printed second with its visits, in order: each slip meets the first visit that is still free, and takes
# it if they agree on the sum, tax read as the last thing bought where that alone makes them agree.
_OFFERS = """aggregate(_slips,
    struct(0 as taken, cast(array() as array<struct<receipt_id:bigint,txn_id:bigint,agrees:boolean>>) as pairs),
    (s, slip) -> if(s.taken >= size(_visits), s, transform(array(_visits[s.taken]), v -> transform(
        array(coalesce(v.total_pre_discount = slip.subtotal
            or (slip.tax_inferred and v.total_pre_discount = slip.subtotal + slip.tax), false)),
        agrees -> struct(s.taken + if(agrees, 1, 0) as taken, concat(s.pairs, array(struct(
            slip.receipt_id as receipt_id, v.txn_id as txn_id, agrees as agrees))) as pairs))[0])[0]),
    s -> s.pairs)"""


def receipt_match(receipts: DataFrame, visits: DataFrame) -> DataFrame:
    """EXT-38: each receipt's visit, by its printed time, else by date and amount where only one fits.

    Receipts that share one printed time are offered that time's visits in
    order; a visit whose total a receipt contradicts stays free for the next.
    """
    key = ["request_id", "occurred_at"]
    stamped = (
        receipts.where(F.col("stamp").isNotNull())
        .groupBy("request_id", F.col("stamp").alias("occurred_at"))
        .agg(F.array_sort(F.collect_list(F.struct("receipt_id", "subtotal", "tax", "tax_inferred"))).alias("_slips"))
    )
    dated = visits.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("txn_id", "total_pre_discount"))).alias("_visits"))
    offered = stamped.join(dated, key).select(F.explode(F.expr(_OFFERS)).alias("o"))
    exact = offered.select("o.receipt_id", "o.txn_id", F.lit(False).alias("by_filename"), "o.agrees")
    free_receipts = receipts.join(exact.select("receipt_id"), "receipt_id", "left_anti")
    free_visits = visits.join(exact.where("agrees").select("txn_id"), "txn_id", "left_anti")
    fits = (
        free_visits.where(F.col("total_pre_discount").isNotNull())
        .groupBy("request_id", F.left("occurred_at", F.lit(10)).alias("named_date"), F.col("total_pre_discount").alias("subtotal"))
        .agg(F.count(F.lit(1)).alias("candidates"), F.min("txn_id").alias("txn_id"))
        .where(F.col("candidates") == 1)
    )
    fallback = (
        free_receipts.join(fits, ["request_id", "named_date", "subtotal"])
        .groupBy("txn_id")
        .agg(F.min("receipt_id").alias("receipt_id"))
        .select("receipt_id", "txn_id", F.lit(True).alias("by_filename"))
    )
    return exact.drop("agrees").unionByName(fallback)


def tax_settlement(stated: Column, subtotal: Column, tax: Column, inferred: Column) -> Column:
    """EXT-39: whether an unlabelled line above the balance was tax or the last thing bought."""
    return (
        F.when(~inferred | stated.isNull() | tax.isNull(), "tax")
        .when(stated == subtotal, "tax")
        .when(stated == subtotal + tax, "item")
        .otherwise("tax")
    )


def source_disagreement(stated: Column, subtotal: Column) -> Column:
    """EXT-40: whether statement and receipt say the same, to the cent."""
    return F.when(stated.isNull(), "uncheckable").when(stated == subtotal, "agree").otherwise("disagree")


def itemise_overlay(
    visits: DataFrame, receipts: DataFrame, statement: bool = True
) -> tuple[DataFrame, DataFrame]:
    """EXT-41: visits with what their receipts show, and the receipts set aside with a reason.

    A receipt that does not add up, or that disagrees with the statement, leaves
    its visit as it was. Without a statement an unmatched receipt is a visit.
    """
    checked = receipt_foots(receipts)
    sound = checked.where(F.col("difference").isNull())
    unsound = checked.where(F.col("difference").isNotNull()).select("receipt_id", F.lit("does not add up").alias("reason"))
    matched = sound.join(receipt_match(sound, visits), "receipt_id", "left")
    against = matched.where(F.col("txn_id").isNotNull()).join(
        visits.select("txn_id", F.col("total_pre_discount").alias("stated")), "txn_id"
    )
    settled = against.withColumn(
        "reading", tax_settlement(F.col("stated"), F.col("subtotal"), F.col("tax"), F.col("tax_inferred"))
    ).withColumn(
        "item_total", F.when(F.col("reading") == "item", F.col("subtotal") + F.col("tax")).otherwise(F.col("subtotal"))
    ).withColumn("verdict", source_disagreement(F.col("stated"), F.col("item_total")))
    agreed = settled.where(F.col("verdict") == "agree").select(
        "txn_id", "receipt_id", "item_total", F.col("tender").alias("_tender"),
        F.when(~F.col("by_filename"), F.col("lane")).alias("_lane"),
    )
    overlaid = visits.join(agreed, "txn_id", "left").select(
        "txn_id", "request_id", "occurred_at", "total_pre_discount", "receipt_id", "item_total",
        F.coalesce("_tender", "tender_type").alias("tender_type"),
        F.coalesce("_lane", "division_code").alias("division_code"),
    )
    unmatched = matched.where(F.col("txn_id").isNull())
    reasons = unsound.unionByName(
        settled.where(F.col("verdict") != "agree").select("receipt_id", F.col("verdict").alias("reason"))
    )
    if statement:
        return overlaid, reasons.unionByName(unmatched.select("receipt_id", F.lit("no visit").alias("reason")))
    misdated = F.left("stamp", F.lit(10)) != F.col("named_date")
    added = unmatched.where(F.col("stamp").isNotNull() & ~F.coalesce(misdated, F.lit(False))).select(
        F.lit(None).cast("bigint").alias("txn_id"), "request_id", F.col("stamp").alias("occurred_at"),
        F.col("subtotal").alias("total_pre_discount"), "receipt_id", F.col("subtotal").alias("item_total"),
        F.col("tender").alias("tender_type"), F.col("lane").alias("division_code"),
    )
    undated = unmatched.where(F.col("stamp").isNull() | F.coalesce(misdated, F.lit(False))).select(
        "receipt_id", F.lit("no certain time").alias("reason")
    )
    return overlaid.unionByName(added), reasons.unionByName(undated)
