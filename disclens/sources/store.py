"""Requests stored whole: all their tables in one version, made visible by one marker.

A save claims the next number, writes what it holds under
``versions/<number>/<table>``, and then creates ``commits/<number>``, an empty
file. Readers see committed versions only, and of each request the one with the
largest number, so all tables of a request change at the same moment, a save
that breaks off leaves nothing to see, and children that a later save does not
have are gone. Nothing is rewritten; ``compact`` brings many versions into one.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from disclens.sources import files
from disclens.sources.staging import shuffles_released, stage

#: The tables of a request and what orders the rows of each within it.
KEYS = {
    "source_document": "source_document_id",
    "identity": "identity_seq",
    "txn": "txn_id",
    "inference": "inference_seq",
    "disclosure": "ordinal",
    "follow_up": "ord",
    "parse_warning": "seq",
}
TABLES = ("request", *KEYS, "txn_item")
PART_ROWS = 10_000
COMPACTED = "-compacted"


# -- versions -----------------------------------------------------------------


def _claim(spark: SparkSession, root: str) -> int:
    taken = files.names(spark, f"{root}/claims")
    number = int(taken[-1]) + 1 if taken else 1
    while not files.create(spark, f"{root}/claims/{number:010}"):
        number += 1
    return number


def _folder(root: str, number: int) -> str:
    return f"{root}/versions/{number:010}"


def commit(spark: SparkSession, root: str, number: int, compacted: bool = False) -> None:
    """Make a written version visible."""
    files.create(spark, f"{root}/commits/{number:010}{COMPACTED if compacted else ''}")


def visible_versions(spark: SparkSession, root: str) -> list[int]:
    """Committed versions that no compaction holds; their number is that of saves since, not of requests."""
    commits = files.names(spark, f"{root}/commits")
    numbers = {int(c.removesuffix(COMPACTED)) for c in commits}
    merged = [f"{_folder(root, int(c.removesuffix(COMPACTED)))}/merged" for c in commits if c.endswith(COMPACTED)]
    held = {r.number for r in spark.read.parquet(*merged).collect()} if merged else set()
    return sorted(numbers - held)


def _by_request(df: DataFrame) -> DataFrame:
    # Row groups then hold few requests, so a read of some skips the rest.
    return df.sortWithinPartitions("request_id")


def write_version(tables: dict[str, DataFrame], root: str) -> int:
    """SNK-01, first half: the tables of the requests in ``tables["request"]`` as a version that nobody sees yet."""
    spark = tables["request"].sparkSession
    number = _claim(spark, root)
    folder, version = _folder(root, number), F.lit(number).cast("long").alias("version")

    def put(name: str, df: DataFrame) -> DataFrame:
        with shuffles_released(spark):
            _by_request(df.select("*", version)).write.parquet(f"{folder}/{name}")
        return spark.read.parquet(f"{folder}/{name}")

    requests = put("request", tables["request"])
    ids = put("saved", requests.select("request_id", F.lit(False).alias("gone")).distinct()).select("request_id")
    for name in KEYS:
        if name in tables:
            put(name, tables[name].join(ids, "request_id", "left_semi"))
    if "txn_item" in tables and "txn" in tables:
        txns = spark.read.parquet(f"{folder}/txn").select("txn_id", "request_id")
        put("txn_item", tables["txn_item"].drop("request_id").join(txns, "txn_id"))
    return number


def save_requests(tables: dict[str, DataFrame], root: str) -> int:
    """SNK-01: requests with all their rows, replacing any earlier version of the same requests; the number of the version.

    Rows of other requests, and lines of baskets that are not saved, stay out.
    A table that is not given has no rows for these requests. Two saves at a
    time both count, the one that began later last.
    """
    number = write_version(tables, root)
    commit(tables["request"].sparkSession, root, number)
    return number


def remove_requests(removed: DataFrame, root: str) -> int:
    """SNK-04 on the store: the requests and all their rows are gone at once."""
    spark = removed.sparkSession
    number = _claim(spark, root)
    gone = removed.select("request_id", F.lit(True).alias("gone"), F.lit(number).cast("long").alias("version")).distinct()
    gone.write.parquet(f"{_folder(root, number)}/saved")
    commit(spark, root, number)
    return number


def _latest(spark: SparkSession, folders: list[str]) -> DataFrame:
    saved = spark.read.parquet(*[f"{f}/saved" for f in folders])
    last = saved.groupBy("request_id").agg(F.max(F.struct("version", "gone")).alias("last"))
    return last.select("request_id", "last.version", "last.gone")


def _current(spark: SparkSession, folders: list[str]) -> dict[str, DataFrame]:
    """The rows of each table that count, with their version."""
    latest = stage(_latest(spark, folders)) if len(folders) > 1 else None
    found = {}
    for name in TABLES:
        paths = [f"{f}/{name}" for f in folders if files.exists(spark, f"{f}/{name}")]
        if paths:
            found[name] = spark.read.parquet(*paths)
            if latest is not None:
                found[name] = found[name].join(latest.where("not gone"), ["request_id", "version"], "left_semi")
    return found


def stored_tables(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """SNK-03: each stored table, of every request the latest version; no tables where nothing was saved."""
    folders = [_folder(root, n) for n in visible_versions(spark, root)]
    return {name: df.drop("version") for name, df in _current(spark, folders).items()} if folders else {}


def compact(spark: SparkSession, root: str) -> int | None:
    """All visible versions as one, so that reads stop growing with the number of saves.

    Rows keep the number they were saved under, so a save that was under way
    meanwhile still takes its place among them.
    """
    versions = visible_versions(spark, root)
    if len(versions) < 2:
        return None
    folders = [_folder(root, n) for n in versions]
    number = _claim(spark, root)
    folder = _folder(root, number)
    with shuffles_released(spark):
        for name, df in _current(spark, folders).items():
            _by_request(df.hint("rebalance", "request_id")).write.parquet(f"{folder}/{name}")
        _latest(spark, folders).write.parquet(f"{folder}/saved")
    spark.createDataFrame([(n,) for n in versions], "number long").write.parquet(f"{folder}/merged")
    commit(spark, root, number, compacted=True)
    return number


def drop_merged(spark: SparkSession, root: str) -> int:
    """Remove the rows of versions that a compaction holds, for when nobody reads them any more; how many versions."""
    commits = files.names(spark, f"{root}/commits")
    gone = {int(c.removesuffix(COMPACTED)) for c in commits} - set(visible_versions(spark, root))
    for number in gone:
        for name in (*TABLES, "saved"):
            files.delete(spark, f"{_folder(root, number)}/{name}")
    return len(gone)


# -- nesting ------------------------------------------------------------------


def nest_requests(tables: dict[str, DataFrame], most: int = PART_ROWS) -> DataFrame:
    """SNK-03: every request with all its rows inside, in parts of about ``most`` rows.

    Returns ``(request_id, part, request, source_document, identity, txn,
    inference, disclosure, follow_up, parse_warning)``: a struct, in part 0
    only, and arrays in stored order. Baskets hold their ``items``; a basket of
    more than an eighth of that comes in several pieces. So no value grows with the
    largest request, and a request is gathered by as many tasks as it has parts.
    """
    tables = {n: df for n, df in tables.items() if n in TABLES}
    requests = tables["request"]
    known = requests.select("request_id").distinct()
    held = {n: tables[n].join(known, "request_id", "left_semi") for n in KEYS if n in tables and n != "txn"}
    sizes = [df.select("request_id", F.lit(1).cast("long").alias("n")) for df in held.values()]
    if "txn" in tables:
        txns = tables["txn"].join(known, "request_id", "left_semi")
        sizes.append(_basket_rows(txns, tables.get("txn_item"), most))
    crowded = known.withColumn("parts", F.lit(1).cast("long")).where("false")
    if sizes:
        counted = reduce(DataFrame.unionByName, sizes).groupBy("request_id").agg(F.sum("n").alias("n")).where(F.col("n") > most)
        crowded = stage(counted.select("request_id", F.ceil(F.col("n") / most).cast("long").alias("parts")))
    held = {n: df.join(crowded, "request_id", "left") for n, df in held.items()}
    if "txn" in tables:
        # The parts of the request are joined to its visits, before lines make them wide.
        held["txn"] = stage(_baskets(txns.join(crowded, "request_id", "left"), tables.get("txn_item"), most), "zstd")

    rows = [requests.select("request_id", F.lit(0).cast("long").alias("part"), F.struct("*").alias("request"))]
    for name, df in held.items():
        key = [KEYS[name], "piece"] if name == "txn" else [KEYS[name]]
        part = F.coalesce(F.pmod(F.xxhash64(*key), F.col("parts")), F.lit(0)).cast("long")
        inside = F.struct(KEYS[name], *[c for c in df.columns if c not in ("request_id", "parts", KEYS[name])])
        rows.append(df.select("request_id", part.alias("part"), inside.alias(name)))
    whole = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), rows)
    lists = [F.array_sort(F.collect_list(n)).alias(n) for n in held]
    return whole.groupBy("request_id", "part").agg(F.first("request", ignorenulls=True).alias("request"), *lists)


def _basket_rows(txns: DataFrame, items: DataFrame | None, most: int) -> DataFrame:
    """For each visit its request and ``n``, the lines and pieces of its basket."""
    if items is None:
        return txns.select("request_id", F.lit(1).cast("long").alias("n"))
    lines = items.groupBy("txn_id").agg(F.count(F.lit(1)).alias("lines"))
    n = F.coalesce("lines", F.lit(0))
    pieces = F.greatest(F.ceil(n / max(1, most // 8)), F.lit(1))
    return txns.select("request_id", "txn_id").join(lines, "txn_id", "left").select("request_id", (n + pieces).cast("long").alias("n"))


def _baskets(txns: DataFrame, items: DataFrame | None, most: int) -> DataFrame:
    """Baskets with ``piece`` and ``items``."""
    if items is None:
        return txns.select("*", F.lit(0).cast("long").alias("piece"), F.array().cast("array<struct<item_id:string>>").alias("items"))
    # Pieces are small beside a part, so that parts come out alike.
    lines, most = items.drop("request_id"), max(1, most // 8)
    crowded = lines.groupBy("txn_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most)
    lines = lines.join(crowded.select("txn_id", F.ceil(F.col("n") / most).cast("long").alias("pieces")), "txn_id", "left")
    piece = F.coalesce(F.pmod(F.xxhash64("item_id"), F.col("pieces")), F.lit(0)).cast("long")
    line = F.struct("item_id", *[c for c in items.columns if c not in ("item_id", "txn_id", "request_id")])
    grouped = lines.groupBy("txn_id", piece.alias("piece")).agg(F.array_sort(F.collect_list(line)).alias("items"))
    # Piece 0 is there whatever the hashes give, so every basket has one.
    opening = txns.select("txn_id", F.lit(0).cast("long").alias("piece"))
    pieces = opening.join(grouped, ["txn_id", "piece"], "full").withColumn(
        "items", F.coalesce("items", F.array().cast(grouped.schema["items"].dataType))
    )
    return txns.join(pieces, "txn_id")


def flatten_requests(nested: DataFrame) -> dict[str, DataFrame]:
    """SNK-01: nested requests as the flat tables again, every row under its request."""
    flat = {"request": nested.where("request is not null").select("request.*")}
    for name in KEYS:
        if name not in nested.columns:
            continue
        rows = nested.select("request_id", F.explode(name).alias("r"))
        if name == "txn":
            flat["txn"] = rows.where("r.piece = 0").select("request_id", "r.*").drop("piece", "items")
            lines = rows.select("request_id", "r.txn_id", F.explode("r.items").alias("i"))
            flat["txn_item"] = lines.select("request_id", "txn_id", "i.*")
        else:
            flat[name] = rows.select("request_id", "r.*")
    return flat
