"""Documents to shards by a consistent-hash ring with virtual nodes and bounded loads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from disclens.llm.shared import ID, TEXT
from disclens.sources.staging import stage

SHARDS = 16
VIRTUAL_NODES = 64
RING_BITS = 14


def _cell(hashed: Column, ring_bits: int) -> Column:
    return F.shiftrightunsigned(hashed, 64 - ring_bits)


def virtual_nodes_of(spark: SparkSession, shards: int, virtual_nodes: int, ring_bits: int) -> DataFrame:
    """``(node, shard)``: the cells of each shard's virtual nodes, which depend on the shard and the node's number alone."""
    return (
        spark.range(shards * virtual_nodes)
        .select((F.col("id") % shards).cast("int").alias("shard"), F.floor(F.col("id") / shards).alias("copy"))
        .select(_cell(F.xxhash64(F.lit("shard"), "shard", "copy"), ring_bits).alias("node"), "shard")
        .distinct()
    )


def ring(nodes: DataFrame, ring_bits: int) -> DataFrame:
    """``(cell, node, shard)``: each cell of the ring with the first virtual node at or after it, clockwise.

    A further shard only takes cells from the others. Of two shards on one cell
    the smaller is its home.
    """
    cells = 1 << ring_bits
    homes = nodes.groupBy(F.col("node").alias("cell")).agg(F.min("shard").alias("shard"))
    first = homes.orderBy("cell").limit(1).select((F.col("cell") + cells).alias("cell"), "shard")
    every = nodes.sparkSession.range(cells).select(F.col("id").alias("cell")).join(homes, "cell", "left")
    clockwise = Window.orderBy(F.desc("cell")).rowsBetween(Window.unboundedPreceding, 0)
    at = F.when(F.col("shard").isNotNull(), F.struct(F.col("cell").alias("at"), "shard"))
    named = every.unionByName(first).select("cell", F.last(at, ignorenulls=True).over(clockwise).alias("next"))
    return named.where(F.col("cell") < cells).select(
        "cell", (F.col("next.at") % cells).alias("node"), F.col("next.shard").alias("shard")
    )


def placement(cells: DataFrame, nodes: DataFrame, shards: int) -> DataFrame:
    """Where the keys of each cell go, from the keys counted per cell.

    ``cells(cell, node, shard, n)`` covers the whole ring. A shard holds
    ``total / shards`` keys, rounded up for as many of the fullest shards as
    are needed, else down. It keeps its own first keys in ring order; the others wait and
    take, in ring order, the first free room clockwise. Returns one row for
    each cell: keys before it in its shard, the shard's room, keys waiting
    before it, and the pieces of the waiting line that touch the cell.
    """
    own = cells.groupBy("shard").agg(F.sum("n").alias("load"))
    load = (
        cells.sparkSession.range(shards)
        .select(F.col("id").cast("int").alias("shard"))
        .join(own, "shard", "left")
        .select("shard", F.coalesce("load", F.lit(0)).alias("load"))
    )
    total = F.sum("load").over(Window.partitionBy())
    fullest = F.row_number().over(Window.orderBy(F.desc("load"), "shard"))
    room = load.select(
        "shard", "load", (F.floor(total / shards) + F.when(fullest <= total % shards, 1).otherwise(0)).alias("room")
    )
    in_shard = Window.partitionBy("shard").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy("node", "cell").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("n").over(in_shard), F.lit(0))
    held = F.greatest(F.lit(0), F.least(F.col("n"), F.col("room") - F.col("before")))
    counted = (
        cells.join(room.drop("load"), "shard")
        .withColumn("before", before)
        .withColumn("held", held)
        .withColumn("over", F.col("n") - F.col("held"))
        .withColumn("waiting", F.coalesce(F.sum("over").over(whole), F.lit(0)))
    )
    over = counted.groupBy("node", "shard").agg(F.sum("over").alias("over"))
    lap = nodes.join(over, ["node", "shard"], "left").join(room, "shard")
    lap = lap.select("node", "shard", F.coalesce("over", F.lit(0)).alias("over"), "room", (F.col("room") - F.least("room", "load")).alias("free"))
    walked = lap.agg(F.array_sort(F.collect_list(F.struct(*lap.columns))).alias("lap")).select(
        F.expr(_WALK.format(last=shards - 1)).alias("walk")
    )
    pieces = walked.select(F.explode("walk.pieces").alias("p")).select("p.at", "p.shard", "p.first")
    nothing = F.lit(None).cast("struct<shard:int,at:bigint,first:bigint>")
    line = (
        counted.where("over > 0")
        .select(F.col("waiting").alias("at"), "cell", nothing.alias("piece"))
        .union(pieces.select("at", F.lit(None).cast("long"), F.struct("shard", "at", "first")))
        .groupBy("at")
        .agg(F.max("cell").alias("cell"), F.max("piece").alias("piece"))
    )
    so_far = Window.orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    touched = (
        line.select("at", F.last("cell", True).over(so_far).alias("cell"), F.last("piece", True).over(so_far).alias("piece"))
        .groupBy("cell")
        .agg(F.array_sort(F.collect_list(F.struct("at", F.col("piece.shard").alias("shard"), (F.col("piece.first") + F.col("at") - F.col("piece.at")).alias("first")))).alias("pieces"))
    )
    return counted.select("cell", "shard", "before", "held", "waiting").join(touched, "cell", "left")


# Two laps around the ring: keys join the waiting line at their own node in the first lap, and every node lets in as many as its shard has room for.
_WALK = """aggregate(concat(transform(lap, x -> struct(x.shard as shard, x.room as room, x.over as over)),
                            transform(lap, x -> struct(x.shard as shard, x.room as room, 0L as over))),
    struct(transform(sequence(0, {last}), i -> filter(lap, x -> x.shard = i)[0].free) as free, 0L as line, 0L as gone,
        cast(array() as array<struct<at:bigint,shard:int,first:bigint>>) as pieces),
    (s, x) -> struct(
        transform(s.free, (f, i) -> case when i = x.shard then f - least(f, s.line + x.over) else f end) as free,
        s.line + x.over - least(s.free[x.shard], s.line + x.over) as line,
        s.gone + least(s.free[x.shard], s.line + x.over) as gone,
        case when least(s.free[x.shard], s.line + x.over) > 0
            then concat(s.pieces, array(struct(s.gone as at, x.shard as shard, x.room - s.free[x.shard] as first)))
            else s.pieces end as pieces))"""


def shard_documents(
    documents: DataFrame, shards: int = SHARDS, virtual_nodes: int = VIRTUAL_NODES, ring_bits: int = RING_BITS
) -> DataFrame:
    """Every source document with its shard and its place in it, shards holding equally many documents.

    ``documents(source_document_id, text)``; other columns are ignored. Returns
    ``(source_document_id, size, text_crc32, shard, slot)``: UTF-8 bytes plus
    one, the CRC-32 of the text, shard 0 to ``shards - 1``, and the document's
    number in its shard, gapless from 0. Counts are at most one apart.

    A document's place on the ring is the hash of its id (of its text where the
    id is missing); its own shard keeps as many as it has room for, and the
    others continue clockwise, so only what a full shard cannot take is moved.
    A missing text is empty; rows that repeat are placed one by one, equal rows
    in any order; an empty table gives no rows. Counts per cell, a table of
    ``2 ** ring_bits`` rows whatever the input, carry the whole plan; each
    document is shuffled once, without its text.
    """
    spark, cells = documents.sparkSession, 1 << ring_bits
    if shards < 1 or virtual_nodes < 1:
        raise ValueError("a ring needs a shard and a virtual node")
    text = F.coalesce(F.col(TEXT), F.lit(""))
    slim = documents.select(
        ID, (F.octet_length(text) + F.lit(1).cast("long")).alias("size"), F.crc32(F.encode(text, "utf-8")).alias("text_crc32")
    )
    hashed = F.when(F.col(ID).isNull(), F.xxhash64("text_crc32", "size")).otherwise(F.xxhash64(ID))
    slim = slim.withColumn("hashed", hashed).withColumn("cell", _cell(F.col("hashed"), ring_bits))
    slim = stage(slim)
    counts = slim.groupBy("cell").agg(F.count(F.lit(1)).alias("n"))
    nodes = stage(virtual_nodes_of(spark, shards, virtual_nodes, ring_bits))
    whole = stage(ring(nodes, ring_bits).join(counts, "cell", "left").na.fill(0, ["n"]))
    plan = stage(placement(whole, nodes, shards))
    in_cell = Window.partitionBy("cell").orderBy("hashed", ID, "size", "text_crc32")
    ranked = slim.withColumn("rank", F.row_number().over(in_cell) - F.lit(1).cast("long"))
    placed = ranked.join(F.broadcast(plan), "cell")
    place = F.col("waiting") + F.col("rank") - F.col("held")
    piece = F.element_at(F.filter("pieces", lambda p: p["at"] <= place), -1)
    stays = F.col("rank") < F.col("held")
    placed = placed.withColumn("piece", F.when(~stays, piece)).withColumn("place", place)
    return placed.select(
        ID,
        "size",
        "text_crc32",
        F.when(stays, F.col("shard")).otherwise(F.col("piece.shard")).alias("shard"),
        F.when(stays, F.col("before") + F.col("rank")).otherwise(F.col("piece.first") + F.col("place") - F.col("piece.at")).alias("slot"),
        F.when(stays, F.lit(False)).otherwise(True).alias("moved"),
    )
