"""The two rules that hold on a stream as they do on a batch."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from disclens.operators.baskets import basket_totals, settle
from disclens.session import shared_folder
from disclens.sources.staging import stage
from disclens.streaming import runs


def _finish(query) -> None:
    query.awaitTermination()
    if query.exception() is not None:
        raise query.exception()


def _run(arriving: DataFrame, checkpoint: str | None) -> tuple[str, str]:
    """The checkpoint folder of a run and the run's name, which a restart of it keeps."""
    folder = checkpoint or f"{shared_folder(arriving.sparkSession)}/streams/{uuid4().hex}"
    return folder, folder.rstrip("/").rsplit("/", 1)[-1]


PREFIX = 2


def stream_dedup(arriving: DataFrame, store: str, checkpoint: str | None = None) -> DataFrame:
    """ST-01: each document is stored once, whenever its copies arrive.

    Copies within a batch are folded into their first; copies of anything stored
    earlier are left out by its hash. The store alone decides: a watermark would
    lose a document that comes later than it. It is kept in folders by the
    first two digits of the hash, of which a batch reads its own, in as many
    runs as the logarithm of the number of batches. A batch that is run again
    after a failure finds its run stored, or stores it then. ``arriving``
    streams (landed_at, sha256, ...).
    """
    spark = arriving.sparkSession
    folder, run = _run(arriving, checkpoint)

    def append(batch: DataFrame, number: int) -> None:
        name = runs.run_name(run, number)
        if runs.is_committed(spark, store, name):
            return
        others = [c for c in batch.columns if c != "sha256"]
        first = F.min(F.struct("landed_at", *[c for c in others if c != "landed_at"]))
        once = batch.groupBy("sha256").agg(first.alias("first")).select("sha256", "first.*")
        once = stage(once.withColumn("prefix", F.concat(F.lit("h"), F.left("sha256", F.lit(PREFIX)))))
        earlier = runs.read_runs(spark, store)
        if earlier is not None:
            # At most 256 prefixes, so that only their folders are opened.
            own = [r.prefix for r in once.select("prefix").distinct().collect()]
            once = once.join(earlier.where(F.col("prefix").isin(own)).select("sha256"), "sha256", "left_anti")
        runs.write_run(once, store, name, by="prefix")
        runs.merge_runs(spark, store, lambda rows: rows.hint("rebalance", "prefix"), by="prefix")

    _finish(
        arriving.writeStream.foreachBatch(append)
        .option("checkpointLocation", folder)
        .trigger(availableNow=True)
        .start()
    )
    stored = runs.read_runs(spark, store)
    return stored.drop("prefix") if stored is not None else spark.createDataFrame([], arriving.schema)


MONTH_SUMS = ("visits", "itemised", "unitemised", "summed", "saved", "stated")


def _summed(months: DataFrame) -> DataFrame:
    kinds = dict(months.dtypes)
    return months.groupBy("request_id", "month").agg(*[F.sum(c).cast(kinds[c]).alias(c) for c in MONTH_SUMS])


def stream_months(
    arriving_txns: DataFrame, items: DataFrame, store: str, checkpoint: str | None = None
) -> DataFrame:
    """ST-02: the month index over baskets as they arrive, late ones included.

    Every batch totals the lines of its own baskets alone, is reduced to months
    and stored as a run; runs are merged by summing them, and the months shown
    are the sums over the runs left, so no order of arrival matters.
    """
    spark = arriving_txns.sparkSession
    folder, run = _run(arriving_txns, checkpoint)

    def add(batch: DataFrame, number: int) -> None:
        name = runs.run_name(run, number)
        if runs.is_committed(spark, store, name):
            return
        batch = stage(batch)
        own = items.join(batch.select("txn_id"), "txn_id", "left_semi")
        lines = F.col("lines_disclosed")
        zero = F.lit(0).cast("decimal(18,2)")
        months = (
            settle(basket_totals(batch, own))
            .groupBy("request_id", F.left("occurred_at", F.lit(7)).alias("month"))
            .agg(
                F.count(F.lit(1)).alias("visits"),
                F.count_if(lines).alias("itemised"),
                F.count_if(~lines).alias("unitemised"),
                F.coalesce(F.sum(F.when(lines, F.col("paid_total"))), zero).alias("summed"),
                F.coalesce(F.sum(F.when(lines, F.col("saved_total"))), zero).alias("saved"),
                F.coalesce(F.sum(F.when(~lines, F.col("total_pre_discount"))), zero).alias("stated"),
            )
        )
        runs.write_run(months, store, name)
        runs.merge_runs(spark, store, _summed)

    _finish(
        arriving_txns.writeStream.foreachBatch(add)
        .option("checkpointLocation", folder)
        .trigger(availableNow=True)
        .start()
    )
    return _summed(runs.read_runs(spark, store)).withColumn(
        "paid", F.when(F.col("itemised") == 0, F.col("stated")).otherwise(F.col("summed"))
    ).drop("summed")
