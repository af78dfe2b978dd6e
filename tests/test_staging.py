import os
from urllib.parse import urlparse

import pytest
from pyspark.sql import functions as F

from disclens.llm import fuzzy_lines
from disclens.llm.shared import ID, TEXT
from disclens.sources import staging, store


@pytest.fixture
def folder(monkeypatch, tmp_path):
    monkeypatch.setattr(staging, "shared_folder", lambda spark: f"file://{tmp_path}")
    return tmp_path


def shuffle_files(spark):
    held = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {held.apply(i).getName() for i in range(held.size()) if held.apply(i).getName().startswith("shuffle_")}


def test_a_staged_result_leaves_no_shuffle_files(spark, folder):
    before = spark.conf.get(staging.CLEANUP)
    held = shuffle_files(spark)
    totals = spark.range(5000).groupBy((F.col("id") % 70).alias("k")).agg(F.sum("id").alias("s"))
    found = staging.stage(totals.join(totals.withColumnRenamed("s", "t").hint("merge"), "k"))
    assert shuffle_files(spark) <= held
    assert found.count() == 70 and found.agg(F.sum("s")).first()[0] == sum(range(5000))
    assert spark.conf.get(staging.CLEANUP) == before


def test_only_staged_results_are_discarded(spark, folder):
    spark.range(3).write.parquet(f"{folder}/given")
    given, held = spark.read.parquet(f"{folder}/given"), staging.stage(spark.range(4))
    place = urlparse(held.inputFiles()[0]).path
    staging.discard(given, held)
    assert given.count() == 3 and not os.path.exists(os.path.dirname(place))


def test_meeting_places_are_gone_when_lines_are_compared(spark, folder):
    common = "the quick brown fox jumps over the lazy dog near the old river bank today"
    rows = [(n, f"{common} number{n}\nonly text {n} has {n * 7} of this line and nothing like it is here {n * 31}") for n in range(40)]
    kept = fuzzy_lines.without_repeated_lines(spark.createDataFrame(rows, f"{ID} long, {TEXT} string"), budget=None)
    texts = {r[ID]: r[TEXT] for r in kept.collect()}
    assert sum(common in t for t in texts.values()) == 1 and common in texts[0]
    left = [spark.read.parquet(f"file://{p}") for p in (folder / "staged").iterdir()]
    assert left and not any({"meet", "meets"} & set(x.columns) for x in left)


def test_a_saved_version_leaves_no_shuffle_files(spark, folder, tmp_path):
    held = shuffle_files(spark)
    requests = spark.range(6).withColumnRenamed("id", "request_id")
    visits = spark.range(30).select(F.col("id").alias("txn_id"), (F.col("id") % 6).alias("request_id"))
    store.save_requests({"request": requests, "txn": visits.hint("merge")}, f"file://{tmp_path}/saved")
    assert shuffle_files(spark) <= held
    assert store.stored_tables(spark, f"file://{tmp_path}/saved")["txn"].count() == 30


def test_baskets_are_stored_with_the_parts_of_their_request(spark, folder):
    requests = spark.range(2).withColumnRenamed("id", "request_id")
    visits = spark.range(9).select(F.col("id").alias("txn_id"), F.lit(1).cast("long").alias("request_id"))
    lines = spark.range(40).select(F.concat(F.lit("i"), F.col("id") + 10).alias("item_id"), (F.col("id") % 8).alias("txn_id"))
    nested = store.nest_requests({"request": requests, "txn": visits, "txn_item": lines}, most=16)
    wide = [x for x in (spark.read.parquet(f"file://{p}") for p in (folder / "staged").iterdir()) if "items" in x.columns]
    assert len(wide) == 1 and "parts" in wide[0].columns and "parts" not in nested.schema["txn"].dataType.elementType.names
    flat = store.flatten_requests(nested)
    assert flat["txn"].count() == 9 and flat["txn_item"].count() == 40
    assert nested.where("request_id = 1").count() > 1 and nested.where("request_id = 0").count() == 1
