import io
import zipfile

import pytest
from helpers import items, money, txns
from pyspark.sql import functions as F

from disclens.operators import disclosure as dis
from disclens.operators.baskets import basket_totals, month_index, request_stats, settle, specific_pieces
from disclens.operators.products import index_totals, product_dim
from disclens.sources import landing, sinks
from disclens.streaming import runs
from disclens.streaming.jobs import stream_dedup, stream_months


def disclosures(spark, *rows):
    return spark.createDataFrame(list(rows), "request_id bigint, category string, status string, notes string, ordinal int")


def requests(spark, *ids):
    return spark.createDataFrame(
        [(i, "north", f"R{i}", "REF-1" if i == 1 else None) for i in ids],
        "request_id bigint, retailer_id string, display_name string, report_reference string",
    )


def test_partial_counts_as_disclosed_only_with_purchases(spark, rows):
    told = disclosures(
        spark, (1, "SPECIFIC_PIECES", "provided", None, 4), (2, "SPECIFIC_PIECES", "partial", None, 4),
        (3, "SPECIFIC_PIECES", "partial", None, 4), (4, "SPECIFIC_PIECES", "absent", None, 4),
    )
    shopped = txns(spark, (1, 3, "2020-01-01", None), (2, 4, "2020-01-01", None))
    got = specific_pieces(requests(spark, 1, 2, 3, 4, 5), told, shopped)
    assert rows(got, "request_id", "disclosed", "zero_claimable") == [
        (1, True, True), (2, False, False), (3, True, False), (4, False, False), (5, False, False),
    ]


def test_a_partly_itemised_request_pays_its_stated_totals(spark):
    lines = items(spark, ("a", 1, 1, "A", "1", None, 5, 4))
    visits = txns(spark, (1, 1, "2020-01-01", None), (2, 1, "2020-01-02", 30))
    told = disclosures(spark, (1, "SPECIFIC_PIECES", "provided", None, 4))
    row = request_stats(requests(spark, 1), visits, lines, told, index_totals(product_dim(lines, visits))).first()
    assert (row.total_paid, row.total_shelf, row.total_saved) == (money(35), money(5), money(1))
    assert (row.itemised_count, row.basket_count, row.distinct_products) == (1, 2, 1)


def test_silence_is_not_assessed_and_not_absent(spark):
    told = disclosures(spark, (1, "SOURCES", "absent", "n", 1), (1, "RETENTION_PERIOD", "absent", "n", 7), (1, "ODD", "absent", "n", 9))
    row = dis.compliance_matrix(requests(spark, 1), told).first()
    assert (row.absent_count, row.unassessed_count, row.sources, row.specific_pieces) == (2, 6, "absent", None)


def stored(spark, folder, *tables):
    """The tables as parquet files, of which Spark knows the size."""
    for n, table in enumerate(tables):
        table.write.parquet(f"{folder}/{n}")
    return [spark.read.parquet(f"{folder}/{n}") for n in range(len(tables))]


def is_broadcast(df):
    return "Broadcast" in df._jdf.queryExecution().executedPlan().toString()


def test_categories_are_never_sent_whole_to_each_executor(spark, rows, tmp_path):
    told = disclosures(spark, (1, "SOURCES", "absent", "n", 1), (1, "RETENTION_PERIOD", "absent", "n", 7), (1, "SOURCES", "absent", "n", 1))
    asked, told = stored(spark, tmp_path, requests(spark, 1, 2), told)
    cells, notes = dis.compliance_cells(asked, told), dis.shared_note(dis.compliance_cells(asked, told))
    whole = dis.absent_completion(told.select("request_id", "category", "status", F.lit("e").alias("evidence")), asked, "request_id")
    assert not any(is_broadcast(df) for df in (cells, notes, whole))
    assert cells.count() == 17 and cells.where("status = 'absent'").count() == 3


def test_gathered_letters_are_never_sent_whole_to_each_executor(spark, tmp_path):
    told = disclosures(spark, (1, "SOURCES", "partial", None, 1))
    asks = spark.createDataFrame([(1, "clarification", 1, "First?")], "request_id bigint, kind string, ord int, question string")
    asked, told, asks = stored(spark, tmp_path, requests(spark, 1, 2), told, asks)
    assert not is_broadcast(dis.letters(asked, told, asks)) and dis.letters(asked, told, asks).count() == 2


def test_letter_lists_absent_before_partial_and_numbers_questions(spark):
    told = disclosures(spark, (1, "SOURCES", "partial", None, 1), (1, "RETENTION_PERIOD", "absent", None, 7))
    asks = spark.createDataFrame(
        [(1, "clarification", 2, "Second?"), (1, "clarification", 1, "First?"), (1, "supplemental_period", 0, None)],
        "request_id bigint, kind string, ord int, question string",
    )
    text = dis.letters(requests(spark, 1, 2), told, asks).orderBy("request_id").collect()
    first = text[0].letter
    assert first.startswith("To: R1 Privacy Office\nSubject: Supplemental request under the CCPA (your reference REF-1)\n\nHello,\n")
    assert first.index("how long you retain") < first.index("the categories of sources")
    assert "  1. First?\n  2. Second?\n" in first and "earlier period" in first
    assert "asks about what it left unclear" in text[0].note
    assert "addressed each of the categories" in text[1].letter and "asks about" not in text[1].note


def test_scope_notes(spark, rows):
    held = spark.createDataFrame(
        [(1, "household"), (1, None), (2, None), (3, None), (3, "individual"), (4, "individual")], "request_id bigint, scope string"
    )
    assert rows(dis.scope_note(requests(spark, 1, 2, 3, 4, 5), held), "request_id", "scope_note") == [
        (1, "1 household-scoped"), (2, "scope not stated"), (3, "1 with no scope stated"), (4, "all individual"), (5, ""),
    ]


def test_gauges_need_a_dash(spark):
    df = spark.createDataFrame([(4.0, "ordinal 1-7"), (9.0, "1–7"), (4.0, "ordinal_1_7"), (None, "1-7")], "v double, s string")
    assert [r.g for r in df.select(dis.gauge_position(F.col("v"), F.col("s")).alias("g")).collect()] == [50, 100, None, None]


def zipped(*names):
    """A real zip of the given names; one of bytes is a stored zip of that content under it."""
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as package:
        for name in names:
            package.writestr("stored" if isinstance(name, bytes) else name, name if isinstance(name, bytes) else "x" * 100)
    return bytearray(held.getvalue())


def test_files_are_known_by_content(spark, rows):
    files = spark.createDataFrame(
        [
            ("a.txt", bytearray(b"%PDF-1.7")), ("b", bytearray(b"\x89PNG\r\n\x1a\nxx")), ("c.xls", zipped("xl/workbook.xml", "a.xml")), ("h.bin", zipped("b/xl/workbook.xml")), ("i.bin", zipped("c", b"xl/workbook.xml" * 9)), ("j.bin", bytearray(b"PK\x03\x04xl/workbook.xml")),
            ("d.docx", bytearray(b"PK\x03\x04..word/..")), ("e.md", bytearray(b"")), ("f.bin", bytearray(b"\x00\x01")),
            ("g.xls", bytearray(b'<?xml version="1.0"?><W xmlns="urn:schemas-microsoft-com:office:spreadsheet"/>')),
        ],
        "original_filename string, content binary",
    )
    got = landing.doc_manifest(files)
    assert rows(got, "original_filename", "kind", "refused") == [
        ("a.txt", "pdf", False), ("b", "image/png", False), ("c.xls", "xlsx", False), ("d.docx", "archive", False),
        ("e.md", "text", True), ("f.bin", "unsupported", False), ("g.xls", "spreadsheetml", False),
        ("h.bin", "archive", False), ("i.bin", "archive", False), ("j.bin", "archive", False),
    ]


def test_landed_files_are_read_whole(spark, tmp_path, rows):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "note.txt").write_bytes(b"hello")
    assert rows(landing.doc_manifest(landing.landed_files(spark, str(tmp_path))), "original_filename", "size", "media_type") == [
        ("note.txt", 5, "text/plain")
    ]


def test_a_crowded_basket_comes_in_parts_and_whole(spark):
    lines = items(spark, *[(f"i{n:03}", 1 + n // 250, 1, "A", "1", None, 1, 1) for n in range(260)]).drop("request_id")
    visits = txns(spark, (1, 1, "2020-01-01", 5), (2, 1, "2020-01-01", 5), (3, 1, "2020-01-01", 5))
    nested = sinks.load_result(visits, lines, most=50)
    assert nested.groupBy("txn_id").count().orderBy("txn_id").collect()[0]["count"] == 5
    flat = sinks.flatten_result(nested)
    assert flat["txn"].count() == 3 and flat["txn_item"].select("item_id").distinct().count() == 260


def test_cascade_and_dangling(spark, rows):
    lines = items(spark, ("a", 1, 1, "A", "1", None, 5, 4), ("c", 2, 2, "C", "1", None, 1, 1))
    visits = txns(spark, (1, 1, "2020-01-01", 5), (2, 2, "2020-01-02", 6))
    gone = requests(spark, 1)
    left = sinks.delete_cascade({"txn": visits, "txn_item": lines}, gone)
    assert rows(left["txn_item"], "item_id") == [("c",)]
    assert rows(sinks.dangling_refs([("txn_item", lines, "txn_id", left["txn"], "txn_id")]), "table", "ref", "rows") == [("txn_item", 1, 1)]


def test_a_place_outside_the_upload_means_its_first_document(spark, rows):
    records = spark.createDataFrame([(1, 1, 1), (2, 1, 7), (3, 1, None), (4, 2, 0)], "id int, request_id int, position int")
    documents = spark.createDataFrame([(10, 1, 0), (11, 1, 1)], "source_document_id int, request_id int, position int")
    assert rows(sinks.resolve_doc_id(records, documents), "id", "resolved_id") == [(1, 11), (2, 10), (3, 10), (4, None)]


@pytest.fixture
def inbox(spark, tmp_path):
    path = tmp_path / "inbox"

    def land(df):
        df.coalesce(1).write.mode("append").parquet(str(path))

    return path, land


def test_streamed_documents_are_stored_once(spark, tmp_path, inbox, rows):
    path, land = inbox
    schema = "landed_at timestamp, sha256 string, name string"
    make = lambda *r: spark.createDataFrame(list(r), "at string, sha256 string, name string").select(
        F.to_timestamp("at").alias("landed_at"), "sha256", "name"
    )
    store = str(tmp_path / "store")
    land(make(("2020-01-01", "x", "first"), ("2020-01-01", "x", "copy"), ("2020-01-01", "y", "other")))
    stream = lambda: spark.readStream.schema(schema).parquet(str(path))
    assert rows(stream_dedup(stream(), store).select("sha256"), "sha256") == [("x",), ("y",)]
    land(make(("2021-06-01", "x", "late copy"), ("2021-06-01", "z", "new")))
    # A new run sees everything again: the store, not the stream, is the truth.
    assert rows(stream_dedup(stream(), store).select("sha256"), "sha256") == [("x",), ("y",), ("z",)]


def test_a_restarted_stream_goes_on_where_it_stopped(spark, tmp_path, inbox, rows):
    path, land = inbox
    make = lambda *r: spark.createDataFrame(list(r), "at string, sha256 string").select(
        F.to_timestamp("at").alias("landed_at"), "sha256"
    )
    stream = lambda: spark.readStream.schema("landed_at timestamp, sha256 string").parquet(str(path))
    store, checkpoint = str(tmp_path / "store"), str(tmp_path / "run-a")
    land(make(("2020-01-01", "x")))
    stream_dedup(stream(), store, checkpoint=checkpoint)
    land(make(("2020-01-01", "x"), ("2020-01-02", "y")))
    assert rows(stream_dedup(stream(), store, checkpoint=checkpoint).select("sha256"), "sha256") == [("x",), ("y",)]


def test_streamed_months_equal_the_batch_whatever_the_order(spark, tmp_path, inbox, rows):
    path, land = inbox
    lines = items(spark, ("a", 1, 1, "A", "1", None, 5, 4))
    visits = txns(spark, (1, 1, "2020-03-05", 5), (2, 1, "2020-01-09", 50), (3, 1, "2020-03-01", 7))
    for n in (3, 1, 2):
        land(visits.where(F.col("txn_id") == n))
    stream = spark.readStream.schema(visits.schema).option("maxFilesPerTrigger", 1).parquet(str(path))
    streamed = stream_months(stream, lines, str(tmp_path / "months"))
    columns = ("request_id", "month", "visits", "itemised", "unitemised", "paid", "stated")
    assert rows(streamed, *columns) == rows(month_index(settle(basket_totals(visits, lines))), *columns)


def test_a_basket_of_any_size_is_one_row(spark):
    lines = items(spark, *[(f"i{n:05}", 1, 1, "A", "1", None, 1, 1) for n in range(10_001)]).drop("request_id")
    nested = sinks.load_result(txns(spark, (1, 1, "2020-01-01", 5)), lines).collect()
    assert [(r.part, len(r["items"])) for r in nested] == [(0, 10_001)]


def test_a_prologue_that_cuts_a_character_is_read(spark):
    opening = '<?xml version="1.0"?><W xmlns="urn:schemas-microsoft-com:office:spreadsheet">'
    content = (opening + "x" * (4095 - len(opening)) + "é").encode() * 2
    files = spark.createDataFrame([("a.xls", bytearray(content))], "original_filename string, content binary")
    assert landing.doc_manifest(files).first().kind == "spreadsheetml"


def test_what_a_batch_reads_does_not_grow_with_the_batches(spark, tmp_path, inbox, rows):
    """24 batches, each with a document of its own and one that came before."""
    path, land = inbox
    store, schema = str(tmp_path / "store"), "landed_at timestamp, sha256 string"
    for n in range(24):
        own = [(f"2020-01-{n + 1:02}", f"{n:02x}rest{n}"), (f"2020-02-{n + 1:02}", "00rest0")]
        land(spark.createDataFrame(own, "at string, sha256 string").select(F.to_timestamp("at").alias("landed_at"), "sha256"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(path))
    stored = stream_dedup(stream, store)
    assert rows(stored, "sha256") == sorted((f"{n:02x}rest{n}",) for n in range(24))
    assert len(runs.live_runs(spark, store)) <= 6
    one = runs.read_runs(spark, store).where("prefix = 'h05'")
    assert len({f for f in one.inputFiles() if "prefix=h05" in f}) == 1
    scan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(prefix" in scan
    assert runs.drop_merged(spark, store) > 12
    assert runs.read_runs(spark, store).count() == 24


def test_a_batch_that_is_run_again_stores_nothing_twice(spark, tmp_path):
    store, given = str(tmp_path / "store"), spark.createDataFrame([(1,)], "n int")
    name = runs.run_name("a", 3)
    assert not runs.is_committed(spark, store, name) and runs.read_runs(spark, store) is None
    given.write.parquet(f"{store}/rows/run={name}")  # broken off before it was committed
    assert runs.read_runs(spark, store) is None
    runs.write_run(given, store, name)
    assert runs.is_committed(spark, store, name) and runs.read_runs(spark, store).count() == 1
