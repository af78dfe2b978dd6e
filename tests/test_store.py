import pytest
from helpers import items, plan_of, txns
from pyspark.sql import functions as F

from disclens.sources import files, store
from disclens.sources.canonical import Canonical


def tables(spark, *ids, identities=3, baskets=2, lines=2):
    """Requests with children in all nine tables."""
    make = lambda rows, schema: spark.createDataFrame(rows, schema)
    per = lambda n: [(i, k) for i in ids for k in range(n)]
    number = lambda i, k: i * 100 + k
    return {
        "request": make([(i, f"shop {i}") for i in ids], "request_id long, display_name string"),
        "source_document": make([(i, number(i, k), f"f{k}.txt") for i, k in per(2)], "request_id long, source_document_id long, original_filename string"),
        "identity": make([(i, number(i, k), "email", f"v{k}") for i, k in per(identities)], "request_id long, identity_seq long, id_type string, value string"),
        "txn": txns(spark, *[(number(i, k), i, f"2020-01-{k + 1:02}", 5) for i, k in per(baskets)]),
        "txn_item": items(spark, *[(f"i{number(i, k)}-{n:05}", number(i, k), i, "A", "1", None, 5, n) for i, k in per(baskets) for n in range(lines)]),
        "inference": make([(i, number(i, 0), "Cat owner", None) for i in ids], "request_id long, inference_seq long, label string, value_num double"),
        "disclosure": make([(i, k, f"c{k}") for i, k in per(8)], "request_id long, ordinal int, category string"),
        "follow_up": make([(i, 0, None) for i in ids], "request_id long, ord int, question string"),
        "parse_warning": make([(i, f"s{k}", "m") for i, k in per(2)], "request_id long, seq string, message string"),
    }


def content(found, names=store.TABLES):
    return {n: sorted((tuple(r[c] for c in sorted(found[n].columns)) for r in found[n].collect()), key=repr) for n in names if n in found}


def test_a_round_trip_gives_nine_tables_back(spark, tmp_path):
    given, root = tables(spark, 1, 2, 3), str(tmp_path)
    store.save_requests(store.flatten_requests(store.nest_requests(given)), root)
    assert content(store.stored_tables(spark, root)) == content(given)
    assert set(content(given)) == set(store.TABLES)


def test_a_second_save_takes_old_children_away_and_keeps_other_requests(spark, tmp_path):
    root, first = str(tmp_path), tables(spark, 1, 2)
    store.save_requests(first, root)
    second = tables(spark, 2, 3, identities=1, baskets=1)
    del second["follow_up"]
    store.save_requests(second, root)
    found = content(store.stored_tables(spark, root))
    for name in store.TABLES:
        old = content({name: first[name].where("request_id = 1")})[name]
        new = content({name: second[name]})[name] if name in second else []
        assert found[name] == sorted(old + new, key=repr)


def test_a_save_that_breaks_off_leaves_what_was_there(spark, tmp_path):
    root, first = str(tmp_path), tables(spark, 1, 2)
    store.save_requests(first, root)
    broken = tables(spark, 1, identities=1)
    broken["parse_warning"] = broken["parse_warning"].withColumn("message", F.raise_error(F.lit("lost")).cast("string"))
    with pytest.raises(Exception, match="lost"):
        store.save_requests(broken, root)
    assert content(store.stored_tables(spark, root)) == content(first)
    assert store.save_requests(tables(spark, 9), root) == 3  # its number is not used again


def test_rows_of_requests_that_are_not_saved_stay_out(spark, tmp_path):
    root, given = str(tmp_path), tables(spark, 1, 2)
    store.save_requests(given | {"request": given["request"].where("request_id = 1")}, root)
    found = store.stored_tables(spark, root)
    assert all({r.request_id for r in df.select("request_id").collect()} == {1} for df in found.values())


def test_removed_requests_are_gone_and_may_come_back(spark, tmp_path):
    root, given = str(tmp_path), tables(spark, 1, 2)
    assert store.stored_tables(spark, root) == {}
    store.save_requests(given, root)
    store.remove_requests(spark.createDataFrame([(2,), (7,)], "request_id long"), root)
    assert content(store.stored_tables(spark, root)) == content({n: df.where("request_id = 1") for n, df in given.items()})
    store.save_requests(tables(spark, 2, identities=1), root)
    assert store.stored_tables(spark, root)["identity"].where("request_id = 2").count() == 1


def test_compaction_keeps_the_rows_and_a_save_that_was_under_way(spark, tmp_path):
    root = str(tmp_path)
    store.save_requests(tables(spark, 1, 2, 4), root)
    late = store.write_version(tables(spark, 4, identities=2), root)
    store.save_requests(tables(spark, 2, identities=1), root)
    store.remove_requests(spark.createDataFrame([(1,), (4,)], "request_id long"), root)
    before = content(store.stored_tables(spark, root))
    assert store.compact(spark, root) is not None
    assert len(store.visible_versions(spark, root)) == 1
    assert content(store.stored_tables(spark, root)) == before
    assert store.compact(spark, root) is None
    assert store.drop_merged(spark, root) == 3
    assert content(store.stored_tables(spark, root)) == before
    store.commit(spark, root, late)  # began before the removal, so it stays removed
    assert content(store.stored_tables(spark, root)) == before
    store.save_requests(tables(spark, 4), root)
    assert store.stored_tables(spark, root)["identity"].where("request_id = 4").count() == 3


def test_two_saves_get_two_numbers(spark, tmp_path):
    assert files.create(spark, f"{tmp_path}/claims/0000000001")
    assert not files.create(spark, f"{tmp_path}/claims/0000000001")
    assert store.save_requests(tables(spark, 1), str(tmp_path)) == 2


def test_a_large_request_comes_in_parts_of_bounded_size(spark):
    given = tables(spark, 1, 2, baskets=3, lines=1)
    given["txn_item"] = given["txn_item"].unionByName(items(spark, *[(f"big{n:05}", 100, 1, "A", "1", None, 1, 1) for n in range(900)]))
    nested = store.nest_requests(given, most=50)
    sizes = nested.select("request_id", F.size("identity") + F.aggregate("txn", F.lit(0), lambda s, x: s + F.size(x["items"])).alias("n")).collect()
    assert max(r[1] for r in sizes) < 200 and sum(r.request_id == 1 for r in sizes) > 8
    assert sum(r.request_id == 2 for r in sizes) == 1
    assert nested.where("request is not null").count() == 2
    assert content(store.flatten_requests(nested)) == content(given)


def test_requests_without_children_and_without_tables(spark):
    given = tables(spark, 1)
    alone = {"request": given["request"], "txn": given["txn"].limit(0), "txn_item": given["txn_item"].limit(0)}
    nested = store.nest_requests(alone).collect()
    assert [(r.request_id, r.request.display_name, r.txn) for r in nested] == [(1, "shop 1", [])]
    assert store.nest_requests({"request": given["request"].limit(0)}).collect() == []
    back = store.flatten_requests(store.nest_requests({n: given[n] for n in ("request", "txn")}))
    assert content(back, ("txn",)) == content(given, ("txn",))


def test_lines_are_gathered_into_baskets_once(spark):
    given = tables(spark, 1, 2)
    nested = store.nest_requests(given)
    assert "FullOuter" not in plan_of(nested) and content(store.flatten_requests(nested)) == content(given)


def test_lines_and_visits_are_written_once_for_queries_that_read_them_often(spark, rows, tmp_path):
    day = "timestamp'1996-01-02 00:00:00'"
    made = {
        "orders": f"select 8 as o_orderkey, 4 as o_custkey, {day} as o_orderdate, 'O' as o_orderstatus, '1-URGENT' as o_orderpriority, 50.0D as o_totalprice",
        "lineitem": f"select 8 as l_orderkey, 3 as l_partkey, 2 as l_suppkey, 1 as l_linenumber, 2.0D as l_quantity, 9.0D as l_extendedprice, 0.1D as l_discount,"
        f" 'N' as l_returnflag, 'O' as l_linestatus, {day} as l_shipdate",
        "part": "select 3 as p_partkey, 'tin nut' as p_name",
    }
    for name, text in made.items():
        spark.sql(text).write.parquet(f"{tmp_path}/{name}.parquet")
    plain = Canonical(spark, str(tmp_path))
    held = plain.with_lines()
    for was, now in ((plain.txn_item(), held.txn_item()), (plain.txn(), held.txn()), (plain.parse_warning(), held.parse_warning())):
        assert "Join" not in plan_of(now) and rows(was, *was.columns) == rows(now, *was.columns)
    assert held.txn_item().count() == held.txn().count() == 1
