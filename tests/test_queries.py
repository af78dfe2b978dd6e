"""A sample of the registered queries against their SQL; the driver compares all of them."""

import decimal
import os

import duckdb
import pytest

from disclens.plans import CHECKS, QUERIES

TABLES = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
NAMES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations").split()
SAMPLE = [
    "agg_02_basket_settle", "agg_05_request_stats", "agg_16_month_fill", "agg_20_compliance_matrix", "agg_26_letter", "prd_07_product_index",
    "prd_11_cap_summary", "prc_12_price_history", "ext_01_json_spans", "ext_03_page_markers", "ext_07_nested_warnings", "ext_13_line_warnings",
    "ext_36_stitch", "ext_41_itemise_overlay", "gov_07_denylist_scan", "gov_15_reconcile_verdict", "src_03_dup_across_store", "st_01_stream_dedup",
]


@pytest.fixture(scope="module")
def duck():
    if not os.path.isdir(TABLES):
        pytest.skip("no test tables here")
    con = duckdb.connect()
    for name in NAMES:
        con.execute(f"create view {name} as select * from '{TABLES}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, decimal.Decimal):
        return float(value)
    return round(value, 9) + 0.0 if isinstance(value, float) else value


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_its_sql(spark, duck, name):
    df = QUERIES[name](spark, TABLES)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    cursor = duck.execute(CHECKS[name])
    order = [d[0] for d in cursor.description]
    assert sorted(order) == columns
    wanted = sorted((tuple(plain(r[order.index(c)]) for c in columns) for r in cursor.fetchall()), key=repr)
    assert got == wanted


def test_names_and_checks_fit():
    assert set(CHECKS) <= set(QUERIES)
    assert set(QUERIES) - set(CHECKS) == {"gov_01_pii_scan_all_rules", "gov_09_denylist_build_all_rules"}
