"""Headline queries, timed end to end on one machine. Prints one JSON line.

Every query is run in full and its rows are counted by a sink that keeps none,
so the time is that of the whole result. Staged tables are part of each query's
own time; nothing is shared between queries.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from disclens.plans import QUERIES  # noqa: E402
from disclens.session import build_session  # noqa: E402

HEADLINE = [
    "agg_01_basket_totals",
    "agg_03_timeline",
    "agg_05_request_stats",
    "agg_15_month_index",
    "agg_20_compliance_matrix",
    "agg_24_compare",
    "agg_26_letter",
    "prd_07_product_index",
    "prc_10_price_shape",
    "prc_12_price_history",
    "ext_01_json_spans",
    "ext_03_page_markers",
    "ext_07_nested_baskets",
    "ext_13_lines_to_baskets",
    "ext_22_hint_grading",
    "ext_36_stitch",
    "ext_38_receipt_match",
    "gov_01_pii_scan_all_rules",
    "gov_07_denylist_scan",
    "gov_09_denylist_build",
    "gov_15_reconcile_verdict",
    "src_03_dup_across_store",
    "snk_05_ingest_summary",
    "st_02_stream_months",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    scratch = tempfile.mkdtemp(prefix="disclens-bench-")
    spark = build_session(
        "disclens-bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus if cpus.isdigit() else "8",
            "spark.driver.memory": os.environ.get("BENCH_MEMORY", "8g"),
            "spark.ui.enabled": "false",
            "spark.checkpoint.dir": scratch,
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()
    seconds = {}
    for name in names:
        begun = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - begun, 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline queries, total wall time",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
