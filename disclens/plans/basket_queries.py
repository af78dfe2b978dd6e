"""Queries over baskets, headers and months, with the SQL each is checked against."""

from __future__ import annotations

from pyspark.sql import functions as F

from disclens.operators import baskets as ops
from disclens.operators import products as prod
from disclens.operators.scale import top_n
from disclens.plans.registry import query
from disclens.plans.sql_views import VIEWS
from disclens.sources.canonical import with_tables


def sql(text: str, *names: str) -> str:
    return with_tables(text, *names, extra=VIEWS)


def money(*names: str) -> list:
    return [F.col(n).cast("double").alias(n) for n in names]


def money_sql(*names: str) -> str:
    return ", ".join(f"cast({n} as double) as {n}" for n in names)


@query(
    "prj_01_paid_saved_line",
    sql(
        """select item_id, cast(coalesce(loyalty_amt, retail_amt) as double) as paid_amt,
        cast(retail_amt - coalesce(loyalty_amt, retail_amt) as double) as saved_amt from txn_item""",
        "txn_item",
    ),
)
def paid_saved_line(t):
    return ops.line_amounts(t.txn_item()).select("item_id", *money("paid_amt", "saved_amt"))


@query(
    "prj_02_provenance",
    sql("select txn_id, source_document_id, page, locator from txn", "txn"),
)
def provenance(t):
    folded = t.txn().select("txn_id", F.struct("source_document_id", "page", "locator").alias("provenance"))
    return folded.select("txn_id", "provenance.*")


@query(
    "prj_03_product_key",
    sql(
        """select item_id, case when upc is not null and upc <> '' then upc
        when description_raw <> '' then description_raw end as product_key from txn_item""",
        "txn_item",
    ),
)
def product_key(t):
    from disclens.functions.amounts import product_key as key

    return t.txn_item().select("item_id", key().alias("product_key"))


@query(
    "flt_01_timeline_filter",
    sql(
        """select txn_id, request_id, occurred_at, store_code from txn where store_code = '5-LOW'
        and occurred_at >= '1996-03-01' and occurred_at <= '1999-06-30T23:59:59'""",
        "txn",
    ),
)
def timeline_filter(t):
    kept = ops.timeline_filter(t.txn(), store="5-LOW", date_from="1996-03-01", date_to="1999-06-30")
    return kept.select("txn_id", "request_id", "occurred_at", "store_code")


@query(
    "flt_02_basket_search",
    sql(
        """select txn_id, request_id from txn t where exists (select 1 from txn_item i where i.txn_id = t.txn_id
        and (i.description_raw ilike '%red b%' or i.upc ilike '%red b%'))""",
        "txn",
    ),
)
def basket_search(t):
    return ops.basket_search(t.txn(), t.txn_item(), "Red B").select("txn_id", "request_id")


@query(
    "flt_05_purchase_predicate",
    sql("select item_id, product_key from purchase", "purchase"),
)
def purchase_predicate(t):
    return prod.purchases(t.txn_item()).select("item_id", "product_key")


@query(
    "flt_06_store_visits",
    sql(
        """select request_id, store_code, count(*) as visits from txn where store_code is not null
        group by 1, 2""",
        "txn",
    ),
)
def store_visits(t):
    return ops.store_visits(t.txn())


@query(
    "srt_04_stores_by_visits",
    sql(
        """select request_id, store_code, visits, row_number() over (partition by request_id
          order by visits desc, store_code) as place
        from (select request_id, store_code, count(*) as visits from txn where store_code is not null group by 1, 2)""",
        "txn",
    ),
)
def stores_by_visits(t):
    from pyspark.sql import Window

    # Stores of a request, already counted: a handful of rows per window.
    order = Window.partitionBy("request_id").orderBy(F.col("visits").desc(), "store_code")
    return ops.store_visits(t.txn()).withColumn("place", F.row_number().over(order).cast("bigint"))


@query(
    "agg_01_basket_totals",
    sql(f"select txn_id, item_count, shelf_lines, {money_sql('shelf_total', 'paid_total')} from raw_basket", "raw_basket"),
)
def basket_totals(t):
    return ops.basket_totals(t.txn(), t.txn_item()).select(
        "txn_id", "item_count", "shelf_lines", *money("shelf_total", "paid_total")
    )


SETTLED_SQL = f"""select txn_id, request_id, lines_disclosed, {money_sql('shelf_total', 'paid_total', 'saved_total')},
    cast(delta as double) as stated_pre_discount_delta"""


def settled(t):
    return ops.settle(ops.basket_totals(t.txn(), t.txn_item()))


@query("agg_02_basket_settle", sql(SETTLED_SQL + " from settled", "settled"))
def basket_settle(t):
    return settled(t).select(
        "txn_id", "request_id", "lines_disclosed",
        *money("shelf_total", "paid_total", "saved_total", "stated_pre_discount_delta"),
    )


@query(
    "agg_03_timeline",
    sql(
        SETTLED_SQL
        + """, count(*) over (partition by request_id) as filtered_count from settled
        where occurred_at between '1996-01-01' and '2000-12-31T23:59:59'
        and txn_id in (select txn_id from txn_item where lower(description_raw) like '%anvil%'
                       or lower(upc) like '%anvil%')""",
        "settled",
    ),
)
def timeline(t):
    shown = ops.timeline(
        t.txn(), t.txn_item(), query="ANVIL", date_from="1996-01-01", date_to="2000-12-31"
    )
    return shown.select(
        "txn_id", "request_id", "lines_disclosed",
        *money("shelf_total", "paid_total", "saved_total", "stated_pre_discount_delta"),
        "filtered_count",
    )


@query(
    "agg_04_basket_detail",
    sql(
        f"""select i.item_id, i.txn_id, cast(coalesce(i.loyalty_amt, i.retail_amt) as double) as paid_amt,
        cast(i.retail_amt - coalesce(i.loyalty_amt, i.retail_amt) as double) as saved_amt, s.item_count,
        {money_sql('shelf_total', 'paid_total', 'saved_total')}
        from txn_item i join settled s on s.txn_id = i.txn_id""",
        "settled",
    ),
)
def basket_detail(t):
    return ops.basket_detail(t.txn(), t.txn_item()).select(
        "item_id", "txn_id", "item_count", *money("paid_amt", "saved_amt", "shelf_total", "paid_total", "saved_total")
    )


def stats(t):
    # Headline, baskets and index read the lines, visits and scope: written once.
    t = t.with_lines()
    items, txns = t.txn_item(), t.txn()
    totals = prod.index_totals(prod.product_dim(items, txns))
    return ops.request_stats(t.request(), txns, items, t.disclosure(), totals)


STAT_MONEY = ("total_stated", "total_shelf", "total_paid", "total_saved")
STATS_SQL = """
  select request_id, case when disclosed then basket_count end as basket_count,
    case when disclosed then first_visit end as first_visit, case when disclosed then last_visit end as last_visit,
    case when disclosed and line_count > 0 then line_count end as line_count,
    case when disclosed and line_count > 0 then itemised_count end as itemised_count,
    case when disclosed and line_count > 0 then zero_value_lines end as zero_value_lines,
    case when disclosed and line_count > 0 then negative_lines end as negative_lines,
    case when disclosed and line_count > 0 then products end as distinct_products,
    cast(case when disclosed then total_stated end as double) as total_stated,
    cast(case when disclosed and line_count > 0 then shelf end as double) as total_shelf,
    cast(case when disclosed then case when line_count = 0 or itemised_count < basket_count then across
         else paid end end as double) as total_paid,
    cast(case when disclosed and line_count > 0 then shelf - shelved_paid end as double) as total_saved,
    line_count > 0 as lines_disclosed, disclosed, zero_claimable
  from (
    select r.request_id, p.disclosed, p.zero_claimable, coalesce(basket_count, 0) as basket_count, first_visit, last_visit,
      coalesce(line_count, 0) as line_count, coalesce(itemised_count, 0) as itemised_count,
      coalesce(zero_value_lines, 0) as zero_value_lines, coalesce(negative_lines, 0) as negative_lines,
      coalesce(products, 0) as products, coalesce(total_stated, 0) as total_stated, shelf, shelved_paid,
      coalesce(across, 0) as across, coalesce(paid, 0) as paid
    from request r join pieces p on p.request_id = r.request_id
    left join (select b.request_id, count(*) as basket_count, min(occurred_at) as first_visit, max(occurred_at) as last_visit,
        sum(item_count) as line_count, count(*) filter (item_count > 0) as itemised_count,
        sum(total_pre_discount) as total_stated, sum(paid_total) as paid,
        sum(shelf_total) filter (shelf_lines > 0) as shelf, sum(paid_total) filter (shelf_lines > 0) as shelved_paid,
        sum(coalesce(total_pre_discount, (select sum(retail_amt) from txn_item i where i.txn_id = b.txn_id))) as across
      from raw_basket b group by 1) b on b.request_id = r.request_id
    left join (select request_id, count(*) filter (coalesce(retail_amt, loyalty_amt) = 0) as zero_value_lines,
        count(*) filter (coalesce(retail_amt, loyalty_amt) < 0) as negative_lines from txn_item group by 1) l
      on l.request_id = r.request_id
    left join (select request_id, count(*) filter (not refused) as products from dim group by 1) d
      on d.request_id = r.request_id)
"""


@query("agg_05_request_stats", sql(STATS_SQL, "pieces", "raw_basket", "dim"))
def request_stats(t):
    wide = stats(t)
    return wide.select(*[c for c in wide.columns if c not in STAT_MONEY], *money(*STAT_MONEY))


@query(
    "agg_06_across_visits",
    sql(
        """select request_id, cast(coalesce(sum(coalesce(total_pre_discount, summed)), 0) as double) as across_visits
        from txn t left join (select txn_id, sum(retail_amt) as summed from txn_item where retail_amt is not null
          group by 1) l on l.txn_id = t.txn_id group by 1""",
        "txn",
    ),
)
def across_visits(t):
    return ops.across_visits(ops.basket_totals(t.txn(), t.txn_item())).select(
        "request_id", *money("across_visits")
    )


@query(
    "agg_07_shelved_totals",
    sql(
        """select request_id, cast(sum(shelf_total) as double) as shelved_shelf,
        cast(sum(paid_total) as double) as shelved_paid from raw_basket where shelf_lines > 0 group by 1""",
        "raw_basket",
    ),
)
def shelved_totals(t):
    return ops.shelved_totals(ops.basket_totals(t.txn(), t.txn_item())).select(
        "request_id", *money("shelved_shelf", "shelved_paid")
    )


@query(
    "agg_08_headline_paid",
    sql(f"select request_id, total_paid from ({STATS_SQL})", "pieces", "raw_basket", "dim"),
)
def headline_paid(t):
    return stats(t).select("request_id", *money("total_paid"))


@query(
    "agg_09_null_gating",
    sql(
        f"""select request_id, cast((basket_count is null)::int + (first_visit is null)::int
        + (last_visit is null)::int + (line_count is null)::int + (itemised_count is null)::int
        + (zero_value_lines is null)::int + (negative_lines is null)::int + (distinct_products is null)::int
        + (total_stated is null)::int + (total_shelf is null)::int + (total_paid is null)::int
        + (total_saved is null)::int as bigint) as withheld from ({STATS_SQL})""",
        "pieces", "raw_basket", "dim",
    ),
)
def null_gating(t):
    figures = ("basket_count", "first_visit", "last_visit", "line_count", "itemised_count", "zero_value_lines",
               "negative_lines", "distinct_products", *STAT_MONEY)
    withheld = sum((F.col(c).isNull().cast("bigint") for c in figures), F.lit(0).cast("bigint"))
    return stats(t).select("request_id", withheld.alias("withheld"))


@query("agg_10_specific_pieces", sql("select request_id, disclosed from pieces", "pieces"))
def specific_pieces(t):
    return ops.specific_pieces(t.request(), t.disclosure(), t.txn()).select("request_id", "disclosed")


@query("agg_11_zero_claimable", sql("select request_id, zero_claimable from pieces", "pieces"))
def zero_claimable(t):
    return ops.specific_pieces(t.request(), t.disclosure(), t.txn()).select("request_id", "zero_claimable")


@query(
    "agg_12_request_lines_disclosed",
    sql(
        """select r.request_id, count(i.item_id) > 0 as lines_disclosed from request r
        left join txn t on t.request_id = r.request_id left join txn_item i on i.txn_id = t.txn_id group by 1""",
        "request", "txn",
    ),
)
def request_lines_disclosed(t):
    lines = t.txn_item().groupBy("request_id").agg(F.count(F.lit(1)).alias("lines"))
    return t.request().join(lines, "request_id", "left").select(
        "request_id", (F.coalesce("lines", F.lit(0)) > 0).alias("lines_disclosed")
    )


@query(
    "agg_13_quantity_kind",
    sql(
        """select request_id, coalesce(bool_or(abs(quantity - round(quantity)) > 0.000000001), false) as is_measure,
        count(quantity) > 0 as quantity_disclosed from txn_item group by 1""",
        "txn_item",
    ),
)
def quantity_kind(t):
    return ops.quantity_kind(t.txn_item())


@query(
    "agg_14_footing_summary",
    sql(
        """select request_id, count(*) as baskets, count(*) filter (abs(delta) >= 0.01) as not_footing,
        cast(max(abs(delta)) filter (abs(delta) >= 0.01) as double) as worst_delta,
        count(*) filter (delta >= 0.01) as over, count(*) filter (delta <= -0.01) as under
        from settled group by 1""",
        "settled",
    ),
)
def footing_summary(t):
    return ops.footing_summary(settled(t)).select(
        "request_id", "baskets", "not_footing", *money("worst_delta"), "over", "under"
    )


MONTH_COLUMNS = ("request_id", "month", "visits", "itemised", "unitemised", "first_index")


@query(
    "agg_15_month_index",
    sql(f"select {', '.join(MONTH_COLUMNS)}, {money_sql('paid', 'saved', 'stated')} from months", "months"),
)
def month_index(t):
    return ops.month_index(settled(t)).select(*MONTH_COLUMNS, *money("paid", "saved", "stated"))


@query(
    "agg_16_month_fill",
    sql(
        """select c.request_id, c.month, coalesce(visits, 0) as visits, coalesce(itemised, 0) as itemised,
        coalesce(unitemised, 0) as unitemised, coalesce(first_index, -1) as first_index,
        cast(coalesce(paid, 0) as double) as paid, cast(coalesce(saved, 0) as double) as saved,
        cast(coalesce(stated, 0) as double) as stated
        from (select request_id, strftime(unnest(generate_series(cast(min(month) || '-01' as date),
               cast(max(month) || '-01' as date), interval 1 month)), '%Y-%m') as month from months group by 1) c
        left join months m on m.request_id = c.request_id and m.month = c.month""",
        "months",
    ),
)
def month_fill(t):
    return ops.month_fill(ops.month_index(settled(t))).select(*MONTH_COLUMNS, *money("paid", "saved", "stated"))


@query(
    "srt_01_timeline_order",
    sql(
        "select txn_id, request_id, occurred_at from txn",
        "txn",
    ),
)
def timeline_order(t):
    return t.txn().select("txn_id", "request_id", "occurred_at").orderBy("request_id", "occurred_at", "txn_id")


@query(
    "srt_06_worst_footing",
    sql(
        """select request_id, txn_id, place as rank, cast(delta as double) as stated_pre_discount_delta from (
        select *, row_number() over (partition by request_id order by abs(delta) desc, occurred_at, txn_id) as place
        from settled where abs(delta) >= 0.01) where place <= 3""",
        "settled",
    ),
)
def worst_footing(t):
    return ops.worst_footing(settled(t), 3).select(
        "request_id", "txn_id", "rank", *money("stated_pre_discount_delta")
    )


# -- joins and windows as single steps ---------------------------------------


@query(
    "jn_01_left_outer",
    sql(
        """select t.txn_id, count(i.item_id) as lines from txn t left join txn_item i on i.txn_id = t.txn_id
        group by 1""",
        "txn",
    ),
)
def left_outer(t):
    return ops.basket_totals(t.txn(), t.txn_item()).select("txn_id", F.col("item_count").alias("lines"))


@query(
    "jn_02_inner",
    sql("select i.item_id, t.occurred_at from txn_item i join txn t on t.txn_id = i.txn_id", "txn"),
)
def inner(t):
    return t.txn_item().select("item_id", "txn_id").join(
        t.txn().select("txn_id", "occurred_at"), "txn_id"
    ).select("item_id", "occurred_at")


@query(
    "jn_03_semi",
    sql("select txn_id from txn where exists (select 1 from txn_item i where i.txn_id = txn.txn_id and i.quantity >= 20)", "txn"),
)
def semi(t):
    heavy = t.txn_item().where("quantity >= 20").select("txn_id")
    return t.txn().select("txn_id").join(heavy, "txn_id", "left_semi")


@query(
    "jn_04_aggregated_subquery",
    sql(
        """select t.txn_id, cast(l.s as double) as summed from txn t left join (select txn_id, sum(retail_amt) as s
        from txn_item where retail_amt is not null group by 1) l on l.txn_id = t.txn_id""",
        "txn",
    ),
)
def aggregated_subquery(t):
    return ops.basket_totals(t.txn(), t.txn_item()).select(
        "txn_id", F.col("retail_sum").cast("double").alias("summed")
    )


@query(
    "win_01_ranking",
    sql(
        """select txn_id, request_id, place as rank from (select *, row_number() over (partition by request_id
        order by total_pre_discount desc nulls last, txn_id) as place from txn) where place <= 2""",
        "txn",
    ),
)
def ranking(t):
    order = [F.col("total_pre_discount").desc_nulls_last(), F.col("txn_id")]
    return top_n(t.txn(), ["request_id"], order, 2, ["txn_id"]).select("txn_id", "request_id", "rank")


@query(
    "win_02_first_last",
    sql(
        """select distinct request_id, first_value(txn_id) over w as first_txn, last_value(txn_id) over w as last_txn
        from txn window w as (partition by request_id order by occurred_at, txn_id
          rows between unbounded preceding and unbounded following)""",
        "txn",
    ),
)
def first_last(t):
    place = F.struct("occurred_at", "txn_id")
    return t.txn().groupBy("request_id").agg(
        F.min(place)["txn_id"].alias("first_txn"), F.max(place)["txn_id"].alias("last_txn")
    )


@query(
    "win_08_month_first_index",
    sql("select request_id, month, first_index from months", "months"),
)
def month_first_index(t):
    return ops.month_index(settled(t)).select("request_id", "month", "first_index")
