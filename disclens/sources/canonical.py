"""The canonical disclosure tables, derived from the star-schema tables.

A deployment reads its own silver tables (see ``sinks``); here the same shapes
are derived from the provided tables by deterministic column expressions. One
customer is one request, so the number of requests grows with the data. No
window is needed for any identifier: every id is built from natural key columns.

Each expression is plain SQL text that Spark and DuckDB read alike, so that
the checks of ``plans`` start from the same rows on both sides.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from disclens.fixed_values import CATEGORIES
from disclens.sources.staging import stage

# -- expressions shared with the SQL checks ----------------------------------

# Amounts are worked out in whole cents, rounding halves away from zero.
_CENTS = "cast(floor(cast({x} + 50 as double) / 100) as bigint)"
_STEP = "(200 + 75 * (l_partkey % 6))"
_UNIT = f"""case
    when l_partkey % 6 in (0, 1) then {_CENTS.format(x=f"{_STEP} * (100 + l_suppkey % 5)")}
    when l_partkey % 6 in (2, 3) then {_STEP} * case when l_linenumber % 3 = 0 then 2 else 1 end
    else {_CENTS.format(x="cast(round(l_extendedprice) as bigint)")} end"""
_COUNT = "case when o_custkey % 3 = 1 then 1 + l_linenumber % 2 else 1 end"
_SIGN = """case when l_linenumber = 6 then 0
    when l_returnflag = 'R' and l_linenumber = 7 then -1 else 1 end"""
_PAID_SHARE = "(100 - cast(round(l_discount * 100) as bigint))"


def _money(cents: str) -> str:
    return f"cast(cast({cents} as decimal(15,0)) * 0.01 as decimal(18,2))"


_UNCODED = "(l_partkey % 97 <= 3 or l_partkey % 5 = 0)"

_OCCURRED_AT = """concat(concat('', cast(o_orderdate as date)), case when o_custkey % 2 = 0 then ''
    else concat('T', lpad(concat('', o_orderkey % 24), 2, '0'), ':',
                lpad(concat('', o_orderkey % 60), 2, '0'), ':00') end)"""

ITEM_COLUMNS = {
    "item_id": """concat(lpad(concat('', l_orderkey), 12, '0'), '-', lpad(concat('', l_linenumber), 3, '0'),
        '-', lpad(concat('', l_partkey), 10, '0'), '-', lpad(concat('', l_suppkey), 8, '0'),
        '-', lpad(concat('', cast(l_extendedprice as decimal(18,2))), 14, '0'))""",
    "txn_id": "l_orderkey",
    "request_id": "o_custkey",
    # A line carries its visit's date from the nested response it was flattened from.
    "occurred_at": _OCCURRED_AT,
    "description_raw": """case when l_partkey % 97 = 0 then 'CRV DEPOSIT'
        when l_partkey % 97 = 1 then 'CRV SODA 12 PACK R1 TAX FS'
        when l_partkey % 97 = 2 then '***'
        when l_partkey % 97 = 3 then ''
        else concat(case when l_suppkey % 7 = 0 then '$4.99 ' when l_suppkey % 7 = 1 then '(' else '' end,
             upper(case when l_partkey % 5 = 0 then split_part(p_name, ' ', 2) else p_name end)) end""",
    "upc": f"""case when {_UNCODED} then case when l_suppkey % 2 = 0 then null else '' end
        else concat('000', l_partkey % 6) end""",
    "quantity": """cast(case when o_custkey % 3 = 0 then null
        when o_custkey % 3 = 1 then 1 + l_linenumber % 2
        else cast(l_quantity as decimal(18,4)) * 0.5 end as decimal(18,4))""",
    "retail_amt": f"""case when o_custkey % 5 = 4 or l_suppkey % 11 = 3 then null
        else {_money(f"({_UNIT}) * ({_COUNT}) * ({_SIGN})")} end""",
    "loyalty_amt": f"""case when l_discount = 0 then null
        else {_money(f"({_SIGN}) * " + _CENTS.format(x=f"({_UNIT}) * ({_COUNT}) * {_PAID_SHARE}"))} end""",
}
ITEM_FILTER = "o_custkey % 13 <> 5 and o_orderkey % 17 <> 0"

TXN_COLUMNS = {
    "txn_id": "o_orderkey",
    "request_id": "o_custkey",
    "external_order_id": "concat('ORD-', o_orderkey)",
    "occurred_at": _OCCURRED_AT,
    "store_code": "case when o_orderkey % 19 = 0 then null else o_orderpriority end",
    "division_code": "o_orderstatus",
    "tender_type": "case when o_orderkey % 4 = 0 then null else concat('T', o_orderkey % 4) end",
    "total_pre_discount": """cast(case when o_orderkey % 3 = 2 then null
        when shelf_sum is null then round(cast(o_totalprice as decimal(18,2)) * 0.001, 2)
        when o_orderkey % 3 = 0 then shelf_sum else shelf_sum + 1.00 end as decimal(18,2))""",
    "source_document_id": "o_custkey",
    "page": "cast(o_orderkey % 48 + 1 as int)",
    "locator": "concat('basket/', o_orderkey)",
}

REQUEST_COLUMNS = {
    "request_id": "c_custkey",
    "retailer_id": """case c_custkey % 5 when 0 then 'north' when 1 then 'east' when 2 then 'south'
        when 3 then 'generic' else 'west' end""",
    "display_name": "c_name",
    "report_reference": "case when c_custkey % 4 = 2 then null else concat('REF-', c_custkey) end",
    "submitted_at": "concat('2003-0', 1 + c_custkey % 9, '-15')",
    "period_start": "'1995-01-01'",
    "period_end": "'2001-12-31'",
    "statute": "'CCPA'",
}

# 0 provided, 1 partial, 2 absent, 3 no row: requests of remainder 0 and 3 answer all eight.
DISCLOSURE_STATE = "(3 * c_custkey + ordinal) % (case when c_custkey % 5 in (0, 3) then 3 else 4 end)"
DISCLOSURE_COLUMNS = {
    "request_id": "c_custkey",
    "category": "category",
    "ordinal": "ordinal",
    "status": "case state when 0 then 'provided' when 1 then 'partial' else 'absent' end",
    "evidence": "case when state < 2 then concat('Sentence about ', category) end",
    "notes": """case when state < 2 then null when c_custkey % 2 = 0 then 'No section addresses this category.'
        else concat('Nothing on ', category) end""",
}

IDENTITY_COLUMNS = {
    "identity_seq": "event_id",
    "request_id": "user_id * 10 + event_id % 10",
    "id_type": """case event_type when 'signup' then 'loyalty_card' when 'view' then 'household'
        else 'email' end""",
    "value": "case when event_id % 9 = 0 then '  ' else concat('ID', event_id % 50) end",
    "scope": """case when event_type = 'view' then case when user_id % 3 = 0 then 'household' else null end
        when event_id % 2 = 0 or user_id % 3 = 1 then null else 'individual' end""",
    "first_seen": "concat('', cast(ts as date))",
}
IDENTITY_FILTER = "event_type in ('signup', 'view', 'click')"

INFERENCE_COLUMNS = {
    "inference_seq": "event_id",
    "request_id": "user_id * 10 + event_id % 10",
    "label": """case event_id % 6 when 0 then 'Cat owner' when 1 then 'Online shopper'
        when 2 then 'Household income $' when 3 then 'Cruise (7=Most Likely; 1=Least Likely)'
        when 4 then 'numberOfAdults' else 'Price' end""",
    "value_raw": """case event_id % 5 when 0 then concat(1 + event_id % 7, ' - scale') when 1 then ''
        when 2 then 'Yes' else concat('', cast(value as decimal(18,2))) end""",
    "value_num": "cast(cast(value as decimal(18,2)) as double)",
    "scale": """case event_id % 4 when 0 then 'ordinal 1-7' when 1 then 'ordinal_1_7'
        when 2 then '10–400' else 'categorical' end""",
    "subject": """case event_id % 3 when 0 then 'household' when 1 then 'individual' else null end""",
    "origin": """case event_id % 4 when 0 then 'first_party_model' when 3 then 'unknown'
        else 'appended_third_party' end""",
    "bucket": "case event_id % 3 when 0 then 'Household' else 'Individual' end",
}
INFERENCE_FILTER = "event_type in ('purchase', 'error')"

DOCUMENT_COLUMNS = {
    "doc_id": "doc_id",
    "request_id": "doc_id - doc_id % 2",
    "position": "doc_id % 2",
    "original_filename": "concat(source, '_', doc_id, case when doc_id % 3 = 0 then '.pdf' else '.txt' end)",
    "text": "text",
    "lang": "lang",
    "source": "source",
}


# What spreads the rows of each large table evenly, whichever single key is hot.
SPREAD_KEYS = {
    "lineitem": ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"),
    "orders": ("o_orderkey",),
    "events": ("event_id",),
    "customer": ("c_custkey",),
    "documents": ("doc_id",),
    "pages": ("page_id",),
}


def spread(df: DataFrame, name: str) -> DataFrame:
    """The large tables over all cores where they arrive in fewer splits than there are cores.

    A file of one row group is one split however many cores there are. Input of
    a cluster's size has far more splits than cores and is left as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    keys = SPREAD_KEYS.get(name)
    return df.repartition(cores, *keys) if keys and df.rdd.getNumPartitions() < cores else df


def _select(columns: dict[str, str]) -> list[str]:
    return [f"{text} as {name}" for name, text in columns.items()]


class Canonical:
    """Lazily built canonical DataFrames over one directory of parquet tables."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark = spark
        self.sf_dir = sf_dir
        self._lines: DataFrame | None = None
        self._visits: DataFrame | None = None

    def read(self, name: str) -> DataFrame:
        return spread(self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet"), name)

    def with_lines(self) -> Canonical:
        """The same tables with lines and visits written once, for queries that read them several times."""
        held = type(self)(self.spark, self.sf_dir)
        held._lines = stage(self.txn_item(), "zstd")
        held._visits = stage(held.txn(), "zstd")
        return held

    def txn_item(self) -> DataFrame:
        if self._lines is not None:
            return self._lines
        lines = self.read("lineitem")
        orders = self.read("orders").select("o_orderkey", "o_custkey", "o_orderdate").where(ITEM_FILTER)
        parts = self.read("part").select("p_partkey", "p_name")
        return (
            lines.join(orders, lines.l_orderkey == orders.o_orderkey)
            .join(parts, lines.l_partkey == parts.p_partkey)
            .selectExpr(*_select(ITEM_COLUMNS))
        )

    def txn(self) -> DataFrame:
        if self._visits is not None:
            return self._visits
        shelf = (
            self.txn_item().groupBy("txn_id").agg(F.sum("retail_amt").alias("shelf_sum"))
        )
        orders = self.read("orders")
        return orders.join(shelf, orders.o_orderkey == shelf.txn_id, "left").selectExpr(
            *_select(TXN_COLUMNS)
        )

    def request(self) -> DataFrame:
        return self.read("customer").selectExpr(*_select(REQUEST_COLUMNS))

    def disclosure(self) -> DataFrame:
        names = F.array(*[F.lit(c) for c in CATEGORIES])
        return (
            self.read("customer")
            .select("c_custkey", F.posexplode(names).alias("ordinal", "category"))
            .selectExpr("*", f"{DISCLOSURE_STATE} as state")
            .where("state < 3")
            .selectExpr(*_select(DISCLOSURE_COLUMNS))
        )

    def follow_up(self) -> DataFrame:
        rows = F.expr(
            """filter(array(
              named_struct('kind', 'supplemental_period', 'ord', 0, 'question', cast(null as string),
                           'wanted', c_custkey % 2 = 0),
              named_struct('kind', 'clarification', 'ord', 1, 'question', 'Why was this profile returned?',
                           'wanted', c_custkey % 3 = 0),
              named_struct('kind', 'clarification', 'ord', 2, 'question', concat('What came after ', c_custkey, '?'),
                           'wanted', c_custkey % 3 = 0),
              named_struct('kind', 'clarification', 'ord', 3, 'question', cast(null as string),
                           'wanted', c_custkey % 4 = 1),
              named_struct('kind', 'missing_category', 'ord', 4, 'question', cast(null as string),
                           'wanted', c_custkey % 5 = 0)
            ), r -> r.wanted)"""
        )
        return (
            self.read("customer")
            .select(F.col("c_custkey").alias("request_id"), F.explode(rows).alias("r"))
            .select(
                "request_id",
                F.col("r.ord").alias("ord"),
                F.col("r.kind").alias("kind"),
                F.concat(F.lit("Note "), F.col("r.ord").cast("string")).alias("description"),
                F.col("r.question").alias("question"),
            )
        )

    def identity(self) -> DataFrame:
        return self.read("events").where(IDENTITY_FILTER).selectExpr(*_select(IDENTITY_COLUMNS))

    def inference(self) -> DataFrame:
        return self.read("events").where(INFERENCE_FILTER).selectExpr(*_select(INFERENCE_COLUMNS))

    def document(self) -> DataFrame:
        return self.read("documents").selectExpr(*_select(DOCUMENT_COLUMNS))

    def source_document(self) -> DataFrame:
        return self.document().selectExpr(
            "doc_id as source_document_id",
            "request_id",
            "position",
            "original_filename",
            "sha2(text, 256) as sha256",
        )

    def parse_warning(self) -> DataFrame:
        """Line-level findings of the workbook reader, in sheet order."""
        return self.txn_item().where("coalesce(retail_amt, loyalty_amt) is null").selectExpr(
            "request_id",
            "item_id as seq",
            "case when description_raw = '' then 'info' else 'warning' end as severity",
            "case when description_raw = '' then 'A line had no description.'"
            " else 'A line had no readable amount; it is kept, with none.' end as message",
        )


# -- the same tables as common table expressions, for the SQL checks ----------


def _sql(columns: dict[str, str], tail: str) -> str:
    return "select " + ",\n  ".join(_select(columns)) + "\n" + tail


CTES: dict[str, tuple[tuple[str, ...], str]] = {
    "txn_item": (
        (),
        _sql(
            ITEM_COLUMNS,
            f"""from lineitem join orders on l_orderkey = o_orderkey join part on l_partkey = p_partkey
            where {ITEM_FILTER}""",
        ),
    ),
    "txn": (
        ("txn_item",),
        _sql(
            TXN_COLUMNS,
            """from orders left join
            (select txn_id as shelf_txn, sum(retail_amt) as shelf_sum from txn_item group by txn_id)
            on shelf_txn = o_orderkey""",
        ),
    ),
    "request": ((), _sql(REQUEST_COLUMNS, "from customer")),
    "categories": (
        (),
        "select * from (values "
        + ", ".join(f"({i}, '{c}')" for i, c in enumerate(CATEGORIES))
        + ") as v(ordinal, category)",
    ),
    "disclosure": (
        ("categories",),
        _sql(
            DISCLOSURE_COLUMNS,
            f"from (select *, {DISCLOSURE_STATE} as state from customer, categories) where state < 3",
        ),
    ),
    "follow_up": (
        (),
        """select c_custkey as request_id, ord, kind, concat('Note ', ord) as description,
          case when ord = 1 then 'Why was this profile returned?'
               when ord = 2 then concat('What came after ', c_custkey, '?') end as question
        from customer, (values (0, 'supplemental_period'), (1, 'clarification'), (2, 'clarification'),
            (3, 'clarification'), (4, 'missing_category')) as k(ord, kind)
        where case ord when 0 then c_custkey % 2 = 0 when 1 then c_custkey % 3 = 0
            when 2 then c_custkey % 3 = 0 when 3 then c_custkey % 4 = 1 else c_custkey % 5 = 0 end""",
    ),
    "identity": ((), _sql(IDENTITY_COLUMNS, f"from events where {IDENTITY_FILTER}")),
    "inference": ((), _sql(INFERENCE_COLUMNS, f"from events where {INFERENCE_FILTER}")),
    "document": ((), _sql(DOCUMENT_COLUMNS, "from documents")),
    "source_document": (
        ("document",),
        """select doc_id as source_document_id, request_id, position, original_filename,
           sha256(text) as sha256 from document""",
    ),
    "parse_warning": (
        ("txn_item",),
        """select request_id, item_id as seq,
          case when description_raw = '' then 'info' else 'warning' end as severity,
          case when description_raw = '' then 'A line had no description.'
            else 'A line had no readable amount; it is kept, with none.' end as message
        from txn_item where coalesce(retail_amt, loyalty_amt) is null""",
    ),
}


def with_tables(sql: str, *names: str, extra: dict[str, tuple[tuple[str, ...], str]] | None = None) -> str:
    """``sql`` preceded by the common table expressions it reads, in dependency order."""
    known = {**CTES, **(extra or {})}
    ordered: list[str] = []

    def add(name: str) -> None:
        if name in ordered:
            return
        for dependency in known[name][0]:
            add(dependency)
        ordered.append(name)

    for name in names:
        add(name)
    # Materialised: each is read several times and some hold a join.
    parts = [f"{name} as materialized (\n{known[name][1]}\n)" for name in ordered]
    return "with " + ",\n".join(parts) + "\n" + sql
