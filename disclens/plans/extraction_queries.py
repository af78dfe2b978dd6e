"""Queries of the extraction jobs, with the SQL each is checked against."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from disclens.fixed_values import (
    ABSENT_NOTE,
    ABSENT_NOTES,
    ASK_TEXT,
    CATEGORIES_NOTE,
    CATEGORIES_NOTE_INFERRED,
    CATEGORIES_SENTENCE,
    CATEGORY_HINTS,
    CATEGORY_LABELS,
    GAP_TEXT,
    LATER_PURCHASES_QUESTION,
    LATER_PURCHASES_TEXT,
    LATER_TEXT,
    NO_DATA_HINTS,
    NO_WORDING_TEXT,
    NOTHING_HELD_TEXT,
    NOTHING_MATCHED,
    OTHER_HOLDER_INFERRED,
    OTHER_HOLDER_QUESTION,
    OTHER_HOLDER_TEXT,
    PLAIN_READING_TEXT,
    REPORT_TABLES,
    REQUIRED_TRANSACTION,
    RETENTION_RULE_TEXT,
    SECTION_HEADERS,
    SECTIONS_NOTE,
    STATEMENT_SHAPE_TEXT,
    SUPPLEMENTAL_TEXT,
    VISITS_ALONE_NOTE,
    VISITS_ITEMISED_NOTE,
    WITHHELD_QUESTION,
    WITHHELD_SENTENCE,
    WITHHELD_TEXT,
    WORDING_NOTE,
)
from disclens.functions import cells as cell
from disclens.functions.amounts import num_coerce
from disclens.functions.dates import serial_date, ts_normalise
from disclens.operators import bundles, extract_cells, extract_json, extract_text, findings, inferences
from disclens.operators.disclosure import absent_completion, letters
from disclens.operators.report_identities import report_identities as found_identities
from disclens.plans.disclosure_queries import LETTER_SQL, case_of, quoted
from disclens.plans.inputs import HEADER_NAMES, check, frame
from disclens.plans.registry import query
from disclens.sources.staging import stage

# -- scalars ------------------------------------------------------------------

PRINTED = """case l_linenumber when 1 then concat('$', cast(l_extendedprice as decimal(18,2)))
  when 2 then concat('$1,', lpad(concat('', l_partkey % 1000), 3, '0'), '.50') when 3 then '' when 4 then 'N/A'
  when 5 then 'NaN' when 6 then ' -12.25 ' else 'Infinity' end"""
LINE_ID = "concat(l_orderkey, '-', l_linenumber, '-', l_partkey, '-', l_suppkey)"


@query(
    "ext_08_num_coerce",
    f"""select {LINE_ID} as id, cast(try_cast(nullif(regexp_replace(trim({PRINTED}), '[$,]', '', 'g'), '') as decimal(18,4))
    as double) as amount from lineitem""",
)
def num(t):
    return t.read("lineitem").select(
        F.expr(LINE_ID).alias("id"), num_coerce(F.expr(PRINTED)).cast("double").alias("amount")
    )


STAMP_DATE = """case o_orderkey % 5 when 0 then concat(concat('', cast(o_orderdate as date)), ' 00:00:00')
  when 1 then concat(month(o_orderdate), '/', day(o_orderdate), '/', year(o_orderdate), ' 00:00:00')
  when 2 then concat(month(o_orderdate), '/', day(o_orderdate), '/', year(o_orderdate), ' 7:45')
  when 3 then 'soon' else concat('', cast(o_orderdate as date)) end"""
STAMP_TIME = """case o_orderkey % 4 when 0 then '00:00:00' when 1 then concat(o_orderkey % 24, ':05')
  when 2 then null else '9:30:15 PM' end"""


@query(
    "ext_09_ts_normalise",
    rf"""select o_orderkey, day || 'T' || coalesce(case when own is not null and own <> '00:00:00' then own end,
        case when emb is not null and (own is null or emb <> '00:00:00') then emb end, own, '00:00:00') as occurred_at
    from (select *, case when hm is not null then lpad(split_part(hm, ':', 1), 2, '0') || ':' || split_part(hm, ':', 2) || ':'
            || coalesce(nullif(split_part(hm, ':', 3), ''), '00') end as own,
          case when em is not null then lpad(split_part(em, ':', 1), 2, '0') || ':' || split_part(em, ':', 2) || ':'
            || coalesce(nullif(split_part(em, ':', 3), ''), '00') end as emb
      from (select o_orderkey, case when d[5:5] = '-' then d[1:10] when contains(d, '/')
              then split_part(split_part(d, ' ', 1), '/', 3) || '-' || lpad(split_part(d, '/', 1), 2, '0') || '-'
                   || lpad(split_part(d, '/', 2), 2, '0') end as day,
            nullif(regexp_extract(tm, '\d{{1,2}}:\d{{2}}(:\d{{2}})?'), '') as hm,
            nullif(regexp_extract(split_part(d, ' ', 2), '\d{{1,2}}:\d{{2}}(:\d{{2}})?'), '') as em
          from (select o_orderkey, {STAMP_DATE} as d, {STAMP_TIME} as tm from orders)))""",
)
def normalise_ts(t):
    return t.read("orders").select(
        "o_orderkey", ts_normalise(F.expr(STAMP_DATE), F.expr(STAMP_TIME)).alias("occurred_at")
    )


SERIAL = """case o_orderkey % 9 when 0 then concat(30000 + o_orderkey % 9000, '') when 1 then concat(30000 + o_orderkey % 9000, '.5')
  when 2 then concat(30000 + o_orderkey % 9000, '.999999') when 3 then '0.5' when 4 then '2020-13-45'
  when 5 then concat('', cast(o_orderdate as date)) when 6 then concat(month(o_orderdate), '/', day(o_orderdate), '/', year(o_orderdate))
  when 7 then '99999999' else '2/30/2001' end"""


def serial_sql(epoch: str) -> str:
    moment = (
        f"timestamp '{epoch}' + to_days(cast(floor(secs / 86400) as int)) + to_seconds(secs % 86400)"
    )
    return f"""case when v is not null then case when v >= 1 and v < 2958466 then
        case when secs % 86400 = 0 then strftime({moment}, '%Y-%m-%d') else strftime({moment}, '%Y-%m-%dT%H:%M:%S') end end
      when contains(s, '-') then concat('', try_cast(s as date)) when contains(s, '/') then
        concat('', try_cast(split_part(s, '/', 3) || '-' || lpad(split_part(s, '/', 1), 2, '0') || '-'
          || lpad(split_part(s, '/', 2), 2, '0') as date)) end"""


@query(
    "ext_10_serial_date",
    f"""select o_orderkey, nullif({serial_sql('1899-12-30')}, '') as by_1900, nullif({serial_sql('1904-01-01')}, '') as by_1904
    from (select o_orderkey, s, try_cast(s as double) as v,
        case when try_cast(s as double) < 2958466 then cast(round_even(try_cast(s as double) * 86400, 0) as bigint) end as secs
      from (select o_orderkey, {SERIAL} as s from orders))""",
)
def serial(t):
    text = F.expr(SERIAL)
    return t.read("orders").select(
        "o_orderkey", serial_date(text).alias("by_1900"), serial_date(text, date1904=True).alias("by_1904")
    )


@query(
    "ext_11_tender_join",
    """select o_orderkey, nullif(array_to_string(list_filter([case when o_orderkey % 2 = 0 then 'CASH' else ' ' end,
      case when o_orderkey % 3 = 0 then o_orderpriority else '' end], lambda x: trim(x) <> ''), ' + '), '') as tender
    from orders""",
)
def tender(t):
    tenders = F.expr(
        """array(case when o_orderkey % 2 = 0 then 'CASH' else ' ' end,
                 case when o_orderkey % 3 = 0 then concat(' ', o_orderpriority) else '' end)"""
    )
    return t.read("orders").select("o_orderkey", cell.tender_join(tenders).alias("tender"))


CODE = "case l_linenumber when 1 then 'I/ss' when 2 then ' 12 ' when 3 then '4011' when 4 then null else concat('00', l_partkey, '9') end"
RING = "case l_suppkey % 5 when 0 then 'GROC DEPT KEY' when 1 then 'n/a' when 2 then 'Depart. key ring' when 3 then null else 'MILK DEPT. KEYS' end"


@query(
    "ext_14_product_code",
    rf"""select {LINE_ID} as id, case when length(trim(c)) >= 4 and trim(c) <> 'I/ss'
      and not coalesce(regexp_matches(trim(d), '(?i)\bDEP(ARTMEN)?T\.? KEY\b|^N/A$'), false) then trim(c) end as upc
    from (select *, {CODE} as c, {RING} as d from lineitem)""",
)
def code(t):
    return t.read("lineitem").select(
        F.expr(LINE_ID).alias("id"), cell.product_code(F.expr(CODE), F.expr(RING)).alias("upc")
    )


@query(
    "sc_01_a1_locator",
    """select id, 'Sheet!' || letters || rowno as locator, c as back, rowno as corner_rows, c as corner_columns
    from (select *, case when c <= 26 then chr(cast(64 + c as int))
        when c <= 702 then chr(cast(64 + (c - 1) // 26 as int)) || chr(cast(65 + (c - 1) % 26 as int))
        else chr(cast(64 + (c - 703) // 676 + 1 as int)) || chr(cast(65 + ((c - 703) // 26) % 26 as int)) || chr(cast(65 + (c - 1) % 26 as int)) end as letters
      from (select o_orderkey as id, o_custkey + 1 as rowno, o_orderkey % 16384 + 1 as c from orders))""",
)
def a1(t):
    rows = t.read("orders").selectExpr("o_orderkey as id", "o_custkey + 1 as rowno", "o_orderkey % 16384 + 1 as c")
    letters = cell.column_letter(F.col("c"))
    corner = cell.range_corner(F.concat(F.lit("A1:$"), letters, F.lit("$"), F.col("rowno")))
    return rows.select(
        "id",
        cell.a1_locator(F.lit("Sheet"), F.col("rowno"), F.col("c")).alias("locator"),
        cell.column_index(letters).alias("back"),
        corner["rows"].alias("corner_rows"),
        corner["columns"].alias("corner_columns"),
    )


# -- JSON in text -------------------------------------------------------------

# One event, one document: prose around sound, wrapped, trailing, cut off and broken objects.
EVENT_TEXT = r"""case event_id % 6
  when 0 then concat('See {} and ', props, ' end')
  when 1 then concat('A "quoted { brace" then {"k": ', user_id, ', "in": {"v": [1, 2]},}')
  when 2 then concat('{"s": "two', chr(10), 'lines", "e": "', event_type, '"} tail }')
  when 3 then concat('Ends early {"k": {"a": ', user_id)
  when 4 then concat('{bad ', event_type, '} then ', props)
  else concat('No object in ', event_type) end"""


@query(
    "ext_01_json_spans",
    f"""with d as (select *, {EVENT_TEXT} as text from events)
    select event_id as doc_id, 4 as start, 6 as "end", 'ok' as status, '{{}}' as json from d where event_id % 6 = 0
    union all select event_id, 11, 11 + length(props), 'ok', props from d where event_id % 6 = 0
    union all select event_id, 24, length(text), 'repaired', replace(substr(text, 25), ',}}', '}}') from d where event_id % 6 = 1
    union all select event_id, 0, length(text) - 7, 'repaired', replace(substr(text, 1, length(text) - 7), chr(10), ' ')
      from d where event_id % 6 = 2
    union all select event_id, 11, length(text), 'unterminated', null from d where event_id % 6 = 3
    union all select event_id, 0, 6 + length(event_type), 'unparseable', null from d where event_id % 6 = 4
    union all select event_id, length(text) - length(props), length(text), 'ok', props from d where event_id % 6 = 4""",
)
def spans(t):
    docs = t.read("events").select(F.col("event_id").alias("doc_id"), F.expr(EVENT_TEXT).alias("text"))
    return extract_json.json_spans(docs)


DEEP = """concat('{"user": {"id": ', user_id, ', "kind": "', event_type, '"}, "p": [', props, ', [{"deep": true}], 7], "n": null}')"""


@query(
    "ext_02_json_walk",
    """select event_id as doc_id, 'id' as key, concat('', user_id) as value from events
    union all select event_id, 'kind', event_type from events
    union all select event_id, 'k', concat('', json_extract_string(props, '$.k')) from events
    union all select event_id, 'deep', 'true' from events
    union all select event_id, 'n', null from events""",
)
def walk(t):
    docs = t.read("events").select(F.col("event_id").alias("doc_id"), F.expr(DEEP).alias("json"))
    return extract_json.json_walk(docs)


@query(
    "ext_02_flat_walk",
    "select event_id as doc_id, unnest(json_keys(props)) as key, json_extract_string(props, '$.k') as value from events",
)
def flat(t):
    return extract_json.flat_walk(t.read("events").select(F.col("event_id").alias("doc_id"), F.col("props").alias("json")))


BLOB_HEADER = """case event_type when 'view' then 'Email Information' when 'click' then 'Information about your purchases:'
  else 'Data related to in-store services:' end"""
BLOB_JSON = """case event_id % 3 when 0 then concat('{"accounts": 1, "groups": ', event_id, '}')
  when 1 then '{"groups": [], "other": 0}' else '[1]' end"""


@query(
    "ext_06_first_blob_by",
    f"""select u.doc_id, h.start as under_start, k.start as keyed_start, k.json as keyed_json
    from (select distinct user_id as doc_id from events) u
    left join (select user_id as doc_id, min(event_id) as start from events
        where event_type not in ('view') group by 1) h on h.doc_id = u.doc_id
    left join (select user_id as doc_id, min(event_id) as start, arg_min({BLOB_JSON}, event_id) as json from events
        where event_id % 3 = 0 group by 1) k on k.doc_id = u.doc_id""",
)
def first_blob(t):
    blobs = t.read("events").select(
        F.col("user_id").alias("doc_id"), F.col("event_id").alias("start"),
        F.expr(BLOB_HEADER).alias("header"), F.expr(BLOB_JSON).alias("json"),
    )
    under = extract_json.first_blob(
        blobs, headers=["Information about your purchases:", "Data related to in-store services:"]
    ).select("doc_id", F.col("start").alias("under_start"))
    keyed = extract_json.first_blob(blobs, keys=["accounts", "groups"]).select(
        "doc_id", F.col("start").alias("keyed_start"), F.col("json").alias("keyed_json")
    )
    return blobs.select("doc_id").distinct().join(under, "doc_id", "left").join(keyed, "doc_id", "left")


# One order, one response: sound baskets beside ones that are malformed in each known way.
BASKET_JSON = """case o_orderkey % 10
  when 0 then '{"customer": []}'
  when 1 then concat('{"customer": {"basket": ["oops", {"date": "', cast(o_orderdate as date), '", "items": "none"}]}}')
  else concat('{"customer": [{"loyaltyno": "L', o_custkey, '", "basket": [{"date": "',
    month(o_orderdate), '/', day(o_orderdate), '/', year(o_orderdate), ' 00:00:00", "time": "', o_orderkey % 24, ':15:00",',
    ' "orderno": "', o_orderkey, '", "store": ', o_custkey % 100, ', "total_amount_prior_to_discounts": "$1,',
    lpad(concat('', o_orderkey % 1000), 3, '0'), '.25", "tenders": [{"tendertype": "CASH"}, {"tendertype": " "}, {"tendertype": "',
    o_orderstatus, '"}], "items": [{"purchasedescription": "', o_orderpriority, '", "productupc": "00', o_custkey,
    '", "quantity": ', o_orderkey % 3, ', "retailamt": "4.50", "customerloyamt": 3.25}, 17, {"purchasedescription": null}]},',
    ' {"time": "10:00"}]}, {"basket": [{"date": "2001-01-01"}]}]}') end"""


def order_docs(t):
    return t.read("orders").select(F.col("o_orderkey").alias("doc_id"), F.expr(BASKET_JSON).alias("json"))


@query(
    "ext_07_nested_baskets",
    """select o_orderkey as doc_id, case when o_orderkey % 10 = 1 then 1 else 0 end as basket_pos,
      case when o_orderkey % 10 = 1 then concat('', cast(o_orderdate as date), 'T00:00:00')
        else strftime(o_orderdate, '%Y-%m-%d') || 'T' || lpad(concat('', o_orderkey % 24), 2, '0') || ':15:00' end as occurred_at,
      case when o_orderkey % 10 > 1 then concat('', o_orderkey) end as external_order_id,
      case when o_orderkey % 10 > 1 then concat('', o_custkey % 100) end as store_code,
      case when o_orderkey % 10 > 1 then 'CASH + ' || o_orderstatus end as tender_type,
      case when o_orderkey % 10 > 1 then 1000.25 + o_orderkey % 1000 end::double as total_pre_discount
    from orders where o_orderkey % 10 > 0""",
)
def nested_txns(t):
    txns = extract_json.nested_baskets(order_docs(t))[0]
    return txns.withColumn("total_pre_discount", F.col("total_pre_discount").cast("double"))


@query(
    "ext_07_nested_items",
    """select o_orderkey as doc_id, 0 as item_pos, o_orderpriority as description_raw, '00' || o_custkey as upc,
      cast(o_orderkey % 3 as double) as quantity, cast(4.5 as double) as retail_amt, cast(3.25 as double) as loyalty_amt
    from orders where o_orderkey % 10 > 1
    union all select o_orderkey, 2, '', null, null, null, null from orders where o_orderkey % 10 > 1""",
)
def nested_items(t):
    items = extract_json.nested_baskets(order_docs(t))[1]
    return items.select(
        "doc_id", "item_pos", "description_raw", "upc",
        *[F.col(c).cast("double").alias(c) for c in ("quantity", "retail_amt", "loyalty_amt")],
    )


@query(
    "ext_07_nested_warnings",
    """select o_orderkey as doc_id, 'The purchases section had no customer object.' as message from orders where o_orderkey % 10 = 0
    union all select o_orderkey, 'Basket 0 was not an object and was skipped.' from orders where o_orderkey % 10 = 1
    union all select o_orderkey, 'Basket 1 had a malformed item list.' from orders where o_orderkey % 10 = 1
    union all select o_orderkey, 'Item 1 of basket 0 was not an object.' from orders where o_orderkey % 10 > 1
    union all select o_orderkey, 'Basket 1 had no usable date and was skipped.' from orders where o_orderkey % 10 > 1""",
)
def nested_warnings(t):
    return extract_json.nested_baskets(order_docs(t))[2]


@query(
    "ext_18_identity_dedup",
    check(
        """select request_id, identity_seq, id_type, value, scope, first_seen from (
        select request_id, identity_seq, id_type, trim(value) as value, scope, first_seen, row_number() over
          (partition by request_id, id_type, trim(value) order by identity_seq) as n
        from identity where trim(value) <> '') where n = 1""",
        "identity",
    ),
)
def dedup(t):
    return extract_json.identity_dedup(t.identity())


WIDE = {
    "request_id": "c_custkey",
    "loyaltyno": "c_name",
    "alternateId": "case when c_custkey % 3 = 0 then concat('A', c_custkey) end",
    "ehhn": "c_nationkey",
    "emailAddress": "case when c_custkey % 4 = 0 then ' ' else concat('u', c_custkey, '@mail.example.com') end",
    "addressLine1": "concat(c_custkey, ' Main St')",
    "city": "c_mktsegment",
    "zipCode": "case when c_custkey % 2 = 0 then '' else '94000' end",
}


@query(
    "ext_19_identity_unpivot",
    """select c_custkey as request_id, 'loyalty_card' as id_type, c_name as value, 'individual' as scope from customer
    union all select c_custkey, 'alternate_id', 'A' || c_custkey, 'individual' from customer where c_custkey % 3 = 0
    union all select c_custkey, 'household', concat('', c_nationkey), 'household' from customer
    union all select c_custkey, 'email', 'u' || c_custkey || '@mail.example.com', 'individual' from customer where c_custkey % 4 <> 0
    union all select c_custkey, 'address', c_custkey || ' Main St, ' || c_mktsegment
      || case when c_custkey % 2 = 0 then '' else ', 94000' end, 'household' from customer""",
)
def unpivot(t):
    wide = t.read("customer").selectExpr(*[f"{e} as {n}" for n, e in WIDE.items()])
    return extract_json.identity_unpivot(wide)


GRAPH_JSON = """concat('{"accounts": [{"accounts": [{"loyaltyCards": {"60', c_custkey, '": {"cardNumberWithCD": "60', c_custkey,
  '1", "altIds": ["ALT', c_custkey, '", "ALT', c_custkey, '"]}, "61', c_custkey, '": "bare"}, "personalInfo": {"name": {"firstName": "Ann", "lastName": "',
  c_mktsegment, '"}}}, "junk"]}], "groups": [{"type": "KROGER_HOUSEHOLD", "aliasIds": {"ehhn": "H', c_nationkey,
  '", "mystery": "M', c_custkey, '"}, "metadata": {"householdId": {"value": ', c_nationkey,
  '}, "address": {"value": {"addressLine1": "1 Main", "city": "', c_mktsegment, '"}}, "ignored": {"value": 1}}}, {"type": "CG_PERSON", "aliasIds": {"epsn": "E', c_custkey, '"}}]}')"""


@query(
    "ext_20_identity_nested",
    """with c as (select *, c_custkey as k from customer)
    select k as doc_id, 'loyalty_card' as id_type, '60' || k as value, 'individual' as scope from c
    union all select k, 'loyalty_card', '61' || k, 'individual' from c
    union all select k, 'loyalty_card', '60' || k || '1', 'individual' from c
    union all select k, 'alternate_id', 'ALT' || k, 'individual' from c
    union all select k, 'name', 'Ann ' || c_mktsegment, 'individual' from c
    union all select k, 'household', 'H' || c_nationkey, 'household' from c
    union all select k, 'internal_person', 'M' || k, 'household' from c
    union all select k, 'household', concat('', c_nationkey), 'household' from c
    union all select k, 'address', '1 Main, ' || c_mktsegment, 'household' from c
    union all select k, 'internal_person', 'E' || k, 'individual' from c""",
)
def graph(t):
    docs = t.read("customer").select(F.col("c_custkey").alias("doc_id"), F.expr(GRAPH_JSON).alias("json"))
    return extract_json.identity_nested(docs)


RULE_NUMBER = "try_cast(regexp_replace(trim(value_raw), '[$,]', '', 'g') as decimal(18,4))"


@query(
    "ext_21_inference_rules",
    check(
        rf"""select inference_seq, request_id, label,
          case when regexp_matches(label, '(?i)\(\s*[17]\s*=\s*(most|least)') or lead is not null then 'ordinal_1_7'
            when num is not null and (contains(label, '$') or contains(lower(label), 'income')) then 'currency'
            when num is not null then 'count' else 'categorical' end as scale,
          coalesce(lead, num) as value_num,
          case when bucket = 'Household' or label = 'numberOfAdults' then 'household' else 'individual' end as subject,
          case when label = 'Cat owner' then true when label = 'Online shopper' then null else false end as derivable_from_txns
        from (select *, cast({RULE_NUMBER} as double) as num,
            cast(nullif(regexp_extract(value_raw, '^\s*([1-7])\s*[-–]', 1), '') as double) as lead from inference
            where trim(value_raw) <> '')""",
        "inference",
    ),
)
def report_rules(t):
    return inferences.report_rules(t.inference())


WORKBOOK_LABEL = """case inference_seq % 6 when 0 then 'Age' when 1 then 'Number of adults in household'
  when 2 then 'Home value (in thousands)' when 3 then 'Heavy buyer of produce' when 4 then 'Internet buyer' else 'Census tract' end"""


@query(
    "ext_21_workbook_rules",
    check(
        rf"""select inference_seq, request_id, label,
          case when num is null then 'categorical' when label like '%(in thousands)%' then 'currency'
            when label in ('Age', 'Number of adults in household') then 'count' else 'categorical' end as scale,
          num as value_num,
          case when label in ('Number of adults in household', 'Home value (in thousands)', 'Census tract') then 'household' end as subject,
          case when label = 'Internet buyer' then null else label = 'Heavy buyer of produce' end as derivable_from_txns
        from (select inference_seq, request_id, {WORKBOOK_LABEL} as label,
            case when regexp_full_match(trim(value_raw), '-?\d+(\.\d+)?') then cast(trim(value_raw) as double) end as num
          from inference where trim(value_raw) <> '')""",
        "inference",
    ),
)
def workbook_rules(t):
    labelled = t.inference().withColumn("label", F.expr(WORKBOOK_LABEL))
    return inferences.workbook_rules(labelled)


# -- worksheets ---------------------------------------------------------------


def sheet(t):
    cells = frame(t, "cells")
    columns = extract_cells.header_map(cells, HEADER_NAMES, REQUIRED_TRANSACTION)
    return cells, columns, extract_cells.sheet_lines(cells, columns, HEADER_NAMES)


HEADERS_SQL = """select doc_id, sheet, header_row, upper(trim(value)) as header, max(col_no) as col_no from (
    select *, 3 as header_row from cells where row_no = 3) group by 1, 2, 3, 4"""


@query("ext_12_header_map", check(HEADERS_SQL, "cells"))
def header_map(t):
    return sheet(t)[1].select("doc_id", "sheet", "header_row", "header", "col_no")


# The sheet is read back to the fields it was written from.
READ_SQL = r"""select txn_id as doc_id, n as row_no, nullif(dte, '') as occurred_at, nullif(trim(tid), '') as external_order_id,
    nullif(sid, 'I/ss') as store_code, coalesce(dsc, '') as description_raw, dsc is null as unnamed,
    case when length(code) >= 4 and not coalesce(dsc = 'GROC DEPT KEY', false) then code end as upc,
    try_cast(qty as decimal(18,4)) as quantity, try_cast(replace(net, '$', '') as decimal(18,4)) as loyalty_amt
  from (select txn_id, n, case when n % 7 = 0 then null when txn_id % 3 = 0
        then strftime(timestamp '1899-12-30' + to_days(cast(35000 + txn_id % 2000 as int)), '%Y-%m-%d')
          || case when n % 2 = 0 then 'T12:00:00' else '' end
        when txn_id % 3 = 1 then '1999-03-07' when n % 5 = 0 then null else '1999-02-28' end as dte,
      {TXN_ID} as tid, {STORE_ID} as sid, {UPC_ID} as code, {UPC_DSC} as dsc, {QTY} as qty, {NET} as net from sheet_row)"""


def read_sql() -> str:
    from disclens.plans.inputs import SHEET_FIELDS

    text = READ_SQL
    for name, expression in SHEET_FIELDS.items():
        text = text.replace("{" + name + "}", f"({expression})")
    return text


LINE_VIEW = {"sheet_line": (("sheet_row",), read_sql())}


@query(
    "ext_13_read_lines",
    check(
        """select doc_id, row_no, occurred_at, external_order_id, store_code, description_raw, upc,
        cast(quantity as double) as quantity, cast(loyalty_amt as double) as loyalty_amt from sheet_line""",
        "sheet_line", **LINE_VIEW,
    ),
)
def read_lines(t):
    lines = extract_cells.read_lines(sheet(t)[2])
    return lines.select(
        "doc_id", F.col("row_no").cast("bigint").alias("row_no"), "occurred_at", "external_order_id", "store_code",
        "description_raw", "upc", *[F.col(c).cast("double").alias(c) for c in ("quantity", "loyalty_amt")],
    )


@query(
    "ext_13_lines_to_baskets",
    check(
        """select doc_id, external_order_id, first(occurred_at order by row_no) as occurred_at,
        list(store_code order by row_no)[1] as store_code, count(*) as lines from sheet_line
        where occurred_at is not null and external_order_id is not null group by 1, 2""",
        "sheet_line", **LINE_VIEW,
    ),
)
def lines_to_baskets(t):
    baskets = extract_cells.baskets(extract_cells.read_lines(sheet(t)[2]))
    return baskets.select("doc_id", "external_order_id", "occurred_at", "store_code", "lines")


@query(
    "ext_13_line_warnings",
    check(
        """select doc_id, row_no, severity, message from (
          select doc_id, row_no, 'warning' as severity, 'Skipped a line with no readable date.' as message from sheet_line
            where occurred_at is null
          union all select doc_id, row_no, 'warning', 'Skipped a line with no transaction number, so no basket to put it in.'
            from sheet_line where occurred_at is not null and external_order_id is null
          union all select doc_id, row_no, 'info', 'A line had no description.' from sheet_line
            where occurred_at is not null and external_order_id is not null and unnamed
          union all select doc_id, row_no, 'warning', 'A line had no readable amount; it is kept, with none.' from sheet_line
            where occurred_at is not null and external_order_id is not null and loyalty_amt is null
          union all select doc_id, row_no, 'info',
            'A transaction number appears on more than one date; its lines are kept together under the first.'
            from (select *, first_value(occurred_at) over (partition by doc_id, external_order_id order by row_no) as f
                  from sheet_line where occurred_at is not null and external_order_id is not null) where occurred_at <> f)""",
        "sheet_line", **LINE_VIEW,
    ),
)
def line_warnings(t):
    warnings = extract_cells.line_warnings(extract_cells.read_lines(sheet(t)[2]))
    return warnings.select("doc_id", F.col("row_no").cast("bigint").alias("row_no"), "severity", "message")


@query(
    "ext_15_warning_cap",
    check(
        """select request_id, severity, message, seq as at from (select *, row_number() over
            (partition by request_id, severity, message order by seq) as n from parse_warning) where n <= 5
        union all select request_id, severity, (count(*) - 5) || ' more lines like the above: ' || message, null
        from parse_warning group by request_id, severity, message having count(*) > 5""",
        "parse_warning",
    ),
)
def warning_cap(t):
    return extract_cells.warning_cap(t.parse_warning(), "request_id", "seq")


@query(
    "ext_16_declared_size",
    check(
        """select doc_id, last_row, widest, last_row <> 3 + doc_id % 8 as rows_differ, widest > 6 + doc_id % 2 as too_wide
        from (select doc_id, max(row_no) as last_row, max(col_no) as widest from cells group by 1)
        where last_row <> 3 + doc_id % 8 or widest > 6 + doc_id % 2""",
        "cells",
    ),
)
def declared(t):
    cells = frame(t, "cells")
    sizes = cells.select("doc_id", "sheet").distinct().selectExpr(
        "doc_id", "sheet", "3 + doc_id % 8 as declared_rows", "6 + doc_id % 2 as declared_columns"
    )
    return extract_cells.declared_size(cells, sizes).select("doc_id", "last_row", "widest", "rows_differ", "too_wide")


POINTS = """select o_custkey as request_id,
  case when o_orderkey % 13 = 0 then null else concat('$', cast(o_totalprice as decimal(18,2))) end as amount_raw,
  case when o_custkey % 4 = 0 and o_orderkey % 11 = 0 then 'many' when o_custkey % 4 = 1 and o_orderkey % 3 = 0
      then concat(cast(round(cast(o_totalprice as decimal(18,2)), 0) as bigint) + 1, '')
    else concat(cast(round(cast(o_totalprice as decimal(18,2)), 0) as bigint), '') end as point_raw"""


@query(
    "ext_17_column_redundancy",
    f"""select request_id, holds, case when holds then n else 0 end as checked_rows from (
      select request_id, count(*) filter (b) >= 3 and bool_and(coalesce(p = round(p) and abs(p - a) <= 0.5, false)) filter (b) as holds,
        count(*) filter (b) as n
      from (select request_id, amount_raw is not null and point_raw is not null as b,
          try_cast(replace(amount_raw, '$', '') as decimal(18,4)) as a, try_cast(point_raw as decimal(18,4)) as p
        from ({POINTS} from orders)) group by 1)""",
)
def redundancy(t):
    columns = POINTS.removeprefix("select ")
    pairs = t.spark.sql(f"select {columns} from {{orders}}", orders=t.read("orders"))
    return extract_cells.column_redundancy(pairs, "request_id")


# -- prose --------------------------------------------------------------------


@query(
    "ext_03_page_markers",
    """select doc_id, m as breaks, cast(4 as int) as first_page, cast(case when m > 0 then length(prefix) + length(text)
        else length(prefix) + length(text) + extra end as int) as kept_length,
      case when m > 0 then cast(length(prefix) + list_sum(list_transform(ls[1:3 * m], lambda x: length(x) + 1)) as int) end as last_offset,
      case when m > 0 then cast(m + 4 as int) end as last_number
    from (select *, case when len(ls) // 3 >= 2 then len(ls) // 3 else 0 end as m,
        case when len(ls) // 3 = 1 then 3 else 0 end as extra
      from (select doc_id, text, string_split(text, chr(10)) as ls, case when doc_id % 2 = 0 then '77' || chr(10) else '' end as prefix
        from documents)) where m > 0
    union all
    select doc_id, 0, 1, cast(length(prefix) + length(text) + extra as int), null, null
    from (select doc_id, text, len(string_split(text, chr(10))) as n, case when doc_id % 2 = 0 then '77' || chr(10) else '' end as prefix,
        case when len(string_split(text, chr(10))) // 3 = 1 then 3 else 0 end as extra from documents) where n // 3 < 2""",
)
def page_markers(t):
    text = F.expr(
        """concat(case when doc_id % 2 = 0 then '77\n' else '' end, array_join(transform(split(text, '\n', -1),
           (l, i) -> case when i % 3 = 2 then concat(l, '\n ', (i - 2) div 3 + 5) else l end), '\n'))"""
    )
    stripped = extract_text.strip_page_markers(t.read("documents").select("doc_id", text.alias("text")))
    last = F.try_element_at("breaks", F.lit(-1))
    return stripped.select(
        "doc_id", F.size("breaks").cast("bigint").alias("breaks"), "first_page",
        F.length("text").alias("kept_length"), last["offset"].alias("last_offset"), last["number"].alias("last_number"),
    )


_HEADERS = ", ".join(f"({quoted(h)})" for h in SECTION_HEADERS)
SECTION_VIEW = {
    "section": (
        ("headed",),
        f"""select doc_id, header, hit + length(header) as body_start, cast(coalesce(lead(hit) over
            (partition by doc_id order by hit, header), length(text)) as bigint) as body_end,
          row_number() over (partition by doc_id order by hit, header) - 1 as seq
        from (select doc_id, text, header, unnest(list_transform(range(1, len(ps)),
              lambda i: list_sum(list_transform(ps[1:i], lambda x: length(x))) + (i - 1) * length(header))) as hit
          from (select doc_id, text, header, string_split(text, header) as ps
                from headed, (values {_HEADERS}) h(header) where contains(text, header)))""",
    )
}


@query(
    "ext_04_sections",
    check("select doc_id, seq, header, body_start, body_end from section", "section", **SECTION_VIEW),
)
def sections(t):
    found = extract_text.sections(frame(t, "headed"), SECTION_HEADERS)
    return found.select(
        "doc_id", "header", *[F.col(c).cast("bigint").alias(c) for c in ("seq", "body_start", "body_end")]
    )


def asof(t):
    headed = frame(t, "headed")
    breaks = extract_text.sections(headed, SECTION_HEADERS).select(
        "doc_id", F.col("body_start").alias("offset"), "header"
    )
    offsets = headed.select("doc_id", F.explode(F.sequence(F.lit(0), F.length("text"), F.lit(50))).alias("offset"))
    return extract_text.offset_asof(offsets, breaks, "header", F.lit("")).withColumn(
        "offset", F.col("offset").cast("bigint")
    )


ASOF_SQL = """select o.doc_id, o."offset", coalesce(s.header, '') as header
    from (select doc_id, unnest(range(0, length(text) + 1, 50)) as "offset" from headed) o
    asof left join section s on s.doc_id = o.doc_id and s.body_start <= o."offset" """


@query("ext_05_offset_asof", check(ASOF_SQL, "headed", "section", **SECTION_VIEW))
def offset_asof(t):
    return asof(t)


@query("jn_07_asof", check(ASOF_SQL, "headed", "section", **SECTION_VIEW))
def asof_join(t):
    return asof(t)


@query(
    "win_06_fill_forward",
    check(f"select doc_id, header, count(*) as offsets from ({ASOF_SQL}) group by 1, 2", "headed", "section", **SECTION_VIEW),
)
def fill_forward(t):
    return asof(t).groupBy("doc_id", "header").agg(F.count(F.lit(1)).alias("offsets"))


LEXICON = {
    "CATEGORIES_COLLECTED": ["general public license", "apache license"],
    "SOURCES": ["inthe", "nder"],
    "BUSINESS_PURPOSE": ["heit ", " das "],
    "RETENTION_PERIOD": ["una de la", "licensed under"],
    "SPECIFIC_PIECES": ["@mail"],
}
_LEXICON_ROWS = ", ".join(
    f"('{c}', {rank}, {quoted(p)})" for c, phrases in LEXICON.items() for rank, p in enumerate(phrases)
)
HINTS_SQL = rf"""select doc_id, category, 'partial' as status, arg_min(sentence, rank) as evidence from (
    select doc_id, category, rank, nullif(left(trim(regexp_replace(regexp_extract(substr(text, 1, hit - 1), '[^.!?\n]*$')
        || regexp_extract(substr(text, hit), '^[^.!?\n]*[.!?]?'), '\s+', ' ', 'g')), 400), '') as sentence
    from (select doc_id, text, category, rank, instr(lower(text), phrase) as hit from documents,
        (values {_LEXICON_ROWS}) l(category, rank, phrase)) where hit > 0)
  where sentence is not null group by 1, 2"""


@query("ext_22_hint_grading", HINTS_SQL)
def hint_grading(t):
    return extract_text.hint_grading(t.read("documents"), LEXICON)


@query(
    "ext_23_no_data_hint",
    """select doc_id, contains(lower(text), 'license') or contains(lower(text), 'no record') as nothing_held from documents""",
)
def no_data(t):
    return t.read("documents").select(
        "doc_id", extract_text.no_data_hint(F.col("text"), ["license", "no record"]).alias("nothing_held")
    )


@query(
    "ext_24_absent_in_letters",
    check(
        f"""select d.doc_id, c.category, coalesce(g.status, 'absent') as status, g.evidence,
        case when g.status is null then {quoted(ABSENT_NOTE)} end as notes
        from documents d cross join categories c left join ({HINTS_SQL}) g on g.doc_id = d.doc_id and g.category = c.category""",
        "categories",
    ),
)
def absent_in_letters(t):
    docs = t.read("documents")
    found = extract_text.hint_grading(docs, LEXICON)
    return absent_completion(found, docs, "doc_id").select("doc_id", "category", "status", "evidence", "notes")


@query(
    "ext_25_coverage_window",
    check(
        """select r.request_id as doc_id, case when r.request_id % 4 = 0 then '1996-01-0' || (1 + r.request_id % 9)
          else min(left(occurred_at, 10)) end as period_start,
        case when r.request_id % 4 = 0 then '2000-12-31' else max(left(occurred_at, 10)) end as period_end
        from request r left join txn t on t.request_id = r.request_id group by r.request_id""",
        "request", "txn",
    ),
)
def coverage_window(t):
    docs = t.request().select(
        F.col("request_id").alias("doc_id"),
        F.expr(
            """case when request_id % 4 = 0 then concat('Preface. Report period: 1996-01-0', 1 + request_id % 9,
               case when request_id % 8 = 0 then ' through ' else ' - ' end, '2000-12-31.') else 'No period.' end"""
        ).alias("text"),
    )
    dates = t.txn().select(F.col("request_id").alias("doc_id"), "occurred_at")
    return extract_text.coverage_window(docs, dates)


@query(
    "ext_26_coverage_gap",
    check(
        """select request_id, last_purchase, case when years >= 1 then cast(floor(years) as bigint) end as years,
          case when years >= 2 then cast(floor(years) as bigint) || ' years' when years >= 1 then 'a year' end as span,
          case when later > last_purchase then later end as later_date,
          case when later > last_purchase then what end as later_what
        from (select r.request_id, l.last_purchase, datediff('day', cast(l.last_purchase as date),
                cast(left(r.submitted_at, 10) as date)) / 365.25 as years, e.later, e.what
          from request r join (select request_id, max(left(occurred_at, 10)) as last_purchase from txn group by 1) l
            on l.request_id = r.request_id
          left join (select request_id, max(first_seen) as later, list(id_type order by first_seen desc, id_type desc)[1] as what
            from identity group by 1) e on e.request_id = r.request_id)""",
        "request", "txn", "identity",
    ),
)
def coverage_gap(t):
    later = t.identity().select("request_id", F.col("first_seen").alias("on_date"), F.col("id_type").alias("what"))
    return extract_text.coverage_gap(t.request(), t.txn(), later)


@query(
    "ext_27_quote_sentences",
    r"""select doc_id, cast(seq - 1 as int) as seq, sentence from (
      select doc_id, unnest(list_filter(list_transform(string_split(regexp_replace(regexp_replace(replace(text, chr(10), ' '),
            '([.!?])\s+([A-Z])', '\1' || chr(1) || '\2', 'g'), '\s*•\s*', chr(1), 'g'), chr(1)), lambda s: trim(s)), lambda s: s <> '')) as sentence,
        generate_subscripts(list_filter(list_transform(string_split(regexp_replace(regexp_replace(replace(text, chr(10), ' '),
            '([.!?])\s+([A-Z])', '\1' || chr(1) || '\2', 'g'), '\s*•\s*', chr(1), 'g'), chr(1)), lambda s: trim(s)), lambda s: s <> ''), 1) as seq
      from documents) where regexp_matches(sentence, '(?i)licen[sc]e|@mail')""",
)
def quote(t):
    return extract_text.quote_sentences(t.read("documents"), "(?i)licen[sc]e|@mail")


@query(
    "ext_28_holder_mismatch",
    """select c_custkey, case when c_custkey % 5 = 0 then null else lower(c_mktsegment) <> (case when c_custkey % 3 = 0
      then lower(c_mktsegment) else 'ann' end) end as mismatch from customer""",
)
def holder(t):
    asked = F.when(F.col("c_custkey") % 5 == 0, F.lit("I/ss")).otherwise(F.concat(F.lit(" "), "c_mktsegment", F.lit("  ")))
    holder_name = F.when(F.col("c_custkey") % 3 == 0, F.lower("c_mktsegment")).otherwise(F.lit("Ann"))
    both = cell.present(asked).isNotNull() & cell.present(holder_name).isNotNull()
    return t.read("customer").select(
        "c_custkey", F.when(both, cell.normalise(asked) != cell.normalise(holder_name)).alias("mismatch")
    )


@query(
    "ext_29_disclosure_evidence",
    check(
        """select request_id, visits || ' visits, each with ' || case when stores > 0 then 'a date, a store and a total'
            else 'a date and a total' end || '. ' || case when itemised > 0 then itemised || ' of them itemised, from '
            || captures || ' screen captures of the receipts.' else 'No line items.' end as evidence
        from (select t.request_id, count(*) as visits, count(store_code) as stores, count(i.txn_id) as itemised,
            count(*) filter (t.txn_id % 2 = 0) as captures
          from txn t left join (select distinct txn_id from txn_item) i on i.txn_id = t.txn_id group by 1)""",
        "txn",
    ),
)
def evidence(t):
    itemised = t.txn_item().select("txn_id").distinct().withColumn("has_items", F.lit(1))
    counts = t.txn().join(itemised, "txn_id", "left").groupBy("request_id").agg(
        F.count(F.lit(1)).alias("visits"), F.count("store_code").alias("stores"), F.count("has_items").alias("itemised"),
        F.count_if(F.col("txn_id") % 2 == 0).alias("captures"),
    )
    return extract_cells.visit_evidence(counts)


# -- findings -----------------------------------------------------------------


def response_facts(t):
    requests = frame(t, "response").withColumn(
        "tables", F.filter(F.array(*[F.lit(x) for x in REPORT_TABLES]), lambda x, i: F.col("request_id") % (i + 2) == 0)
    )
    later = t.identity().select("request_id", F.col("first_seen").alias("on_date"), F.col("id_type").alias("what"))
    return stage(
        findings.response_facts(
            requests, t.txn(), t.txn_item(), frame(t, "prose"), t.identity(), t.inference(), later, F.col("txn_id") % 2 == 0
        )
    )


_SENTENCES = r"""list_filter(list_transform(string_split(regexp_replace(regexp_replace(replace(text, chr(10), ' '),
    '([.!?])\s+([A-Z])', '\1' || chr(1) || '\2', 'g'), '\s*•\s*', chr(1), 'g'), chr(1)), lambda s: trim(s)), lambda s: s <> '')"""
_HINT_ROWS = ", ".join(f"('{c}', {rank}, {quoted(p)})" for c, phrases in CATEGORY_HINTS.items() for rank, p in enumerate(phrases))
_HELD = " or ".join(f"contains(lower(text), {quoted(h)})" for h in NO_DATA_HINTS)
_ABSENT = " ".join(f"when '{reader}' then {quoted(note)}" for reader, note in ABSENT_NOTES.items())


def worded(text: str, **values: str) -> str:
    """A wording as SQL, its gaps filled by expressions."""
    for name, value in values.items():
        text = text.replace("{" + name + "}", "\x01" + value + "\x02")
    parts = re.split("(\x01[^\x02]*\x02)", text)
    return " || ".join(p[1:-1] if p.startswith("\x01") else quoted(p) for p in parts if p)


FINDINGS = {
    "said": (
        ("prose",),
        f"""select request_id, text, list_filter(ss, lambda s: regexp_matches(s, {quoted(WITHHELD_SENTENCE)})) as withheld,
          list_filter(ss, lambda s: regexp_matches(s, {quoted(CATEGORIES_SENTENCE)}))[1] as categories_sentence, {_HELD} as nothing_held,
          nullif(regexp_extract(text, '(?i)prior to\\s+(\\d{{4}})', 1), '') as earlier_than
        from (select *, {_SENTENCES} as ss from prose)""",
    ),
    "hinted": (
        ("prose",),
        rf"""select request_id, category, arg_min(sentence, rank) as evidence from (
          select request_id, category, rank, nullif(left(trim(regexp_replace(regexp_extract(substr(text, 1, hit - 1), '[^.!?\n]*$')
            || regexp_extract(substr(text, hit), '^[^.!?\n]*[.!?]?'), '\s+', ' ', 'g')), 400), '') as sentence
          from (select request_id, text, category, rank, instr(lower(text), phrase) as hit from prose,
            (values {_HINT_ROWS}) l(category, rank, phrase)) where hit > 0) where sentence is not null group by 1, 2""",
    ),
    "fact": (
        ("response", "txn", "txn_item", "identity", "inference", "said"),
        f"""select r.*, coalesce(v.visits, 0) as visits, coalesce(v.stores, 0) as stores, coalesce(v.itemised, 0) as itemised,
          coalesce(v.items, 0) as items, coalesce(v.captures, 0) as captures, v.first_day, v.last_day, coalesce(v.timed, false) as timed,
          coalesce(f.appended, 0) as appended, coalesce(i.has_email, false) as has_email, s.withheld, s.categories_sentence,
          coalesce(s.nothing_held, false) as nothing_held, s.earlier_than, s.request_id is not null as report,
          coalesce(array_to_string(list_filter([{', '.join(quoted(x) for x in REPORT_TABLES)}], lambda x, k: r.request_id % (k + 1) = 0), ', '), '')
            as tables,
          nullif(concat_ws(' ',
            case when years >= 1 then {worded(GAP_TEXT, end="v.last_day", span="case when years >= 2 then cast(floor(years) as bigint) || ' years' else 'a year' end")} end,
            case when i.later > v.last_day then {worded(LATER_TEXT, what="i.what", day="i.later")} end), '') as gap
        from (select * from response) r
        left join (select t.request_id, count(*) as visits, count(store_code) as stores, count(l.lines) as itemised, coalesce(sum(l.lines), 0) as items,
            count(*) filter (t.txn_id % 2 = 0) as captures, min(left(occurred_at, 10)) as first_day, max(left(occurred_at, 10)) as last_day,
            bool_or(contains(occurred_at, 'T')) as timed
          from txn t left join (select txn_id, count(*) as lines from txn_item group by 1) l on l.txn_id = t.txn_id group by 1) v
          on v.request_id = r.request_id
        left join (select request_id, count(*) filter (origin = 'appended_third_party') as appended from inference group by 1) f on f.request_id = r.request_id
        left join (select request_id, bool_or(id_type = 'email') as has_email, max(first_seen) as later,
            list(id_type order by first_seen desc, id_type desc)[1] as what from identity group by 1) i on i.request_id = r.request_id
        left join said s on s.request_id = r.request_id
        left join lateral (select datediff('day', cast(v.last_day as date), cast(left(r.submitted_at, 10) as date)) / 365.25 as years) on true""",
    ),
    "found": (
        ("fact", "hinted"),
        f"""select request_id, 'SPECIFIC_PIECES' as category, 'partial' as status, visits || ' visits, each with ' || case when stores > 0
            then 'a date, a store and a total' else 'a date and a total' end || '. ' || case when itemised > 0 then itemised || ' of them itemised, from '
            || captures || ' screen captures of the receipts.' else 'No line items.' end as evidence,
          case when itemised > 0 then {worded(VISITS_ITEMISED_NOTE, n="(visits - itemised)")} else {quoted(VISITS_ALONE_NOTE)} end as notes
        from fact where reader = 'statement'
        union all select request_id, 'SPECIFIC_PIECES', 'provided', heading, {worded(SECTIONS_NOTE, n="blobs")}
        from fact where reader = 'sections' and heading is not null
        union all select request_id, 'CATEGORIES_COLLECTED', 'partial', categories_sentence,
          {worded(CATEGORIES_NOTE, tables="coalesce(nullif(tables, ''), 'none')")} || case when appended > 0 then {worded(CATEGORIES_NOTE_INFERRED, n="appended")} else '.' end
        from fact where reader = 'workbook' and categories_sentence is not null
        union all select request_id, 'SPECIFIC_PIECES', 'partial', nullif(concat_ws('; ',
            case when visits > 0 then visits || ' purchases with ' || items || ' line items, ' || first_day || ' to ' || last_day end,
            case when report and profile then 'a loyalty profile' end,
            case when appended > 0 then appended || ' inferred attributes' end) || '.', '.'),
          nullif(concat_ws(' ', case when visits > 0 then 'The purchase history has no shelf price beside the amount paid, no basket total, '
              || case when timed then '' else 'no time of day, ' end || 'no payment method.' end,
            case when visits > 0 and report then 'Nothing from an app, a website' || case when has_email then '' else ', an email address' end
              || ' or an online order.' end, case when visits > 0 and report then gap end), '')
        from fact where reader = 'workbook'
        union all select h.request_id, h.category, 'partial', h.evidence, {quoted(WORDING_NOTE)} from hinted h join fact f on f.request_id = h.request_id
        where f.reader = 'plain'""",
    ),
    "graded": (
        ("fact", "found", "categories"),
        f"""select f.request_id, f.reader, c.category, c.ordinal, coalesce(d.status, 'absent') as status, d.evidence,
          case when d.status is null then case f.reader {_ABSENT} end else d.notes end as notes
        from fact f cross join categories c left join found d on d.request_id = f.request_id and d.category = c.category
        where d.status is not null or f.reader <> 'workbook' or f.report""",
    ),
    "asked": (
        ("fact", "graded"),
        f"""select request_id, row_number() over (partition by request_id order by place, ordinal) - 1 as ord, kind, description, question from (
          select request_id, 1 as place, 0 as ordinal, 'clarification' as kind, {quoted(PLAIN_READING_TEXT)} as description, null as question from fact
            where reader = 'plain'
          union all select request_id, 2, 0, 'clarification', {quoted(NOTHING_HELD_TEXT)}, null from fact where reader = 'plain' and nothing_held
          union all select request_id, 3, 0, 'clarification', {worded(OTHER_HOLDER_TEXT, inferred=f"case when appended > 0 then {worded(OTHER_HOLDER_INFERRED, n='appended')} else '' end")},
            {quoted(OTHER_HOLDER_QUESTION)} from fact where reader = 'workbook' and profile and asked_name <> 'I/ss' and lower(trim(asked_name)) <> lower(trim(holder_name))
          union all select request_id, 4, 0, 'clarification', {worded(LATER_PURCHASES_TEXT, gap="gap")}, {worded(LATER_PURCHASES_QUESTION, end="last_day")}
            from fact where reader = 'workbook' and report and visits > 0 and gap is not null
          union all select request_id, 5, 0, 'clarification', {worded(WITHHELD_TEXT, quoted="array_to_string(withheld, ' ')")}, {quoted(WITHHELD_QUESTION)}
            from fact where reader = 'workbook' and len(withheld) > 0
          union all select request_id, 6, 0, 'supplemental_period', {worded(SUPPLEMENTAL_TEXT, year="earlier_than")}, null
            from fact where reader = 'sections' and earlier_than is not null
          union all select request_id, 7, 0, 'clarification', {quoted(STATEMENT_SHAPE_TEXT)}, null from fact where reader = 'statement'
          union all select request_id, 8, 0, 'missing_category', {quoted(RETENTION_RULE_TEXT)}, null from fact where reader = 'statement'
          union all select g.request_id, 9, g.ordinal, 'missing_category', case when g.reader = 'plain' then
            {worded(NO_WORDING_TEXT, category=case_of('g.category', CATEGORY_LABELS))} else
            {worded(ASK_TEXT, retailer="f.display_name", category=case_of('g.category', CATEGORY_LABELS))} end, null
            from graded g join fact f on f.request_id = g.request_id where g.status = 'absent' and g.reader <> 'statement')""",
    ),
}


@query(
    "ext_29_evidence_rules",
    check("select request_id, category, ordinal, status, evidence, notes from graded", "graded", **FINDINGS),
)
def evidence_rules(t):
    """Every response graded by the rules of how it was read, absent categories included."""
    return findings.disclosure_evidence(response_facts(t)).withColumn("ordinal", F.col("ordinal").cast("int"))


@query(
    "ext_30_clarifications",
    check("select request_id, cast(ord as bigint) as ord, kind, description, question from asked", "asked", **FINDINGS),
)
def clarifications(t):
    """Everything worth asking about each response: clarifications, earlier periods, missing categories."""
    facts = response_facts(t)
    return findings.follow_ups(facts, findings.disclosure_evidence(facts)).withColumn("ord", F.col("ord").cast("bigint"))


@query(
    "agg_26_letter_of_findings",
    check(
        re.sub(r"\bfrom follow_up\b", "from asked", re.sub(r"\bfrom disclosure\b", "from graded", LETTER_SQL)),
        "request", "graded", "asked", **FINDINGS,
    ),
)
def letter_of_findings(t):
    """The letters that the derived evidence and questions call for."""
    facts = response_facts(t)
    graded = findings.disclosure_evidence(facts)
    return letters(t.request(), graded, findings.follow_ups(facts, graded))


@query("ext_22_statutory_phrases", check("select request_id as doc_id, category, 'partial' as status, evidence from hinted", "hinted", **FINDINGS))
def statutory_phrases(t):
    return extract_text.hint_grading(frame(t, "prose").withColumnRenamed("request_id", "doc_id"))


@query("ext_23_statutory_hints", check("select request_id as doc_id, nothing_held from said", "said", **FINDINGS))
def statutory_hints(t):
    return frame(t, "prose").select(F.col("request_id").alias("doc_id"), extract_text.no_data_hint(F.col("text")).alias("nothing_held"))


# -- bundles ------------------------------------------------------------------

FORMATS = [
    bundles.HeaderFormat("src1", "Licensed under", ("Apache License", "GNU General Public License", "CC BY-NC", "version 3")),
    bundles.ShapeFormat("letter", ("@mail", "555-", "token =")),
]
SCORES_SQL = """select bundle, 'src1' as format, least(1.0, round(max(case when lower(trim(coalesce(declared, ''))) = 'src1' then 0.2 else 0 end)
      + sum(case when contains(lower(original_filename), 'src1') then 0.1 else 0 end + case when contains(text, 'Licensed under') then 0.5 else 0 end
        + least(0.3, 0.1 * (contains(text, 'Apache License')::int + contains(text, 'GNU General Public License')::int
          + contains(text, 'CC BY-NC')::int + contains(text, 'version 3')::int))), 6))::double as score from bundled group by 1
    union all select bundle, 'letter', max(case when contains(text, '@mail')::int + contains(text, '555-')::int + contains(text, 'token =')::int >= 2
      then 0.9 else 0 end)::double from bundled group by 1
    union all select bundle, 'generic', max(case when trim(text) <> '' then 0.1 else 0 end)::double from bundled group by 1"""


@query("ext_31_format_scoring", check(SCORES_SQL, "bundled"))
def scoring(t):
    return bundles.format_scores(frame(t, "bundled"), FORMATS)


@query(
    "ext_32_format_select",
    check(
        f"""select bundle, format, score as confidence, score >= 0.25 as is_confident from (select *, row_number() over
          (partition by bundle order by format = 'generic', score desc, format) as n from ({SCORES_SQL}) where score > 0) where n = 1""",
        "bundled",
    ),
)
def selection(t):
    return bundles.format_select(bundles.format_scores(frame(t, "bundled"), FORMATS))


@query(
    "ext_33_pick_document",
    check(
        """select bundle, list(doc_id order by h desc, position)[1] as report, max(h) as headers,
          list(doc_id order by length(text) desc, position)[1] as longest
        from (select *, cast(contains(text, 'Licensed under')::int + contains(text, 'Apache')::int as bigint) as h from bundled) group by 1""",
        "bundled",
    ),
)
def pick(t):
    return bundles.pick_document(frame(t, "bundled"), ["Licensed under", "Apache"])


@query(
    "ext_34_capture_grouping",
    check(
        r"""select txn_id, case when d <> '' then regexp_extract(stem, '^(.*?_\d{6})', 1) else stem end as visit_key,
        case when d <> '' then concat('', try_cast('20' || d[5:6] || '-' || d[1:2] || '-' || d[3:4] as date)) end as on_date,
        try_cast(nullif(regexp_extract(stem, '^.*?_\d{6}_(\d{1,2})$', 1), '') as bigint) as part
        from (select txn_id, stem, regexp_extract(stem, '^.*?_(\d{6})(_\d{1,2})?$', 1) as d from (
          select txn_id, split_part(split_part(original_filename, '/', 2), '.', 1) as stem from capture))""",
        "capture",
    ).replace("concat('', try_cast('20'", "nullif(concat('', try_cast('20'").replace("as date)) end as on_date", "as date)), '') end as on_date"),
)
def captures(t):
    return bundles.capture_files(frame(t, "capture")).select("txn_id", "visit_key", "on_date", "part")


@query(
    "ext_43_bundle_accounting",
    check(
        """select doc_id, bundle, case when reason is not null then 'unreadable' when recognised then 'read'
        else 'unrecognised' end as outcome from file_read""",
        "file_read",
    ),
)
def accounting(t):
    files = frame(t, "file_read")
    return bundles.bundle_accounting(files.select("doc_id", "bundle"), files.where("reason is null"))


@query(
    "set_03_known_titles",
    """select doc_id, len(list_intersect(string_split_regex(lower(text), '[^a-z]+'), ['the', 'und', 'licensed', 'version'])) as known
    from documents where len(list_intersect(string_split_regex(lower(text), '[^a-z]+'), ['the', 'und', 'licensed', 'version'])) >= 2""",
)
def known_titles(t):
    known = F.array(*[F.lit(w) for w in ("the", "und", "licensed", "version")])
    shared = F.size(F.array_intersect(F.split(F.lower("text"), "[^a-z]+", -1), known)).cast("bigint")
    return t.read("documents").select("doc_id", shared.alias("known")).where("known >= 2")


@query(
    "ext_45_failure_reasons",
    check(
        f"""select bundle, case when said is null then {quoted(NOTHING_MATCHED)} when readable = 0 then said
          else n || ' of the uploaded files could not be read: ' || said || ' The remaining files were readable but matched no adapter.' end as message
        from (select f.bundle, count(*) filter (reason is null) as readable, any_value(said) as said, any_value(n) as n
          from file_read f left join (select bundle, string_agg(reason, ' ' order by p) as said, count(*) as n
            from (select bundle, reason, min(position) as p from file_read where reason is not null group by 1, 2) group by 1) r
            on r.bundle = f.bundle group by 1)""",
        "file_read",
    ),
)
def failures(t):
    return bundles.failure_reasons(frame(t, "file_read"))


@query(
    "ext_44_report_sections",
    """with c as (select c_custkey as k, c_nationkey as n, c_mktsegment as m from customer)
    select k as doc_id, 1 as page, 'Profile Details' as section, 'card' as scope_kind, concat('12', k) as scope_id,
      'Card_nbr' as key, concat('', n) as value, 0 as unread from c
    union all select k, 1, 'Profile Details', 'card', concat('12', k), 'Address', '1 Main St ' || m || ' CA AABB 1122 a   b', 0 from c
    union all select k, 2, 'Profile Details', 'card', concat('12', k), 'Phone', case when k % 2 = 0 then '' else 'none' end, 0 from c
    union all select k, 2, 'Preference Details', null, null, 'os_cust_id', concat('', k), 0 from c
    union all select k, 2, 'Preference Details', null, null, 'pref', 'yes', 0 from c
    union all select k, 2, 'Preference Details', null, null, 'os_cust_id', concat('', k + 1), 0 from c
    union all select k, 2, 'Preference Details', null, null, null, null, 1 from c where k % 3 = 0
    union all select k, 1, '', null, null, null, null, 1 from c
    union all select k, 1, 'Request details', null, null, v.key, replace(v.value, '{k}', concat('', k)), 0 from c, (values ('Request ref ID', 'RR{k} AABB'),
      ('Request type', 'Know 11'), ('Date submitted', '2020-01-02'), ('Subject type', ''), ('First name', ''), ('Last name', 'Mc Coy')) v(key, value)""",
)
def report_sections(t):
    lines = F.expr(
        """filter(array('RReeqquueesstt ddeettaaiillss', concat('lost Request ref ID RR', c_custkey, ' AABB RReeqquueesstt ttyyppee Know 11'), 'date submitted 2020-01-02 Subject type',
          'First name   Last name Mc   Coy', 'Instructions', 'Read me first', 'DDeettaaiilleedd RReeppoorrtt', 'stray line', concat('Profile Details [card: 12 ', c_custkey, ']'),
          concat('Card_nbr ', c_nationkey), 'Address 1 Main St', c_mktsegment, ' CA ', 'AABB 1122', 'a   b', '1 / 2',
          case when c_custkey % 2 = 0 then 'Phone' else 'Phone none' end, 'PPrreeffeerreennccee  DDeettaaiillss', concat('os_cust_id:', c_custkey), 'pref: yes',
          'Customer Preference 1', concat('os_cust_id:', c_custkey + 1), case when c_custkey % 3 = 0 then 'odd words' else '' end),
          l -> l is not null)"""
    )
    docs = t.read("customer").select(F.col("c_custkey").alias("doc_id"), F.posexplode(lines).alias("line_no", "line"))
    fields = extract_text.report_fields(docs)
    return fields.select(
        "doc_id", F.col("page").cast("int").alias("page"), F.coalesce("section", F.lit("")).alias("section"),
        "scope_kind", "scope_id", "key", "value", F.col("unread").cast("int").alias("unread"),
    )


REPORT_FIELD_ROWS = """select c_custkey as doc_id, 'Loyalty Store Visits Details' as section, 1 as section_no, 1 as field_no, 'Card_first_visit_dt' as key,
      concat('201', c_custkey % 10, '-03-04') as value from {customer} where c_custkey % 3 <> 0
    union all select c_custkey, 'Loyalty Store Visits Details', 1, 2, 'Card_nbr', concat('12', c_custkey) from {customer}
    union all select c_custkey, 'Loyalty Profile Details', 2, 1, 'Card_nbr', concat('12', c_custkey - c_custkey % 2) from {customer}
    union all select c_custkey, 'Loyalty Profile Details', 2, 2, 'Household_id', concat('H', c_nationkey) from {customer}
    union all select c_custkey, 'Loyalty Profile Details', 2, 3, 'Phone', case when c_custkey % 4 = 0 then 'I/ss' else concat('555-01', c_custkey % 90 + 10) end from {customer}
    union all select c_custkey, 'Loyalty Profile Details', 2, 4, 'First_nm', case when c_custkey % 5 = 0 then 'I/ss' else 'Ann' end from {customer}
    union all select c_custkey, 'Loyalty Profile Details', 2, 5, 'Last_nm', c_name from {customer}
    union all select c_custkey, 'Loyalty Profile Details', 2, 6, 'Address', c_mktsegment from {customer} where c_custkey % 6 <> 0
    union all select c_custkey, 'Loyalty Profile Details', 2, 7, 'State_cd', 'CA' from {customer} where c_custkey % 7 <> 0
    union all select c_custkey, 'Preference Details', 3, 1, 'os_cust_id', concat('P', c_custkey) from {customer}
    union all select c_custkey, 'Preference Details', 3, 2, 'os_cust_id', concat('P', c_custkey + c_custkey % 2) from {customer}
    union all select c_custkey, 'Other Details', 4, 1, 'Email', 'x@y.z' from {customer}
    union all select c_custkey, 'Request details', null, null, 'First name', 'Ann' from {customer}
    union all select c_custkey, 'Request details', null, null, 'Last name', c_name from {customer}"""


@query(
    "ext_19_report_identities",
    check(
        f"""select distinct doc_id, id_type, value, scope, case when id_type = 'loyalty_card' then first_visit end as first_seen from (
          select f.*, v.value as first_visit from (
            select doc_id, case key when 'Card_nbr' then 'loyalty_card' when 'Household_id' then 'household' when 'Phone' then 'phone' else 'alternate_id' end as id_type,
              value, case key when 'Household_id' then 'household' end as scope from field
            where key in ('Card_nbr', 'Household_id', 'Phone', 'os_cust_id') and value <> 'I/ss'
            union all select c_custkey, 'name', 'Ann ' || c_name, 'individual' from customer
            union all select c_custkey, 'name', case when c_custkey % 5 = 0 then '' else 'Ann ' end || c_name, 'individual' from customer
            union all select c_custkey, 'address', c_mktsegment || case when c_custkey % 7 <> 0 then ', CA' else '' end, 'household' from customer
              where c_custkey % 6 <> 0) f
          left join field v on v.doc_id = f.doc_id and v.key = 'Card_first_visit_dt')""",
        "field", field=((), REPORT_FIELD_ROWS.replace("{customer}", "customer")),
    ),
)
def report_identities(t):
    return found_identities(t.spark.sql(REPORT_FIELD_ROWS, customer=t.read("customer")))
