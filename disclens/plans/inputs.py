"""Inputs of the extraction queries, derived from the given tables.

Each is SQL text that both engines read: ``{name}`` stands for another input or
a canonical table. On Spark the names are bound to DataFrames, in the checks
they become common table expressions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from disclens.sources.canonical import CTES, Canonical, with_tables
from disclens.sources.staging import stage

HEADER_NAMES = ["TXN_DTE", "TXN_ID", "STORE_ID", "UPC_ID", "UPC_DSC", "QTY", "NET"]

SHEET_FIELDS = {
    "TXN_DTE": """case when n % 7 = 0 then null
        when txn_id % 3 = 0 then concat('', 35000 + txn_id % 2000, case when n % 2 = 0 then '.5' else '' end)
        when txn_id % 3 = 1 then '3/7/1999'
        when n % 5 = 0 then '1999-02-30' else '1999-02-28' end""",
    "TXN_ID": "case when n % 11 = 0 then ' ' else concat('T', n % 2) end",
    "STORE_ID": "case when n % 3 = 0 then 'I/ss' else concat('S', txn_id % 9) end",
    "UPC_ID": "case when n % 4 = 0 then '12' when n % 4 = 1 then '4011' else upc end",
    "UPC_DSC": """case when description_raw = '' then null
        when txn_id % 5 = 0 and n % 2 = 0 then 'GROC DEPT KEY' else description_raw end""",
    "QTY": """case when n % 6 = 0 then 'two' when quantity is null then null
        else concat('', cast(quantity as decimal(18,2))) end""",
    "NET": """case when n % 9 = 0 then 'n/a' when loyalty_amt is null then null
        else concat('$', cast(loyalty_amt as decimal(18,2))) end""",
}

_CELLS = "\nunion all\n".join(
    [
        "select txn_id as doc_id, 'Sheet' as sheet, 1 as row_no, 1 as col_no, 'Purchase history' as value from {sheet_row}"
        " where n = 4"
    ]
    + [
        f"""select txn_id, 'Sheet', 3, cast(({i} + txn_id) % 7 + 1 as int), '{'  ' + h.lower() if i % 2 else h + ' '}'
        from {{sheet_row}} where n = 4
        union all
        select txn_id, 'Sheet', cast(n as int), cast(({i} + txn_id) % 7 + 1 as int), {SHEET_FIELDS[h]} from {{sheet_row}}"""
        for i, h in enumerate(HEADER_NAMES)
    ]
)

_ISO = "concat(left(occurred_at, 10), case when length(occurred_at) = 10 then 'T00:00:00' else substr(occurred_at, 11) end)"

INPUTS: dict[str, tuple[tuple[str, ...], str]] = {
    "sheet_row": (
        ("txn_item",),
        "select *, 3 + row_number() over (partition by txn_id order by item_id) as n from {txn_item}",
    ),
    "cells": (("sheet_row",), _CELLS),
    # receipts ---------------------------------------------------------------
    "printed_line": (
        ("txn_item",),
        """select txn_id as visit_key, part, row_number() over (partition by txn_id, part order by item_id) as row_no,
          description_raw as description, retail_amt as amount
        from (select *, case when substr(item_id, 14, 3) <= '004' then 1 else 2 end as part from {txn_item}
              where retail_amt is not null) as p""",
    ),
    "visit_flag": (
        ("printed_line",),
        """select visit_key, max(part) as last_part, sum(amount) as total, sum(case when part = 1 then amount end) as first_sum,
          sum(case when part = 2 then amount end) as second_sum, max(case when part = 1 then row_no end) as first_rows,
          visit_key % 7 = 0 as apart,
          visit_key % 4 = 1 and visit_key % 7 <> 0 and min(part) <> max(part) as overlapped
        from {printed_line} group by visit_key""",
    ),
    "fragment_line": (
        ("printed_line", "visit_flag"),
        """select p.visit_key, p.part, cast(p.row_no + case when f.overlapped and p.part = 2 then 1 else 0 end as bigint)
            as row_no, p.description, p.amount
        from {printed_line} p join {visit_flag} f on f.visit_key = p.visit_key
        union all
        select p.visit_key, 2, cast(1 as bigint), p.description, p.amount
        from {printed_line} p join {visit_flag} f on f.visit_key = p.visit_key
        where f.overlapped and p.part = 1 and p.row_no = f.first_rows""",
    ),
    "fragment": (
        ("printed_line", "visit_flag"),
        """select distinct p.visit_key, p.part, p.part = f.last_part or f.apart as complete,
          p.visit_key % 29 = 0 and p.part = f.last_part as clipped,
          cast(case when p.part = f.last_part then 0.50 end as decimal(18,2)) as tax,
          cast(case when f.apart then case when p.part = 1 then f.first_sum else f.second_sum end
                 + case when p.part = f.last_part then 0.50 else 0.00 end
               when p.part = f.last_part
                 then f.total + 0.50 + case when p.visit_key % 11 = 0 then 0.01 else 0.00 end end as decimal(18,2)) as balance
        from {printed_line} p join {visit_flag} f on f.visit_key = p.visit_key""",
    ),
    "receipt": (
        ("txn", "visit_flag"),
        f"""select t.txn_id as receipt_id, t.request_id,
          cast(case when t.txn_id % 6 = 0 then f.total - 0.75 else f.total end as decimal(18,2)) as subtotal,
          cast(case when t.txn_id % 6 = 0 then 0.75 else 0.50 end as decimal(18,2)) as tax,
          t.txn_id % 6 in (0, 1) as tax_inferred,
          cast(f.total + case when t.txn_id % 6 = 0 then 0.00 else 0.50 end
               + case when t.txn_id % 31 = 0 then 0.01 else 0.00 end as decimal(18,2)) as balance,
          case when t.txn_id % 5 = 0 then null when t.txn_id % 23 = 0 then concat(left({_ISO}, 17), '59') else {_ISO} end as stamp,
          left(occurred_at, 10) as named_date,
          case when t.txn_id % 2 = 0 then 'CARD' end as tender, concat('L', t.txn_id % 6) as lane
        from {{txn}} t join {{visit_flag}} f on f.visit_key = t.txn_id""",
    ),
    "visit": (
        ("txn",),
        f"""select txn_id, request_id, {_ISO} as occurred_at, total_pre_discount, tender_type, division_code from {{txn}}""",
    ),
    # documents --------------------------------------------------------------
    "headed": (
        ("document",),
        """select doc_id, concat(left(text, 40), h1, substr(text, 41, 60), h2, substr(text, 101)) as text from (
          select *, case doc_id % 6 when 0 then 'Section 1: Specific Pieces of Personal Information Collected'
              when 1 then 'Data we hold related to our Loyalty program:' when 2 then 'Email Information'
              when 3 then 'Data related to in-store services:' when 4 then 'Information about your purchases:'
              else '' end as h1,
            case doc_id % 4 when 0 then 'Email Information' when 1 then 'Information about your purchases:'
              when 2 then '' else 'Data we hold to communicate and advertise to you in a personalized way:' end as h2
          from {document}) as h""",
    ),
    "response": (
        ("request",),
        """select request_id, display_name, submitted_at, request_id % 3 <> 0 as profile,
          case when request_id % 8 in (0, 1) then 'statement' when request_id % 8 in (2, 3) then 'workbook'
            when request_id % 8 in (4, 5) then 'sections' else 'plain' end as reader,
          case when request_id % 5 = 0 then 'I/ss' else concat(' ', display_name, '  ') end as asked_name,
          case when request_id % 7 = 2 then lower(display_name) else 'Ann' end as holder_name,
          case when request_id % 24 = 4 then null else 'Section 1: Specific Pieces of Personal Information Collected' end as heading,
          request_id % 9 as blobs from {request}""",
    ),
    "prose": (
        ("document",),
        """select request_id, concat(text, '.',
            case when doc_id % 3 = 0 then ' These are the categories of personal data.' else '' end,
            case when doc_id % 5 < 2 then ' We do not include it. Some is exempt by law.' else '' end,
            case when doc_id % 7 = 6 then ' We have no record of sales.' else '' end,
            case when doc_id % 4 = 0 then concat(' For data prior to ', 1990 + doc_id % 9, ' write to us.') else '' end,
            case when doc_id % 9 = 6 then ' The business purpose is service. It was obtained from you.' else '' end) as text
          from {document} where position = 0""",
    ),
    "bundled": (
        ("document",),
        """select doc_id - doc_id % 3 as bundle, doc_id % 3 as position, doc_id, text, original_filename,
          case when doc_id % 7 = 0 then ' SRC1 ' end as declared from {document}""",
    ),
    "file_read": (
        ("document",),
        """select doc_id, doc_id - doc_id % 3 as bundle, doc_id % 3 as position, original_filename,
          case when doc_id % 5 = 0 then 'A scanned page has no text layer.'
               when doc_id % 5 = 1 then concat('The file is an archive of kind ', doc_id % 2, '.') end as reason,
          position('Licensed' in text) > 0 as recognised from {document}""",
    ),
    "capture": (
        ("txn",),
        """select txn_id, concat('shots/shop', request_id % 3, '_', case when txn_id % 10 = 0 then '133197'
            else concat(substr(occurred_at, 6, 2), substr(occurred_at, 9, 2), substr(occurred_at, 3, 2)) end,
            case when txn_id % 3 = 0 then '' when txn_id % 3 = 1 then concat('_', txn_id % 12) else 'x' end, '.png')
          as original_filename from {txn}""",
    ),
}


def _cells(rows: DataFrame) -> DataFrame:
    """The same cells as the text above in one pass over the sheet rows."""

    def at(i: int, row: str, value: str) -> str:
        return (
            f"named_struct('doc_id', txn_id, 'sheet', 'Sheet', 'row_no', {row}, 'col_no',"
            f" cast(({i} + txn_id) % 7 + 1 as int), 'value', {value})"
        )

    body = [at(i, "cast(n as int)", SHEET_FIELDS[h]) for i, h in enumerate(HEADER_NAMES)]
    head = [at(i, "3", f"'{'  ' + h.lower() if i % 2 else h + ' '}'") for i, h in enumerate(HEADER_NAMES)]
    title = (
        "named_struct('doc_id', txn_id, 'sheet', 'Sheet', 'row_no', 1, 'col_no', 1, 'value', 'Purchase history')"
    )
    opening = f"case when n = 4 then array({title}, {', '.join(head)}) else filter(array({title}), x -> false) end"
    return rows.selectExpr(f"explode(concat(array({', '.join(body)}), {opening})) as c").select("c.*")


# Read several times by one query: written once for it, as are the rows that cells are dealt out from.
SHARED = ("printed_line", "visit_flag")


def frame(t: Canonical, name: str) -> DataFrame:
    """The input as a DataFrame, canonical tables included."""
    if name not in INPUTS:
        return getattr(t, name)()
    held = t.__dict__.setdefault("_shared", {})
    if name == "cells":
        if name not in held:
            held[name] = stage(frame(t, "sheet_row").select("txn_id", "n", "description_raw", "upc", "quantity", "loyalty_amt"))
        return _cells(held[name])
    if name not in held:
        needs, text = INPUTS[name]
        found = t.spark.sql(text, **{n: frame(t, n) for n in needs})
        if name not in SHARED:
            return found
        held[name] = stage(found)
    return held[name]


def _plain(text: str, needs: tuple[str, ...]) -> str:
    for n in needs:
        text = text.replace("{" + n + "}", n)
    return text


INPUT_CTES = {name: (needs, _plain(text, needs)) for name, (needs, text) in INPUTS.items()}


def check(text: str, *names: str, **extra) -> str:
    """A check over inputs and canonical tables."""
    return with_tables(text, *names, extra={**INPUT_CTES, **extra})


assert not set(INPUTS) & set(CTES)
