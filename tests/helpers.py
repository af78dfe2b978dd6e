"""Hand-built canonical rows."""

from decimal import Decimal

ITEM_SCHEMA = (
    "item_id string, txn_id bigint, request_id bigint, description_raw string, upc string,"
    " quantity decimal(18,4), retail_amt decimal(18,2), loyalty_amt decimal(18,2)"
)
TXN_SCHEMA = (
    "txn_id bigint, request_id bigint, occurred_at string, store_code string, division_code string,"
    " tender_type string, total_pre_discount decimal(18,2)"
)


def money(x):
    return None if x is None else Decimal(str(x))


def items(spark, *rows):
    """(item_id, txn_id, request_id, description, upc, quantity, retail, loyalty)"""
    return spark.createDataFrame(
        [(i, t, r, d, u, money(q), money(a), money(b)) for i, t, r, d, u, q, a, b in rows], ITEM_SCHEMA
    )


def txns(spark, *rows):
    """(txn_id, request_id, occurred_at, total)"""
    return spark.createDataFrame(
        [(t, r, at, None, None, None, money(total)) for t, r, at, total in rows], TXN_SCHEMA
    )


def shopping(spark, amounts, description="OAT MILK", upc="0001", request_id=1, start=1):
    """One purchase per visit, in date order, of one product at the given shelf prices."""
    lines = [
        (f"i{start + n:04}", start + n, request_id, description, upc, None, a, None) for n, a in enumerate(amounts)
    ]
    visits = [
        (start + n, request_id, f"2020-{1 + n // 28:02}-{1 + n % 28:02}", None) for n in range(len(amounts))
    ]
    return items(spark, *lines), txns(spark, *visits)


def plan_of(df):
    """The optimised plan as text."""
    return df._jdf.queryExecution().optimizedPlan().toString()
