"""The identifiers that a line-oriented report holds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from disclens.fixed_values import (
    FIRST_VISIT_FIELD,
    HOLDER_NAME,
    REPORT_ADDRESS,
    REPORT_IDENTIFIERS,
    REPORT_TABLES,
    REQUEST_DETAILS,
    REQUESTER_NAME,
)
from disclens.functions.cells import present


def report_identities(fields: DataFrame) -> DataFrame:
    """EXT-19, the reports' own table: ``(doc_id, id_type, value, scope, first_seen)``, each identifier of a document once.

    ``fields`` are those of :func:`extract_text.report_fields`: ``(doc_id,
    section, section_no, field_no, key, value)``. Identifiers count in the known
    tables only; a card carries the first visit; the name of the request, the
    name of the profile and its address are composed. Values that stand for
    nothing are left out. One pass of the fields is reduced per document.
    """
    visits, profile = REPORT_TABLES[0], REPORT_TABLES[1]
    held = fields.withColumn("value", present(F.col("value"))).where(
        F.col("value").isNotNull() & F.col("section").isin(*REPORT_TABLES, REQUEST_DETAILS)
    )
    order = F.struct(F.coalesce("section_no", F.lit(-1)).alias("section_no"), F.coalesce("field_no", F.lit(-1)).alias("field_no"))
    first = lambda section, key: F.min_by("value", F.when((F.col("section") == section) & (F.col("key") == key), order))
    kind = F.create_map(*[F.lit(x) for field, id_type, _ in REPORT_IDENTIFIERS for x in (field, id_type)])
    scope = F.create_map(*[F.lit(x) for field, _, s in REPORT_IDENTIFIERS if s for x in (field, s)])
    own = F.struct(
        order.alias("place"), F.element_at(kind, F.col("key")).alias("id_type"), "value", F.element_at(scope, F.col("key")).alias("scope")
    )
    listed = (F.col("section") != REQUEST_DETAILS) & F.col("key").isin([f for f, _, _ in REPORT_IDENTIFIERS])
    street, rest = REPORT_ADDRESS
    whole = held.groupBy("doc_id").agg(
        F.array_sort(F.collect_list(F.when(listed, own))).alias("own"),
        first(visits, FIRST_VISIT_FIELD).alias("first_visit"),
        *[first(REQUEST_DETAILS, k).alias(f"r{n}") for n, k in enumerate(REQUESTER_NAME)],
        *[first(profile, k).alias(f"p{n}") for n, k in enumerate(HOLDER_NAME)],
        first(profile, street).alias("street"),
        *[first(profile, k).alias(f"a{n}") for n, k in enumerate(rest)],
    )

    def made(id_type: str, value: Column, scope: str) -> Column:
        return F.struct(
            F.lit(None).cast("struct<section_no:bigint,field_no:bigint>").alias("place"), F.lit(id_type).alias("id_type"),
            value.alias("value"), F.lit(scope).alias("scope"),
        )

    joined = lambda name, many: F.concat_ws(" ", *[f"{name}{n}" for n in range(len(many))])
    address = F.when(F.col("street").isNotNull(), F.concat_ws(", ", "street", F.nullif(joined("a", rest), F.lit(""))))
    composed = F.array(
        made("name", joined("r", REQUESTER_NAME), "individual"),
        made("name", joined("p", HOLDER_NAME), "individual"),
        made("address", address, "household"),
    )
    own_type = "array<struct<place:struct<section_no:bigint,field_no:bigint>,id_type:string,value:string,scope:string>>"
    every = F.filter(F.concat(F.col("own").cast(own_type), composed.cast(own_type)), lambda r: F.coalesce(r["value"], F.lit("")) != "")
    rows = whole.select("doc_id", "first_visit", F.posexplode(every).alias("n", "r"))
    return (
        rows.groupBy("doc_id", F.col("r.id_type").alias("id_type"), F.col("r.value").alias("value"))
        .agg(F.min_by(F.col("r.scope"), F.col("n")).alias("scope"), F.max("first_visit").alias("first_visit"))
        .select("doc_id", "id_type", "value", "scope", F.when(F.col("id_type") == "loyalty_card", F.col("first_visit")).alias("first_seen"))
    )
