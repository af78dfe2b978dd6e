"""JSON inside documents: where it stands, what it holds, and the rows it becomes.

Values are read through VARIANT, so one malformed element costs that element
and not the document around it.
"""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from disclens.fixed_values import ADDRESS_FIELDS, ALIAS_TYPES, GROUP_SCOPES, IDENTIFIER_FIELDS
from disclens.functions.amounts import num_coerce
from disclens.functions.cells import tender_join
from disclens.functions.dates import ts_normalise
from disclens.functions.text import strip
from disclens.operators.disclosure import literal_map

# One token is a whole string (running to the end of the text where it never closes) or a brace.
_TOKENS = re.compile(r'"(?:[^"\\]|\\.)*(?:"|\\?\Z)|[{}]', re.DOTALL)
_STRINGS = re.compile(r'"(?:[^"\\]|\\.)*"', re.DOTALL)
_LINE_BREAKS = re.compile(r" ?[\r\n]+")
_TRAILING_COMMA = re.compile(r",\s*([}\]])")

SPAN_TYPE = T.ArrayType(
    T.StructType()
    .add("start", T.IntegerType())
    .add("end", T.IntegerType())
    .add("status", T.StringType())
    .add("json", T.StringType())
)
PAIR_TYPE = T.ArrayType(T.StructType().add("key", T.StringType()).add("value", T.StringType()))


def _read(fragment: str) -> tuple[str, str | None]:
    try:
        json.loads(fragment)
        return "ok", fragment
    except RecursionError:
        return "unparseable", None
    except ValueError:
        pass
    # The two repairs: a wrapped line inside a string, and a comma before a closing bracket.
    mended = _STRINGS.sub(lambda m: _LINE_BREAKS.sub(" ", m.group()), fragment)
    mended = _TRAILING_COMMA.sub(r"\1", mended)
    try:
        json.loads(mended)
        return "repaired", mended
    except (ValueError, RecursionError):
        return "unparseable", None


def _spans(text: str | None) -> list[dict]:
    found, depth, start = [], 0, None
    for token in _TOKENS.finditer(text or ""):
        if token.group() == "{":
            start = token.start() if depth == 0 else start
            depth += 1
        elif token.group() == "}" and depth:
            depth -= 1
            if depth == 0:
                status, body = _read(text[start : token.end()])
                found.append({"start": start, "end": token.end(), "status": status, "json": body})
    if depth:
        found.append({"start": start, "end": len(text), "status": "unterminated", "json": None})
    return found


@F.pandas_udf(SPAN_TYPE)
def json_span_array(text: pd.Series) -> pd.Series:
    """Outermost objects of each text; braces inside strings do not count."""
    return text.map(_spans)


def json_spans(docs: DataFrame) -> DataFrame:
    """EXT-01: one row per outermost object of a document, parsed, repaired once, or refused."""
    return docs.select("doc_id", F.explode(json_span_array("text")).alias("s")).select(
        "doc_id", "s.start", "s.end", "s.status", "s.json"
    )


@F.pandas_udf(PAIR_TYPE)
def json_pairs(body: pd.Series) -> pd.Series:
    """Every (key, scalar) of a JSON text at any depth; scalars directly inside arrays carry no key."""

    def scalar(value) -> str | None:
        if value is None or isinstance(value, str):
            return value
        return json.dumps(value)

    def pairs(text: str | None) -> list[dict]:
        try:
            open_nodes = [json.loads(text)] if text else []
        except (ValueError, RecursionError):
            return []
        out = []
        while open_nodes:
            node = open_nodes.pop()
            inner = node.items() if isinstance(node, dict) else [(None, v) for v in node] if isinstance(node, list) else []
            for key, value in inner:
                if isinstance(value, (dict, list)):
                    open_nodes.append(value)
                elif key is not None:
                    out.append({"key": key, "value": scalar(value)})
        return out

    return body.map(pairs)


def json_walk(docs: DataFrame, body: str = "json") -> DataFrame:
    """EXT-02: every key and scalar of each document."""
    return docs.select("doc_id", F.explode(json_pairs(body)).alias("p")).select("doc_id", "p.key", "p.value")


def flat_walk(docs: DataFrame, body: str = "json") -> DataFrame:
    """EXT-02 for objects one level deep, without leaving the JVM."""
    pairs = F.from_json(F.col(body), "map<string,string>")
    return docs.select("doc_id", F.explode(pairs).alias("key", "value"))


def first_blob(blobs: DataFrame, headers: list[str] | None = None, keys: list[str] | None = None) -> DataFrame:
    """EXT-06: the first object of a document under any of some headers, or holding all of some keys."""
    wanted = F.lit(True)
    if headers:
        wanted = wanted & F.col("header").isin(headers)
    if keys:
        own = F.coalesce(F.json_object_keys("json"), F.array().cast("array<string>"))
        wanted = wanted & (F.size(F.array_except(F.array(*[F.lit(k) for k in keys]), own)) == 0)
    return blobs.where(wanted).groupBy("doc_id").agg(
        F.min("start").alias("start"), F.min_by("json", "start").alias("json")
    )


# -- VARIANT helpers ----------------------------------------------------------


def _field(v: Column, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(v, path, kind)


def _list(v: Column, path: str = "$") -> Column:
    """The elements of a JSON list, or NULL where there is none."""
    return _field(v, path, "array<variant>")


def _object(v: Column, path: str = "$") -> Column:
    """The fields of a JSON object, or NULL where there is none."""
    return _field(v, path, "map<string,variant>")


def _named(text: Column) -> Column:
    return F.nullif(strip(text), F.lit(""))


def nested_baskets(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """EXT-07: baskets, their lines and what could not be read, from one customer object per document."""
    parsed = docs.select("doc_id", F.try_parse_json("json").alias("v"))
    first = _field(F.col("v"), "$.customer[0]", "variant")
    alone = F.when(_object(F.col("v"), "$.customer").isNotNull(), _field(F.col("v"), "$.customer", "variant"))
    customer = F.coalesce(alone, F.when(_object(first).isNotNull(), first))
    owned = parsed.select("doc_id", customer.alias("customer"))
    each = owned.select("doc_id", F.posexplode(_list(F.col("customer"), "$.basket")).alias("basket_pos", "basket"))
    b = F.col("basket")
    tenders = F.transform(_list(b, "$.tenders"), lambda t: F.coalesce(_field(t, "$.tendertype"), F.lit("")))
    read = each.select(
        "doc_id", "basket_pos",
        _object(b).isNotNull().alias("is_object"),
        ts_normalise(_field(b, "$.date"), _field(b, "$.time")).alias("occurred_at"),
        _list(b, "$.items").alias("listed"),
        # Something that is neither a list nor nothing stands where the items should.
        F.coalesce(
            _list(b, "$.items").isNull() & (_field(b, "$.items") != ""), F.lit(False)
        ).alias("malformed"),
        _named(_field(b, "$.orderno")).alias("external_order_id"),
        _named(_field(b, "$.store")).alias("store_code"),
        tender_join(tenders).alias("tender_type"),
        num_coerce(_field(b, "$.total_amount_prior_to_discounts")).alias("total_pre_discount"),
    )
    kept = read.where(F.col("is_object") & F.col("occurred_at").isNotNull())
    txns = kept.select(
        "doc_id", "basket_pos", "occurred_at", "external_order_id", "store_code", "tender_type", "total_pre_discount"
    )
    elements = kept.select("doc_id", "basket_pos", F.posexplode("listed").alias("item_pos", "item"))
    i = F.col("item")
    items = elements.where(_object(i).isNotNull()).select(
        "doc_id", "basket_pos", "item_pos",
        F.coalesce(strip(_field(i, "$.purchasedescription")), F.lit("")).alias("description_raw"),
        _named(_field(i, "$.productupc")).alias("upc"),
        num_coerce(_field(i, "$.quantity")).alias("quantity"),
        num_coerce(_field(i, "$.retailamt")).alias("retail_amt"),
        num_coerce(_field(i, "$.customerloyamt")).alias("loyalty_amt"),
    )

    def warn(df: DataFrame, *message: Column | str) -> DataFrame:
        text = F.concat(*[m.cast("string") if isinstance(m, Column) else F.lit(m) for m in message])
        return df.select("doc_id", text.alias("message"))

    pos = F.col("basket_pos")
    warnings = (
        warn(owned.where(F.col("customer").isNull()), "The purchases section had no customer object.")
        .unionByName(warn(read.where(~F.col("is_object")), "Basket ", pos, " was not an object and was skipped."))
        .unionByName(
            warn(
                read.where(F.col("is_object") & F.col("occurred_at").isNull()),
                "Basket ", pos, " had no usable date and was skipped.",
            )
        )
        .unionByName(warn(kept.where("malformed"), "Basket ", pos, " had a malformed item list."))
        .unionByName(
            warn(
                elements.where(_object(i).isNull()),
                "Item ", F.col("item_pos"), " of basket ", pos, " was not an object.",
            )
        )
    )
    return txns, items, warnings


def identity_nested(docs: DataFrame) -> DataFrame:
    """EXT-20: identifiers of nested accounts, whose card numbers are map keys, and of typed groups."""
    parsed = docs.select("doc_id", F.try_parse_json("json").alias("v"))

    def each(df: DataFrame, column: str, path: str, alias: str) -> DataFrame:
        return df.withColumn(alias, F.explode(_list(F.col(column), path)))

    def fields(df: DataFrame, column: str, path: str, alias: str) -> DataFrame:
        return df.select("*", F.explode(_object(F.col(column), path)).alias(f"{alias}_key", alias))

    def row(df: DataFrame, id_type: Column | str, value: Column, scope: Column | str, place: int = 0) -> DataFrame:
        as_column = lambda x: x if isinstance(x, Column) else F.lit(x)
        group = F.col("grp_pos") if "grp_pos" in df.columns else F.lit(-1)
        return df.select(
            "doc_id", as_column(id_type).alias("id_type"), strip(value).alias("value"), as_column(scope).alias("scope"),
            (group * 2 + place).alias("place"),
        )

    accounts = each(each(parsed, "v", "$.accounts", "outer"), "outer", "$.accounts", "account")
    cards = fields(accounts, "account", "$.loyaltyCards", "card")
    alternates = each(cards, "card", "$.altIds", "alt")
    first = _field(F.col("account"), "$.personalInfo.name.firstName")
    last = _field(F.col("account"), "$.personalInfo.name.lastName")
    names = row(accounts, "name", F.concat_ws(" ", _named(first), _named(last)), "individual")
    groups = parsed.select("*", F.posexplode(_list(F.col("v"), "$.groups")).alias("grp_pos", "grp"))
    scope = F.coalesce(
        F.try_element_at(literal_map(GROUP_SCOPES), _field(F.col("grp"), "$.type")), F.lit("individual")
    )
    aliases = fields(groups, "grp", "$.aliasIds", "alias")
    alias_type = F.try_element_at(literal_map(ALIAS_TYPES), F.col("alias_key"))
    metadata = fields(groups, "grp", "$.metadata", "meta")
    meta_type = F.try_element_at(literal_map(ALIAS_TYPES), F.col("meta_key"))
    meta_value = F.when(_object(F.col("meta")).isNotNull(), _field(F.col("meta"), "$.value", "variant")).otherwise(
        F.col("meta")
    )
    address = F.when(
        _object(meta_value).isNotNull(),
        F.concat_ws(", ", *[F.nullif(_field(meta_value, f"$.{f}"), F.lit("")) for f in ADDRESS_FIELDS]),
    ).otherwise(_field(meta_value, "$"))
    found = (
        row(cards, "loyalty_card", F.col("card_key"), "individual")
        .unionByName(row(cards, "loyalty_card", _field(F.col("card"), "$.cardNumberWithCD"), "individual"))
        .unionByName(row(alternates, "alternate_id", _field(F.col("alt"), "$"), "individual"))
        .unionByName(names)
        .unionByName(
            row(aliases, F.coalesce(alias_type, F.lit("internal_person")), _field(F.col("alias"), "$"), scope)
        )
        .unionByName(row(metadata.where(meta_type.isNotNull()), meta_type, _field(meta_value, "$"), scope, 1))
        .unionByName(row(metadata.where(F.lower("meta_key") == "address"), "address", address, "household", 1))
    )
    # Of one identifier stated twice, the first statement says whom it describes.
    return found.where(F.coalesce("value", F.lit("")) != "").groupBy("doc_id", "id_type", "value").agg(
        F.min_by("scope", "place").alias("scope")
    )


def identity_dedup(identities: DataFrame) -> DataFrame:
    """EXT-18: the first sighting of each identifier of a request; blanks name nothing."""
    text = strip("value")
    return (
        identities.where(F.coalesce(text, F.lit("")) != "")
        .groupBy("request_id", "id_type", text.alias("value"))
        .agg(
            F.min("identity_seq").alias("identity_seq"),
            F.min_by(F.struct("scope", "first_seen"), "identity_seq").alias("_first"),
        )
        .select("request_id", "identity_seq", "id_type", "value", "_first.scope", "_first.first_seen")
    )


def identity_unpivot(records: DataFrame) -> DataFrame:
    """EXT-19: a wide customer record as identifier rows; an address describes a household."""
    rows = [
        F.struct(F.lit(kind).alias("id_type"), strip(F.col(field).cast("string")).alias("value"), F.lit(scope).alias("scope"))
        for field, kind, scope in IDENTIFIER_FIELDS
        if field in records.columns
    ]
    parts = [F.nullif(strip(F.col(f).cast("string")), F.lit("")) for f in ADDRESS_FIELDS if f in records.columns]
    rows.append(
        F.struct(F.lit("address").alias("id_type"), F.concat_ws(", ", *parts).alias("value"), F.lit("household").alias("scope"))
    )
    return (
        records.select("request_id", F.explode(F.array(*rows)).alias("r"))
        .select("request_id", "r.id_type", "r.value", "r.scope")
        .where(F.coalesce("value", F.lit("")) != "")
    )
