"""The text operators as queries over the given tables: names in, names out."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from disclens.llm import (
    byte_bpe,
    chained_passages,
    divergence,
    fertility,
    fuzzy_lines,
    leaks,
    licences,
    mixing,
    sharding,
    simhash_trie,
    suffix_levels,
    toxicity,
    whitening,
)
from disclens.llm.shared import ID

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}


def _query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").withColumnRenamed("doc_id", ID)


@_query
def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents on 16 shards whose counts are at most one apart."""
    return sharding.shard_documents(_documents(spark, sf_dir), shards=16).select(
        F.col(ID).alias("doc_id"),
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


@_query
def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with one occurrence of each group of fuzzy lines."""
    kept = fuzzy_lines.without_repeated_lines(_documents(spark, sf_dir), budget=None, removed="removed")
    return kept.select(F.col(ID).alias("doc_id"), F.size("removed").cast("long").alias("n_removed"), "text")


@_query
def op3_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence notices of all documents."""
    return licences.licence_notices(_documents(spark, sf_dir)).select(
        F.col(ID).alias("doc_id"),
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        F.concat_ws(",", "base_labels").alias("base_labels"),
        F.concat_ws(",", "labels").alias("labels"),
        "score",
        F.size("detections").cast("long").alias("n_detections"),
    )


@_query
def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality figures of all documents under two public vocabularies, in the bands of their languages."""
    return fertility.quality_figures(
        _documents(spark, sf_dir),
        piece_path=public_tokenizers.path("piece_bpe_32k.model"),
        rank_path=public_tokenizers.path("byte_bpe_multi_50k.tiktoken"),
        pattern=public_tokenizers.PATTERN,
        language="lang",
    ).withColumnRenamed(ID, "doc_id")


@_query
def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents whose fingerprints differ in at most two bits."""
    return simhash_trie.near_copies(_documents(spark, sf_dir)).select(
        F.col(ID).alias("doc_id"), F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id"
    )


HELD_OUT = f"crc32(cast({ID} as string)) % 3 = 1"


@_query
def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents, learned from the marks outside the held-out third."""
    marks = spark.read.parquet(f"{sf_dir}/labels.parquet").withColumnRenamed("doc_id", ID)
    return toxicity.toxicity(_documents(spark, sf_dir), marks, learn=f"not ({HELD_OUT})").select(
        F.col(ID).alias("doc_id"), F.expr(HELD_OUT).alias("held_out"), "score", "predicted"
    )


@_query
def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark passages in all documents, up to one word in five changed."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return leaks.passages_in(_documents(spark, sf_dir), benchmark).select(
        F.col(ID).alias("doc_id"),
        (F.col("n_items") > 0).alias("contaminated"),
        "n_items",
        F.transform("items", lambda i: i["item_id"]).alias("item_ids"),
        "least_distance",
    )


@_query
def op8_byte_level_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of all documents and the bytes they decode to, as digests."""
    return token_digests(_documents(spark, sf_dir)).withColumnRenamed(ID, "doc_id")


def token_digests(documents: DataFrame) -> DataFrame:
    encoded = byte_bpe.encode_and_decode(
        documents, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    )
    return encoded.select(
        ID, "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


@_query
def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fuzzy passages that documents share, as each document's group, links and stretches."""
    return chained_passages.passage_groups(_documents(spark, sf_dir)).withColumnRenamed(ID, "doc_id")


@_query
def op10_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the bytes that repeated 200-byte strings cover."""
    return suffix_levels.remove_repeats(_documents(spark, sf_dir)).select(
        F.col(ID).alias("doc_id"),
        "n_bytes",
        F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["n_bytes"]).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def _of_retailers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents as those of retailers under statutes: sources are retailers, languages are statutes."""
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return documents.select(F.col("doc_id").alias(ID), "text", F.col("lang").alias("statute"), F.col("source").alias("retailer_id"))


@_query
def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Divergence between the sources of each language, and the terms that set a source apart."""
    found = divergence.retailer_divergence(_of_retailers(spark, sf_dir))
    return found.withColumnsRenamed({"statute": "lang", "retailer_id": "source"})


CHECKS["op11_source_divergence"] = r"""
with told as (
    select row_number() over () as row_id, coalesce(lang, '') as lang, coalesce(source, '') as source,
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as text
    from documents),
words as (
    select row_id, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) as term from told),
counts as (
    select lang, source, term, count(*) as n, count(distinct row_id) as documents from words group by lang, source, term),
terms as (
    select lang, term, sum(n)::hugeint as all_n from counts group by lang, term having sum(documents) >= 30),
whole as (select lang, count(*)::hugeint as v, sum(all_n)::hugeint as words from terms group by lang),
groups as (
    select g.lang, g.source, coalesce(v, 0)::hugeint as v, coalesce(w.words, 0)::hugeint as all_words,
        coalesce((select sum(c.n) from counts c join terms t on t.lang = c.lang and t.term = c.term
            where c.lang = g.lang and c.source = g.source), 0)::hugeint as words
    from (select distinct lang, source from told) g left join whole w on w.lang = g.lang),
shares as (
    select g.lang, g.source, t.term, coalesce(c.n, 0) as n,
        1 + (1000000000 * (coalesce(c.n, 0) + 5)::hugeint) // (g.words + 5 * g.v) as p,
        1 + (1000000000 * (t.all_n + 5)) // (g.all_words + 5 * g.v) as q
    from groups g join terms t on t.lang = g.lang
    left join counts c on c.lang = g.lang and c.source = g.source and c.term = t.term),
pairs as (
    select a.lang, a.source, 'pair' as part, b.source as item,
        coalesce((select sum(abs(x.p - y.p)) from shares x join shares y on y.lang = x.lang and y.term = x.term
            where x.lang = a.lang and x.source = a.source and y.source = b.source), 0)::bigint as value
    from groups a join groups b on b.lang = a.lang and b.source <> a.source),
apart as (select lang, source, 'term' as part, term as item, (p - q)::bigint as value from shares where n > 0 and p > q),
ranked as (
    select *, row_number() over (partition by lang, source, part order by value desc, item)::int as rank
    from (select * from pairs union all select * from apart))
select lang, source, part, item, value, rank from ranked where part = 'pair' or rank <= 50
"""


@_query
def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings along their four largest directions of variance, each brought to variance 1."""
    return whitening.whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet")).withColumn(
        "deviation", F.expr("try_cast(deviation as bigint)")
    )


@_query
def op13_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often the mixture takes each document, sources weighing 1, 2, 3 in turn and stopping at 3 times their words."""
    return mixing.mixing_plan(_of_retailers(spark, sf_dir)).select(
        F.col(ID).alias("doc_id"), "size", F.col("retailer_size").alias("source_size"), "target", "taken"
    )


CHECKS["op13_source_mixing"] = r"""
with sized as (
    select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size,
        ('0x' || md5('mix:' || coalesce(doc_id::varchar, '') || ':' || coalesce(text, ''))[1:13])::bigint / 4503599627370496.0::double as draw
    from documents),
sources as (
    select source, sum(size)::hugeint as source_size, ((row_number() over (order by source nulls last) - 1) % 3 + 1)::hugeint as weight
    from sized group by source),
lined as (
    select *, coalesce(sum(3 * source_size) over filled, 0)::hugeint as full_words, coalesce(sum(weight) over filled, 0)::hugeint as full_weight,
        row_number() over (order by source_size * 6 // weight, source nulls last) as place,
        sum(source_size) over ()::hugeint as words, sum(weight) over ()::hugeint as weights
    from sources
    window filled as (order by source_size * 6 // weight, source nulls last rows between unbounded preceding and 1 preceding)),
level as (
    select (words - full_words)::double / (weights - full_weight)::double as level, words - full_words as rest, weights - full_weight as free
    from lined where (words - full_words) * weight <= 3 * source_size * (weights - full_weight)
    order by place limit 1),
targets as (
    select source, source_size::bigint as source_size,
        case when rest * weight > 3 * source_size * free then (3 * source_size)::double else level * weight::double end as target
    from sources, level),
rated as (
    select doc_id, size, source_size, target, draw, case when source_size > 0 then least(3.0::double, target / source_size::double) else 0 end as rate
    from sized s join targets t on t.source is not distinct from s.source)
select doc_id, size, source_size, target, (size * (floor(rate) + case when draw < rate - floor(rate) then 1 else 0 end))::bigint as taken
from rated
"""
