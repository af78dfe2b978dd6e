"""Landed files: what each one is, and whether it was seen before."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed values: opening bytes (hex) and media types
PDF_MAGIC = "255044462D"
ZIP_MAGIC = "504B0304"
IMAGE_MAGIC = [
    ("89504E470D0A1A0A", "image/png"),
    ("FFD8FF", "image/jpeg"),
    ("474946383761", "image/gif"),
    ("474946383961", "image/gif"),
]
WEBP_MAGIC = "57454250"
SPREADSHEET_NAMESPACE = "urn:schemas-microsoft-com:office:spreadsheet"
WORKBOOK_PART = "xl/workbook.xml"
PROLOG_CHARACTERS = 4096
TEXT_SUFFIXES = ["txt", "text", "json", "csv", "md"]
MEDIA_TYPES = {
    "pdf": "application/pdf",
    "spreadsheetml": "application/vnd.ms-excel",
    "xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
    "text": "text/plain",
    "archive": "application/zip",
}


def landed_files(spark: SparkSession, path: str) -> DataFrame:
    """(original_filename, content) of every file under a path."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(
        F.element_at(F.split("path", "/"), -1).alias("original_filename"), "content"
    )


#: A zip ends with a record of at most 22 + 65,535 bytes that says where the list of its names begins.
ZIP_ENDING = 65_557
ZIP_LIST_AT = r"(?s)^.*PK\x05\x06.{12}(.{4})"
ZIP_NAME = rf"(?s)PK\x01\x02.{{24}}\x{len(WORKBOOK_PART):02x}\x00.{{16}}\Q{WORKBOOK_PART}\E"


def holds_workbook(content: Column) -> Column:
    """Whether a zip lists a workbook among its names; the name elsewhere in its bytes does not count."""
    size = F.octet_length(content)
    ending = F.decode(F.substring(content, F.greatest(size - ZIP_ENDING, F.lit(0)) + 1, F.lit(ZIP_ENDING)), "ISO-8859-1")
    at = F.hex(F.encode(F.regexp_extract(ending, ZIP_LIST_AT, 1), "ISO-8859-1"))
    number = F.conv(F.concat(*[F.substring(at, k, 2) for k in (7, 5, 3, 1)]), 16, 10).cast("bigint")
    names = F.substring(content, F.least(number, size.cast("bigint")).cast("int") + 1, size)
    return F.coalesce((F.length(at) == 8) & F.decode(names, "ISO-8859-1").rlike(ZIP_NAME), F.lit(False))


def file_kind(content: Column, filename: Column) -> Column:
    """By content before suffix, and as an archive only when nothing else fits."""
    head = F.hex(F.substring(content, 1, 16))
    # Cut by characters, of which each has four bytes at most; a later part need not be text.
    opening = F.substring(F.make_valid_utf8(F.substring(content, 1, 4 * PROLOG_CHARACTERS).cast("string")), 1, PROLOG_CHARACTERS)
    suffix = F.lower(F.regexp_extract(filename, r"\.([^.]+)$", 1))
    image = F.lit(None).cast("string")
    for magic, media in IMAGE_MAGIC:
        image = F.coalesce(image, F.when(F.startswith(head, F.lit(magic)), F.lit(media)))
    image = F.coalesce(image, F.when(F.substring(head, 17, 8) == WEBP_MAGIC, F.lit("image/webp")))
    is_zip = F.startswith(head, F.lit(ZIP_MAGIC))
    sheet = opening.rlike(r"^\s*<\?xml") & F.contains(opening, F.lit(SPREADSHEET_NAMESPACE))
    return (
        F.when((suffix == "pdf") | F.startswith(head, F.lit(PDF_MAGIC)), "pdf")
        .when(F.coalesce(sheet, F.lit(False)), "spreadsheetml")
        .when(image.isNotNull(), image)
        .when(F.when(is_zip, holds_workbook(content)).otherwise(False), "xlsx")
        .when(suffix.isin(TEXT_SUFFIXES), "text")
        .when(suffix.isin("xls", "xlsx"), "binary_workbook")
        .when(is_zip, "archive")
        .otherwise("unsupported")
    )


def doc_manifest(files: DataFrame) -> DataFrame:
    """SRC-01: hash, size and media type of each file; an empty one is refused."""
    kind = F.col("kind")
    media = F.when(F.startswith(kind, F.lit("image/")), kind)
    for name, value in MEDIA_TYPES.items():
        media = F.coalesce(media, F.when(kind == name, F.lit(value)))
    return files.withColumn("kind", file_kind(F.col("content"), F.col("original_filename"))).select(
        *[c for c in files.columns if c != "content"],
        F.sha2("content", 256).alias("sha256"),
        F.octet_length("content").cast("bigint").alias("size"),
        "kind",
        media.alias("media_type"),
        (F.octet_length("content") == 0).alias("refused"),
    )


def dup_within_batch(docs: DataFrame) -> DataFrame:
    """SRC-02: hashes that arrive more than once in one batch."""
    return docs.groupBy("sha256").agg(F.count(F.lit(1)).alias("copies")).where(F.col("copies") > 1)


def dup_across_store(new_docs: DataFrame, stored: DataFrame, requests: DataFrame) -> DataFrame:
    """SRC-03: documents already held, with the earliest request that holds them.

    The stored side is reduced to one holder per hash first, so many copies of
    one document never meet each other.
    """
    holders = stored.groupBy("sha256").agg(F.min("request_id").alias("holder_id"))
    named = holders.join(
        requests.select(F.col("request_id").alias("holder_id"), F.col("display_name").alias("holder")), "holder_id", "left"
    )
    return new_docs.join(named, "sha256")


def fresh(new_docs: DataFrame, stored: DataFrame) -> DataFrame:
    """SRC-03, the survivors."""
    return new_docs.join(stored.select("sha256").distinct(), "sha256", "left_anti")


def key_unique(docs: DataFrame) -> DataFrame:
    """SRC-04: one document per request and hash, the first stored of equals.

    Aggregated rather than de-duplicated by window, so a much copied document
    is combined before it is shuffled.
    """
    others = [c for c in docs.columns if c not in ("request_id", "sha256", "source_document_id")]
    return docs.groupBy("request_id", "sha256").agg(
        F.min("source_document_id").alias("source_document_id"),
        *[F.min_by(c, "source_document_id").alias(c) for c in others],
    )
