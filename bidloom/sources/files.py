"""Manifests, stored rows and payloads as DataFrames, and sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPLOAD_TYPES = [".pdf", ".png", ".jpg", ".jpeg", ".tif", ".tiff"]
IMAGE_TYPES = [".png", ".jpg", ".jpeg", ".tif", ".tiff", ".bmp", ".webp"]
MAX_BYTES = 50 * 1024 * 1024

PAYLOAD = (
    "struct<tender_id: string, criteria: array<struct<id: string, field: string, operator: string, value: double>>, "
    "bidders: array<struct<bidder_id: string, documents: array<struct<id: string, doc_type: string, "
    "ocr: struct<quality_score: double, text: string>>>>>>"
)


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))


def admit(files: DataFrame, most: int = MAX_BYTES) -> DataFrame:
    """Whether each file may be uploaded, or why not; a limit under 1 KiB is ignored."""
    most = most if most >= 1024 else MAX_BYTES
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    why = (
        F.when(~extension(F.col("path")).isin(UPLOAD_TYPES), "bad_extension").when(name.contains(".."), "bad_name")
        .when(F.col("size") > most, "too_large")
    )
    return files.withColumn("reject_reason", why).withColumn("admitted", why.isNull())


def engine(path: Column) -> Column:
    ext = extension(path)
    return F.when(F.coalesce(path, F.lit("")) == "", "missing_file").when(ext == ".pdf", "pdf").when(ext.isin(IMAGE_TYPES), "image").otherwise("none")


def read_criteria(rows: DataFrame) -> DataFrame:
    """Payloads as columns; the row's id stands over the payload's, broken payloads are left out."""
    v = F.try_parse_json("payload")
    get = lambda path, kind: F.try_variant_get("v", path, kind)
    return rows.withColumn("v", v).filter("v is not null").select(
        "id", "tender_id", get("$.field", "string").alias("field"), get("$.operator", "string").alias("operator"),
        get("$.value", "double").alias("value"),
    )


def read_payloads(rows: DataFrame) -> DataFrame:
    """Evaluation payloads (JSON text) as one row per document, positions kept.

    Each is parsed once: a generator stands between parsing and what is asked of the result.
    """
    p = rows.select(F.explode_outer(F.array(F.from_json("payload", PAYLOAD))).alias("p")).filter("p is not null")
    bidders = p.select("p.tender_id", F.size("p.criteria").alias("n_criteria"), F.posexplode("p.bidders").alias("bidder_pos", "b"))
    docs = bidders.select("tender_id", "n_criteria", "bidder_pos", "b.bidder_id", F.posexplode("b.documents").alias("doc_pos", "d"))
    return docs.select("tender_id", "n_criteria", "bidder_pos", "bidder_id", "doc_pos", F.col("d.id").alias("doc_id"),
                       "d.doc_type", "d.ocr.quality_score", "d.ocr.text")


def object_ref(bucket: Column, key: Column) -> Column:
    return F.concat(F.lit("s3:"), bucket, F.lit(":"), key)


def split_ref(ref: Column) -> Column:
    """bucket and key of a reference; null unless both are there."""
    pattern = "(?is)^s3:([^:]+):(.+)$"
    made = F.struct(F.regexp_extract(ref, pattern, 1).alias("bucket"), F.regexp_extract(ref, pattern, 2).alias("key"))
    return F.when(ref.rlike(pattern), made)


def write_tenders(rows: DataFrame, path: str) -> None:
    """Replace the stored rows of the tender partitions that ``rows`` touches."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("tender_bucket").parquet(path)
