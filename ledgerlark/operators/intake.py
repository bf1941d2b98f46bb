"""Upload gate and duplicate documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..constants import MAX_BYTES, MIME_TYPES, MIN_BYTES
from ..functions.text import fixed, mime_base


def gate_error(content_type: Column, size: Column) -> Column:
    """Error code of an upload, null where it may pass: type first, then too small, then too large."""
    return (
        F.when(~F.coalesce(mime_base(content_type), F.lit("")).isin(*MIME_TYPES), "ERR_UNSUPPORTED_FORMAT")
        .when(size < MIN_BYTES, "ERR_EMPTY_FILE")
        .when(size > MAX_BYTES, "ERR_FILE_TOO_LARGE")
    )


def gate_message(size: Column) -> Column:
    small = F.format_string(f"File is too small (%d bytes). Minimum is {MIN_BYTES} bytes.", size)
    large = F.concat(F.lit("File size "), fixed(size / 1024**2, 1, True), F.lit(f" MB exceeds the {MAX_BYTES // 1024**2} MB limit."))
    return F.when(size < MIN_BYTES, small).when(size > MAX_BYTES, large)


def gate(uploads: DataFrame) -> DataFrame:
    """Adds error_code and error_message to ``uploads(content_type, file_size_bytes, …)``."""
    code = gate_error(F.col("content_type"), F.col("file_size_bytes"))
    return uploads.withColumn("error_code", code).withColumn("error_message", F.when(F.col("error_code").isin("ERR_EMPTY_FILE", "ERR_FILE_TOO_LARGE"), gate_message(F.col("file_size_bytes"))))


def store_path(base: str, org: Column, at: Column, document_id: Column, filename: Column) -> Column:
    """Where a raw file is kept: base, organisation, year, month, id and lower-case extension (.bin without one)."""
    ext = F.lower(F.regexp_extract(filename, r"(\.[^./\\]+)$", 1))
    return F.concat(F.concat_ws("/", F.lit(base), org, F.date_format(at, "yyyy"), F.date_format(at, "MM"), document_id), F.coalesce(F.nullif(ext, F.lit("")), F.lit(".bin")))


def first_by_hash(batch: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """Adds ``duplicate_of``: the id of the document of equal hash that came first, null where this one is the first.

    ``batch(document_id, file_hash, ord)``; ``stored(id, file_hash)`` holds what is known already, failed ones included.
    A hash that many rows share is settled by one minimum for each hash, combined before the shuffle.
    """
    first = batch.groupBy("file_hash").agg(F.min(F.struct("ord", "document_id")).alias("f")).select("file_hash", F.col("f.document_id").alias("_first"))
    if stored is not None:
        known = stored.groupBy("file_hash").agg(F.min("id").alias("_known"))
        first = first.join(known, "file_hash", "left").select("file_hash", F.coalesce("_known", "_first").alias("_first"))
    return batch.join(first, "file_hash", "left").withColumn("duplicate_of", F.when(F.col("_first") != F.col("document_id"), F.col("_first"))).drop("_first")


def logical_duplicates(invoices: DataFrame) -> DataFrame:
    """Invoices that share tax id, number and date with another; adds how many do and the smallest id among them."""
    w = W.partitionBy("vendor_tax_id", "invoice_number", "invoice_date")
    known = invoices.where("vendor_tax_id is not null and invoice_number is not null and invoice_date is not null")
    return known.withColumn("copies", F.count("*").over(w)).withColumn("first_id", F.min("id").over(w)).where("copies > 1")
