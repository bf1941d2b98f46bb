"""The documents table with changes in place: extraction results, status, soft deletion and retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.versioned import VersionedTable

COLUMNS = {"filename": "string", "file_hash": "string", "source_type": "string", "status": "string", "raw_ocr_text": "string", "created_at": "timestamp"}
RETENTION_YEARS = 7


def documents_table(spark: SparkSession, path: str) -> VersionedTable:
    return VersionedTable(spark, path, {"id": "string"}, COLUMNS)


def store_uploads(documents: VersionedTable, rows: DataFrame, batch_id: str) -> None:
    """New documents: ``rows(id, seq, filename, file_hash, created_at)`` with status UPLOADED."""
    documents.append(rows.withColumn("status", F.lit("UPLOADED")), batch_id, ["filename", "file_hash", "created_at", "status"])


def store_extraction(documents: VersionedTable, rows: DataFrame, batch_id: str) -> None:
    """Text, source and status set together: ``rows(id, seq, raw_ocr_text, source_type)``; the status is OCR_COMPLETED."""
    documents.append(rows.withColumn("status", F.lit("OCR_COMPLETED")), batch_id, ["raw_ocr_text", "source_type", "status"])


def set_status(documents: VersionedTable, rows: DataFrame, batch_id: str) -> None:
    documents.append(rows.select("id", "seq", "status"), batch_id, ["status"])


def expired(row: dict[str, Column], today: Column, years: int = RETENTION_YEARS) -> Column:
    """Rows past retention: made, or marked as deleted, more than ``years`` ago."""
    since = F.coalesce(row["deleted_at"], row["created_at"])
    return since < F.add_months(today, -12 * years)
