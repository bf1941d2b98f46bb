"""The invoice pipeline over a batch: gate and duplicates, validation, persistence, logs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import intake, persistence, vendors
from ..operators.normalization import normalize_invoices
from ..operators.rules import decide, validate, with_checks, with_reasons
from ..settings import Settings


def judged(uploads: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """``uploads(document_id, filename, content_type, file_size_bytes, file_hash, ord)`` with error_code (null: accepted), error_message and duplicate_of."""
    gated = intake.gate(uploads)
    seen = intake.first_by_hash(gated.where("error_code is null"), stored)
    bad = gated.where("error_code is not null").withColumn("duplicate_of", F.lit(None).cast("string"))
    return seen.withColumn("error_code", F.when(F.col("duplicate_of").isNotNull(), "ERR_DUPLICATE_DOCUMENT")).unionByName(bad)


def process(extracted: DataFrame, settings: Settings | None = None, stored_vendors: DataFrame | None = None, saved: str | None = None) -> dict[str, DataFrame]:
    """Gold frames of a batch of extracted records (document_id, ord, ocr_confidence and the bronze columns).

    Rows whose values don't fit the stored columns leave nothing but a failed status and a failure log, and create no
    vendor. Nothing is collected; the vendor key is the only shuffle besides the writes. Every frame returned reads the
    decided rows: with ``saved``, a shared folder, they are written there once and not computed for each frame anew. Only
    the logs build the checks, as the other frames need no more than the decision.
    """
    s = settings or Settings()
    normal = normalize_invoices(extracted, ("document_id", "ord", "ocr_confidence")).withColumn("persistable", persistence.persistable())
    silver = decide(normal, s.tolerance, s.review_threshold)
    if saved:
        silver.write.mode("overwrite").option("compression", "zstd").parquet(saved)
        silver = silver.sparkSession.read.schema(silver.schema).parquet(saved)
        checked = with_reasons(with_checks(silver, s.tolerance), s.review_threshold)
    else:
        checked = validate(normal, s.tolerance, s.review_threshold)
    good, bad = silver.where("persistable"), silver.where("not persistable")
    keyed = vendors.new_vendor_rows(good)
    status = good.select("document_id", persistence.final_status(F.col("decision")).alias("status"))
    logs = persistence.validation_logs(checked).unionByName(persistence.persistence_logs(keyed))
    logs = logs.unionByName(persistence.failure_logs(bad, "PERSISTENCE", "ERR_DATABASE_FAILURE", F.lit("a value does not fit its stored column")))
    return {
        "invoices": persistence.invoice_rows(good),
        "invoice_items": persistence.item_rows(good),
        "vendors": vendors.upsert(good, stored_vendors),
        "status": status.unionByName(bad.select("document_id", F.lit("FAILED").alias("status"))),
        "processing_logs": logs,
    }
