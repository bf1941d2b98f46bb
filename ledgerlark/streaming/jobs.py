"""Streaming jobs: intake of extracted records from a landing folder, and windowed alerts over stage logs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.analytics import rate_by_window
from ..operators.vendors import CONTACT
from ..plans.pipeline import process
from ..schemas import EXTRACTED
from ..settings import Settings
from ..sources.sinks import read_latest, write_batch
from ..sources.versioned import VersionedTable


def landing(spark: SparkSession, path: str, per_trigger: int = 1000) -> DataFrame:
    schema = f"document_id string, ord bigint, ocr_confidence double, file_hash string, {EXTRACTED}"
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).json(path)


def vendors_table(spark: SparkSession, path: str) -> VersionedTable:
    return VersionedTable(spark, path, {"vendor_key": "string"}, {c: "string" for c in ("id", "name", "tax_id", *CONTACT)})


def _merge_vendors(dimension: VersionedTable, touched: DataFrame, number: int) -> None:
    """Appends what a batch adds to the dimension: whole rows of new vendors, contacts of known ones."""
    rows = touched.withColumn("seq", F.lit(number))
    dimension.append(rows.where("created"), f"{number:012d}-new", ["id", "name", "tax_id", *CONTACT])
    dimension.append(rows.where("not created"), f"{number:012d}-known", CONTACT)


def run_intake(stream: DataFrame, base: str, checkpoint: str, settings: Settings | None = None, stored: Callable[[], DataFrame | None] = lambda: None, dimension: VersionedTable | None = None, compact_every: int = 50) -> StreamingQuery:
    """Processes each micro-batch with the batch pipeline and publishes its tables under the batch's number.

    Hashes are remembered for ever in the stored table, not in streaming state, which would grow without bound: each
    batch is compared with ``stored()`` and with itself. With a ``dimension`` (``vendors_table``) a batch reads the
    vendors' snapshot and publishes only the vendors that it names; each ``compact_every`` batches changes are folded in.
    Without one it publishes the whole vendor dimension, merged into that of the batch before it. A batch that runs
    again replaces its own files and changes.
    """
    from ..operators.intake import first_by_hash

    def handle(batch: DataFrame, number: int) -> None:
        fresh = first_by_hash(batch, stored()).where("duplicate_of is null").drop("duplicate_of")
        if dimension is None:
            before = read_latest(batch.sparkSession, base, "vendors", f"{number:012d}")
        else:  # a vendor that an earlier run of this batch made is new again
            before = dimension.read(history=True).where(F.col("id_seq") < number)
        tables = process(fresh, settings, before, f"{base}/_validated/batch={number:012d}")
        if dimension is not None:
            tables["vendors"] = tables["vendors"].where("invoices > 0")
        tables["hashes"] = fresh.select(F.col("document_id").alias("id"), "file_hash")
        write_batch(tables, base, f"{number:012d}")
        if dimension is not None:
            _merge_vendors(dimension, batch.sparkSession.read.parquet(f"{base}/vendors/batch={number:012d}"), number)
            if number % compact_every == compact_every - 1:
                dimension.compact()

    return stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def failure_alerts(logs: DataFrame, delay: str = "10 minutes", width: str = "1 hour", limit: float = 0.05) -> DataFrame:
    """Windows of a log stream with their failure rate; late rows are taken for ``delay``."""
    return rate_by_window(logs.withWatermark("created_at", delay), F.col("status") == "FAILURE", width, limit)


def review_alerts(statuses: DataFrame, delay: str = "10 minutes", width: str = "1 hour", limit: float = 0.30) -> DataFrame:
    """Windows with the share of documents sent to review."""
    return rate_by_window(statuses.withWatermark("created_at", delay), F.col("status") == "REVIEW_REQUIRED", width, limit)
