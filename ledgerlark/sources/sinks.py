"""Sinks: append-only tables published under a batch id, and the raw file store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_batch(tables: dict[str, DataFrame], base: str, batch_id: str) -> None:
    """Writes every table's rows under the batch id, then publishes the batch in a manifest.

    Files of a table are atomic in Spark, several tables are not: readers take published batches only, and a repeated
    batch replaces its own files, so a batch is there wholly and once, or not at all.
    """
    spark = next(iter(tables.values())).sparkSession
    for name, df in tables.items():
        df.withColumn("_batch", F.lit(batch_id)).write.mode("overwrite").parquet(f"{base}/{name}/batch={batch_id}")
    spark.createDataFrame([(batch_id,)], "batch string").coalesce(1).write.mode("overwrite").parquet(f"{base}/_published/batch_id={batch_id}")


def read_table(spark: SparkSession, base: str, name: str) -> DataFrame:
    """The rows of a table's published batches."""
    published = spark.read.parquet(f"{base}/_published").select(F.col("batch").alias("_b")).distinct()
    rows = spark.read.option("mergeSchema", "true").parquet(f"{base}/{name}")
    return rows.join(published, F.col("_batch") == F.col("_b"), "left_semi").drop("batch", "_batch")


def read_latest(spark: SparkSession, base: str, name: str, before: str | None = None) -> DataFrame | None:
    """The rows of a table in its last published batch, or the last before the given one; None where there is none."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{base}/_published")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return None
    batches = spark.read.parquet(f"{base}/_published")
    last = (batches if before is None else batches.where(F.col("batch") < before)).agg(F.max("batch")).first()[0]
    return None if last is None else spark.read.parquet(f"{base}/{name}/batch={last}").drop("_batch")


def store_files(files: DataFrame, base: str) -> None:
    """Raw contents by organisation, year and month."""
    dated = files.withColumn("year", F.date_format("created_at", "yyyy")).withColumn("month", F.date_format("created_at", "MM"))
    dated.write.mode("append").partitionBy("organization", "year", "month").parquet(base)


def store_annotations(rows: DataFrame, path: str) -> None:
    """Annotations as JSON lines, compressed: a word with its box takes some twenty times its letters as plain JSON."""
    rows.write.option("compression", "gzip").json(path)
