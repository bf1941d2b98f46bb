"""Scratch tables in the shared folder, connected components, and small column helpers."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def positional(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """The frame with columns named by place, and the new names: names with dots or quotes don't resolve in Arrow stages."""
    names = {c: f"_{k}" for k, c in enumerate(df.columns)}
    return df.toDF(*names.values()), names


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


class Scratch:
    """Parquet tables in the folder that ``spark.checkpoint.dir`` names, so that any executor can read them again.

    ``save`` runs the plan once, cuts its lineage and frees its shuffle files; ``drop`` removes a table that no later
    plan reads, and what is left goes when the driver's file system is closed. Where the setting is unset, the warehouse
    stands in for it, and in local mode a temporary folder.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        root = spark.conf.get("spark.checkpoint.dir", None)
        if not root and spark.conf.get("spark.master", "").split("[")[0] == "local":
            root = tempfile.mkdtemp(prefix="ledgerlark-")
        elif not root:
            root = spark.conf.get("spark.sql.warehouse.dir")
        self.root = f"{root.rstrip('/')}/llm-{uuid.uuid4().hex}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        conf, path = self.spark.conf, f"{self.root}/{name}"
        before = conf.get(_CLEANUP, None)
        conf.set(_CLEANUP, "true")
        try:
            df.write.mode("overwrite").parquet(path)
        finally:
            conf.unset(_CLEANUP) if before is None else conf.set(_CLEANUP, before)
        whole = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        whole.getFileSystem(self.spark._jsc.hadoopConfiguration()).deleteOnExit(whole)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        jvm, hconf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            path.getFileSystem(hconf).delete(path, True)


def connected_components(edges: DataFrame, scratch: Scratch, tag: str = "cc") -> DataFrame:
    """(node, comp) for every node of ``edges(a, b)``; comp is the smallest node reachable.

    Alternates large-star and small-star steps until the edge set stops changing. Every step groups with map-side
    combine and joins on a key, so a hub with many neighbours costs rows in proportion to them, never their square.
    """
    e = scratch.save(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), f"{tag}0")
    seen, step = _stamp(e), 0
    while seen[0]:
        both = e.unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        step += 1
        e = scratch.save(small.unionAll(least.select("u", F.col("m").alias("v"))).distinct(), f"{tag}{step}")
        scratch.drop(f"{tag}{step - 1}")
        now = _stamp(e)
        if now == seen:
            break
        seen = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("comp")).unionAll(e.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct())


def _stamp(e: DataFrame) -> tuple:
    row = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)
