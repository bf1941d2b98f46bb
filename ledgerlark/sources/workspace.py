"""A folder that driver and executors share, for tables that a query builds on its way."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def workspace(spark: SparkSession, name: str) -> str:
    """A new path in the folder of ``spark.checkpoint.dir``, else in the warehouse, or in local mode a temporary folder.

    It goes when the driver's file system is closed.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and spark.conf.get("spark.master", "").split("[")[0] == "local":
        root = tempfile.mkdtemp(prefix="ledgerlark-")
    root = root or spark.conf.get("spark.sql.warehouse.dir")
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    return path.toString()
