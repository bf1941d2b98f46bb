"""Time spent in stages, from separate start and end events: batch or stream, with alerts by sliding window.

On streams both sides carry watermarks, so a start waits for its end as long as ``within`` and the delays allow, and no
longer; it then comes out without an end, and its state is gone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WITHIN, SLOW_MS, MOST_TOKENS = "1 hour", 20_000, 8_000
KEY = ("document_id", "stage", "attempt")


def matched(starts: DataFrame, ends: DataFrame, within: str = WITHIN, delay: str | None = None) -> DataFrame:
    """The columns of ``starts`` (document_id, stage, attempt, started_at) with ended_at and ms, null where no end came in time.

    ``ends(document_id, stage, attempt, ended_at)``: an end counts from its start up to ``within`` after it, inclusive.
    Several ends of a start give several rows; rows with a null in the key or the time of a start have no end. ``delay``
    is for streams: how late rows of either side may come.
    """
    e = ends.select(*[F.col(c).alias(f"_{c}") for c in KEY], "ended_at")
    if delay:
        starts, e = starts.withWatermark("started_at", delay), e.withWatermark("ended_at", delay)
    same = [F.col(c) == F.col(f"_{c}") for c in KEY]
    in_time = (F.col("ended_at") >= F.col("started_at")) & (F.col("ended_at") <= F.col("started_at") + F.expr(f"INTERVAL {within}"))
    rows = starts.join(e, [*same, in_time], "left").drop(*[f"_{c}" for c in KEY])
    return rows.withColumn("ms", F.unix_millis("ended_at") - F.unix_millis("started_at"))


def slow_stages(times: DataFrame, width: str = "1 hour", slide: str = "30 minutes", limit_ms: int = SLOW_MS) -> DataFrame:
    """For each sliding window of starts and each stage: n, open (starts without an end), avg_ms, and alert.

    The alert is on where the mean of those that ended exceeds ``limit_ms``. Sums of whole milliseconds combine before
    the shuffle, so a stage with most of the rows costs a row a task and window.
    """
    grouped = times.groupBy(F.window("started_at", width, slide), "stage").agg(F.count("*").alias("n"), F.count_if(F.col("ms").isNull()).alias("open"), F.sum("ms").alias("_sum"), F.count("ms").alias("_n"))
    mean = F.col("_sum") / F.nullif("_n", F.lit(0))
    return grouped.select(F.col("window.start").alias("start"), "stage", "n", "open", mean.alias("avg_ms"), F.coalesce(mean > limit_ms, F.lit(False)).alias("alert"))


def over_budget(calls: DataFrame, budget: int = MOST_TOKENS) -> DataFrame:
    """The calls of ``calls(…, total_tokens)`` that used more tokens than a document may."""
    return calls.where(F.col("total_tokens") > budget)


def completion_times(uploads: DataFrame, completions: DataFrame, within: str = "1 day", delay: str | None = None) -> DataFrame:
    """document_id, uploaded_at, completed_at, ms from upload to completion; null where that took longer than ``within``."""
    stage = [F.lit("UPLOAD").alias("stage"), F.lit(1).alias("attempt")]
    rows = matched(uploads.select("document_id", *stage, F.col("uploaded_at").alias("started_at")), completions.select("document_id", *stage, F.col("completed_at").alias("ended_at")), within, delay)
    return rows.select("document_id", F.col("started_at").alias("uploaded_at"), F.col("ended_at").alias("completed_at"), "ms")
