"""Retries of failed syncs as a stream: keyed state with timers, at most a number of attempts on a fixed schedule.

Retries are not made when a sync fails but on the next quarter of an hour after it, as a scheduler would; what comes out
says which document to sync again, as which attempt, and which ones are given up.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

EVERY_MINUTES, MOST = 15, 5
_OUT = "document_id string, attempt int, ms long, action string"
_COLUMNS = ["document_id", "attempt", "ms", "action"]
_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def next_slot(time: Column, minutes: int = EVERY_MINUTES) -> Column:
    """The first full ``minutes`` of the clock after ``time``."""
    step = minutes * 60
    return F.timestamp_seconds((F.floor(F.unix_seconds(time) / step) + 1) * step)


def retry_plan(sync_log: DataFrame, most: int = MOST, minutes: int = EVERY_MINUTES) -> DataFrame:
    """document_id, attempt, at, action for every row of ``sync_log(document_id, status, at)`` that failed: the batch twin.

    A failure leads to a RETRY at the next slot, as the attempt after it, or to GIVE_UP at once where it was the last one
    allowed. A success, or giving up, starts the count anew and takes back retries that are not due yet; failures of a
    document that fall into one slot make one retry. Rows of a document count in the order of their times; of equal times
    FAILED comes before OK. Times that are null count for nothing. The rows of a document are one window.
    """
    order = W.partitionBy("document_id").orderBy("at", "status")
    rows = sync_log.where("document_id is not null and at is not null and status in ('FAILED', 'OK')")
    run = rows.withColumn("_run", F.count_if(F.col("status") == "OK").over(order.rowsBetween(W.unboundedPreceding, W.currentRow)))
    number = (F.row_number().over(W.partitionBy("document_id", "_run", "status").orderBy("at")) - 1) % most + 1
    last = (F.col("status") == "FAILED") & (F.col("_n") == most)
    reset = F.min(F.when(last | (F.col("status") == "OK"), F.col("at"))).over(order.rowsBetween(1, W.unboundedFollowing))
    failed = run.withColumn("_n", number).withColumn("_reset", reset).where("status = 'FAILED'").withColumn("_slot", next_slot(F.col("at"), minutes))
    given_up = failed.where(F.col("_n") == most).select("document_id", F.col("_n").cast("int").alias("attempt"), "at", F.lit("GIVE_UP").alias("action"))
    due = failed.where((F.col("_n") < most) & (F.col("_reset").isNull() | (F.col("_reset") >= F.col("_slot"))))
    retried = due.groupBy("document_id", "_slot").agg(F.max_by(F.col("_n") + 1, F.struct("at", "_n")).cast("int").alias("attempt"))
    return given_up.unionByName(retried.select("document_id", "attempt", F.col("_slot").alias("at"), F.lit("RETRY").alias("action")))


class _Retries(StatefulProcessor):
    """For each document the failures since its last success; a timer for each retry that is due."""

    def __init__(self, most: int, minutes: int):
        self.most, self.step = most, minutes * 60_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.failures = handle.getValueState("failures", "n int")
        self.due = handle.getMapState("due", "at long", "attempt int")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N803
        batch = pd.concat(list(rows)).sort_values(["ms", "status"])
        n = self.failures.get()[0] if self.failures.exists() else 0
        out = []
        for ms, status in zip(batch["ms"].tolist(), batch["status"], strict=True):
            n = n + 1 if status == "FAILED" else 0
            if n in (0, self.most):
                if n:
                    out.append((key[0], n, ms, "GIVE_UP"))
                n = 0
                for due in [d[0] for d in self.due.keys()]:
                    if due > ms:
                        self.handle.deleteTimer(due)
                        self.due.removeKey((due,))
            else:
                due = (ms // self.step + 1) * self.step
                self.handle.registerTimer(due)
                self.due.updateValue((due,), (n + 1,))
        if n:
            self.failures.update((n,))
        else:
            self.failures.clear()
        yield pd.DataFrame(out, columns=_COLUMNS)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N803
        due = expiredTimerInfo.getExpiryTimeInMs()
        if self.due.containsKey((due,)):
            attempt = self.due.getValue((due,))[0]
            self.due.removeKey((due,))
            yield pd.DataFrame([(key[0], attempt, due, "RETRY")], columns=_COLUMNS)


def retry_stream(sync_log: DataFrame, delay: str = "10 minutes", most: int = MOST, minutes: int = EVERY_MINUTES) -> DataFrame:
    """The retries of a stream of ``sync_log(document_id, status, at)`` with columns document_id, attempt, at, action.

    The rules are those of ``retry_plan``. Timers run on event time: a retry comes out when the watermark, ``delay`` behind
    the newest row, has passed its slot; rows later than that are dropped. The state of a document is the number of its
    failures and its open slots, gone after a success or the last attempt; it survives restarts with the checkpoint. Sets
    the session's state store to RocksDB, which timers by key need.
    """
    sync_log.sparkSession.conf.set(_STORE, _ROCKS)
    rows = sync_log.select(F.col("document_id").cast("string").alias("document_id"), "status", "at", F.unix_millis("at").alias("ms"))
    keyed = rows.where("document_id is not null and status in ('FAILED', 'OK')").withWatermark("at", delay).groupBy("document_id")
    out = keyed.transformWithStateInPandas(statefulProcessor=_Retries(most, minutes), outputStructType=_OUT, outputMode="append", timeMode="EventTime")
    return out.select("document_id", "attempt", F.timestamp_millis("ms").alias("at"), "action")
