"""What was asked and what ran: a table of questions with their SQL and outcome, and a listener over all queries."""

from __future__ import annotations

import threading
import time
from datetime import UTC, datetime

from pyspark.java_gateway import ensure_callback_server_started
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .guard import Refused, collect_within, guarded

ASKED = "asked_at timestamp, question string, sql string, outcome string, detail string, n_rows int, ms bigint"
RAN = "ended_at timestamp, action string, outcome string, detail string, plan string, ms bigint"
_TEXT = 4000  # characters of a plan or an error that are kept


def ask(spark: SparkSession, question: str, sql: str, allowed: set[str], path: str, seconds: float = 5, rows: int = 1000) -> list:
    """The rows of a guarded query; what came of it is appended to the table of questions at ``path``, refusals too.

    outcome: ANSWERED, REFUSED, TIMEOUT or FAILED, with the reason in detail.
    """
    began, at, found, outcome, detail = time.monotonic(), datetime.now(UTC), [], "ANSWERED", None
    try:
        found = collect_within(guarded(spark, sql, allowed), seconds, rows)
        return found
    except Exception as e:
        outcome = "REFUSED" if isinstance(e, Refused) else "TIMEOUT" if isinstance(e, TimeoutError) else "FAILED"
        detail = str(e)[:_TEXT]
        raise
    finally:
        row = (at, question, sql, outcome, detail, len(found), int((time.monotonic() - began) * 1000))
        spark.createDataFrame([row], ASKED).coalesce(1).write.mode("append").parquet(path)


def questions(spark: SparkSession, path: str) -> DataFrame:
    """Each question's SQL as often as it was asked, with its outcomes and its mean time."""
    rows = spark.read.schema(ASKED).parquet(path)
    return rows.groupBy("question", "sql").agg(F.count("*").alias("asked"), F.count_if(F.col("outcome") == "ANSWERED").alias("answered"), F.count_if(F.col("outcome") == "TIMEOUT").alias("timeouts"), F.avg("ms").alias("avg_ms"))


class QueryHistory:
    """Listens to the queries of a session; ``flush`` appends what ended since to a table. Use it as a context.

    Its own writes are not recorded. Rows wait in the driver until they are flushed, at most ``keep`` of them, then the
    oldest go and ``lost`` counts them.
    """

    class Java:
        implements = ("org.apache.spark.sql.util.QueryExecutionListener",)

    def __init__(self, spark: SparkSession, path: str, keep: int = 10_000):
        self.spark, self.path, self.keep = spark, path, keep
        self.rows: list[tuple] = []
        self.lost, self._lock = 0, threading.Lock()

    def __enter__(self) -> QueryHistory:
        ensure_callback_server_started(self.spark.sparkContext._gateway)
        self.spark._jsparkSession.listenerManager().register(self)
        return self

    def __exit__(self, *_) -> None:
        self.flush()
        self.spark._jsparkSession.listenerManager().unregister(self)

    def onSuccess(self, action, execution, nanos) -> None:  # noqa: N802
        self._add(action, execution, "OK", None, nanos // 1_000_000)

    def onFailure(self, action, execution, error) -> None:  # noqa: N802
        self._add(action, execution, "FAILED", str(error.getMessage())[:_TEXT], None)

    def _add(self, action, execution, outcome: str, detail: str | None, ms: int | None) -> None:
        plan = execution.logical().toString()
        if self.path in plan:
            return
        with self._lock:
            self.rows.append((datetime.now(UTC), action, outcome, detail, plan[:_TEXT], ms))
            if len(self.rows) > self.keep:
                self.rows.pop(0)
                self.lost += 1

    def flush(self) -> int:
        """Writes the rows that have come; their number."""
        self.spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        with self._lock:
            rows, self.rows = self.rows, []
        if rows:
            self.spark.createDataFrame(rows, RAN).coalesce(1).write.mode("append").parquet(self.path)
        return len(rows)
