"""Guard for generated SQL: one SELECT over permitted views, with a time limit."""

from __future__ import annotations

import re
import threading
import uuid

from pyspark.sql import DataFrame, SparkSession


class Refused(ValueError):
    """The statement is not a SELECT over permitted tables."""


def relations(spark: SparkSession, sql: str) -> set[str]:
    """Tables that a statement names, as Spark's own parser sees them; names that WITH defines are not tables."""
    plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql).toString()
    named = {m.split(",")[0].strip().lower() for m in re.findall(r"'UnresolvedRelation \[([^\]]+)\]", plan)}
    defined = {m.lower() for m in re.findall(r"CTE \[([^\]]+)\]", plan) for m in m.split(", ")}
    return named - defined


def guarded(spark: SparkSession, sql: str, allowed: set[str]) -> DataFrame:
    """The query's frame; refuses anything but a SELECT (or WITH … SELECT) over ``allowed``."""
    if ";" in sql.strip().rstrip(";") or not re.match(r"(?is)^\s*(select|with)\b", sql):
        raise Refused("only one SELECT statement is permitted")
    plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql).toString()
    if re.search(r"InsertInto|CreateTable|DropTable|DeleteFrom|UpdateTable|MergeInto|TableValuedFunction", plan):
        raise Refused("only SELECT is permitted")
    extra = relations(spark, sql) - {a.lower() for a in allowed}
    if extra:
        raise Refused(f"tables not permitted: {sorted(extra)}")
    return spark.sql(sql)


def collect_within(df: DataFrame, seconds: float, rows: int = 1000) -> list:
    """The first rows of a guarded query, or TimeoutError after so many seconds; its jobs are cancelled."""
    sc, tag, late = df.sparkSession.sparkContext, f"guard-{uuid.uuid4().hex}", threading.Event()

    def stop() -> None:
        late.set()
        sc.cancelJobsWithTag(tag)

    timer = threading.Timer(seconds, stop)
    sc.addJobTag(tag)
    timer.start()
    try:
        return df.limit(rows).collect()
    except Exception as e:
        if late.is_set():
            raise TimeoutError(f"query took more than {seconds} s") from e
        raise
    finally:
        timer.cancel()
        sc.removeJobTag(tag)
