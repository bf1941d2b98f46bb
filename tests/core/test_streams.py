"""Streams with state: retries over restarts, stage times by a join of starts and ends."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from ledgerlark.streaming import retries, stage_times


@pytest.fixture
def one_partition(spark):
    """Small streams keep their state in one partition."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


SYNC = "document_id string, status string, at timestamp"


def sync_rows(spark, rows):
    return spark.createDataFrame([(d, s, f"2026-01-01 {t}") for d, s, t in rows], "document_id string, status string, at string").withColumn("at", F.col("at").cast("timestamp"))


FIRST = [("a", "FAILED", "10:01:00"), ("b", "FAILED", "10:02:00"), ("b", "OK", "10:05:00"), ("c", "FAILED", "10:03:00"), ("c", "FAILED", "10:04:00"), ("d", "OK", "10:00:00"), ("z", "OK", "10:26:00")]
SECOND = [("a", "FAILED", "10:31:00"), ("a", "FAILED", "10:46:00"), ("e", "FAILED", "10:59:59"), ("z", "OK", "11:16:00")]
THIRD = [("a", "FAILED", "11:31:00"), ("a", "FAILED", "11:32:00"), ("e", "OK", "11:07:00"), ("late", "FAILED", "09:00:00"), ("z", "OK", "13:00:00")]
EXPECTED = {("a", 2, "10:15", "RETRY"), ("c", 3, "10:15", "RETRY"), ("a", 3, "10:45", "RETRY"), ("a", 4, "11:00", "RETRY"), ("e", 2, "11:00", "RETRY"), ("a", 5, "11:32", "GIVE_UP")}


def shown(df):
    return {(r["document_id"], r["attempt"], r["at"], r["action"]) for r in df.withColumn("at", F.date_format("at", "HH:mm")).collect()}


def test_retry_plan(spark):
    rows = sync_rows(spark, [r for r in FIRST + SECOND + THIRD if r[0] != "late"] + [(None, "FAILED", "10:00:00"), ("n", None, "10:00:00")])
    found = retries.retry_plan(rows)
    assert found.count() == len(EXPECTED) and shown(found) == EXPECTED


def test_retry_stream_over_restarts(spark, tmp_path, one_partition):
    """Each run is a new query on the old checkpoint; timers of one run fire in a later one, late rows are dropped."""
    for k, rows in enumerate((FIRST, SECOND, THIRD, [("z", "OK", "14:00:00")])):
        sync_rows(spark, rows).coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
        stream = spark.readStream.schema(SYNC).parquet(str(tmp_path / "log"))
        query = retries.retry_stream(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        query.awaitTermination(180)
        assert query.exception() is None
        if k == 1:
            assert ("a", 2, "10:15", "RETRY") in shown(spark.read.parquet(str(tmp_path / "out")))
    found = spark.read.parquet(str(tmp_path / "out"))
    assert found.count() == len(EXPECTED) and shown(found) == EXPECTED


STARTS = [("d1", "AI", 1, "10:00:00"), ("d2", "AI", 1, "10:10:00"), ("d3", "AI", 1, "10:20:00"), ("d4", "OCR", 1, "10:40:00"), ("d4", "OCR", 2, "10:45:00"), ("d9", "AI", 1, "14:00:00")]
ENDS = [("d1", "AI", 1, "10:00:10"), ("d2", "AI", 1, "10:11:40"), ("d3", "AI", 1, "11:20:01"), ("d4", "OCR", 2, "10:45:01"), ("d4", "OCR", 1, "10:39:00"), ("d9", "AI", 1, "14:00:01")]


def events(spark, rows, name):
    df = spark.createDataFrame([(*r[:3], f"2026-01-01 {r[3]}") for r in rows], f"document_id string, stage string, attempt int, {name} string")
    return df.withColumn(name, F.col(name).cast("timestamp"))


def times(df):
    return {(r["document_id"], r["attempt"], r["ms"]) for r in df.collect()}


MATCHED = {("d1", 1, 10_000), ("d2", 1, 100_000), ("d3", 1, None), ("d4", 1, None), ("d4", 2, 1000), ("d9", 1, 1000)}


def test_stage_times_of_a_batch(spark):
    found = stage_times.matched(events(spark, STARTS, "started_at"), events(spark, ENDS, "ended_at"))
    assert times(found) == MATCHED
    slow = {(r["stage"], r["start"], r["n"], r["open"], r["avg_ms"], r["alert"]) for r in stage_times.slow_stages(found).withColumn("start", F.date_format("start", "HH:mm")).collect()}
    assert ("AI", "10:00", 3, 1, 55_000.0, True) in slow and ("AI", "09:30", 3, 1, 55_000.0, True) in slow
    assert ("OCR", "10:30", 2, 1, 1000.0, False) in slow and ("OCR", "10:00", 2, 1, 1000.0, False) in slow
    assert ("AI", "14:00", 1, 0, 1000.0, False) in slow
    calls = spark.createDataFrame([("a", 8000), ("b", 8001), ("c", None)], "document_id string, total_tokens int")
    assert [r["document_id"] for r in stage_times.over_budget(calls).collect()] == ["b"]


def test_stage_times_of_streams(spark, tmp_path, one_partition):
    """Starts without an end come out once the watermarks have passed; rows later than the delay are dropped on both sides."""
    last = [("z", "AI", 1, "18:00:00")]
    late = [("late", "AI", 1, "10:00:00")]
    for k, (starts, ends) in enumerate(((STARTS, ENDS[:3]), (late, ENDS[3:] + [("d3", "AI", 1, "10:20:30")]), (last, last), (last, last))):
        shown_ = [("d4", "OCR", 2, "10:45:01")] if k == 0 else []
        events(spark, starts, "started_at").coalesce(1).write.mode("append").parquet(str(tmp_path / "starts"))
        events(spark, ends + shown_, "ended_at").coalesce(1).write.mode("append").parquet(str(tmp_path / "ends"))
        s = spark.readStream.schema("document_id string, stage string, attempt int, started_at timestamp").parquet(str(tmp_path / "starts"))
        e = spark.readStream.schema("document_id string, stage string, attempt int, ended_at timestamp").parquet(str(tmp_path / "ends"))
        rows = stage_times.matched(s, e, delay="5 minutes")
        for name, df in (("times", rows), ("slow", stage_times.slow_stages(rows))):
            query = df.writeStream.format("parquet").outputMode("append").option("path", str(tmp_path / name)).option("checkpointLocation", str(tmp_path / f"ck-{name}")).trigger(availableNow=True).start()
            query.awaitTermination(180)
            assert query.exception() is None
    found = spark.read.parquet(str(tmp_path / "times"))
    got = [t for t in times(found) if t[0] not in ("z", "d9", "d4")]
    assert sorted(got, key=str) == [("d1", 1, 10_000), ("d2", 1, 100_000), ("d3", 1, None)]
    assert ("late", 1, None) not in times(found) and ("d4", 2, 1000) in times(found) and ("d4", 1, None) in times(found)
    slow = {(r["stage"], r["start"], r["n"], r["open"]) for r in spark.read.parquet(str(tmp_path / "slow")).withColumn("start", F.date_format("start", "HH:mm")).collect()}
    assert ("AI", "10:00", 3, 1) in slow and ("OCR", "10:00", 2, 1) in slow
