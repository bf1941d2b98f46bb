"""Every query with SQL gives what DuckDB gives, on the smallest tables."""

from __future__ import annotations

import datetime
import decimal
import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    if isinstance(v, decimal.Decimal):
        return str(v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF_DIR}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_matches_sql(spark, duck, name):
    df = entry.queries()[name](spark, SF_DIR)
    result = duck.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in result.description]
    assert sorted(columns) == sorted(df.columns)
    order = sorted(columns)
    got = sorted(repr([plain(r[c]) for c in order]) for r in df.collect())
    expected = sorted(repr([plain(r[columns.index(c)]) for c in order]) for r in result.fetchall())
    assert got == expected


def test_entry(spark):
    assert entry.entry(spark).count() == 1500


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_display_formats_keep_every_event(spark, tmp_path):
    spark.createDataFrame([(999, 5.0), (1000000, 5.0), (2500000, 61000.0)], "event_id long, value double").write.parquet(f"{tmp_path}/events.parquet")
    got = {r["event_id"]: (r["duration"], r["tokens"]) for r in entry.queries()["display_formats"](spark, str(tmp_path)).collect()}
    assert got == {999: ("5 ms", "999"), 1000000: ("5 ms", "1.00M"), 2500000: ("1.0 min", "2.50M")}
