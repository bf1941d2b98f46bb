import json

from pyspark.sql import functions as F

from ledgerlark.functions.json_text import prune
from ledgerlark.operators import readmodels


def test_prune(spark):
    doc = {"Vendor": {"name": "Acme", "x": 1}, "items": [{"a": "widget"}, {"a": "other"}], "n": None}
    rows = [(json.dumps(doc),), ("not json",), (None,)]
    df = spark.createDataFrame(rows, "t string")
    got = [r[0] for r in df.select(prune(F.col("t"), "VENDOR")).collect()]
    assert json.loads(got[0]) == {"Vendor": doc["Vendor"]} and got[1:] == [None, None]
    assert json.loads(df.select(prune(F.col("t"), "widg")).first()[0]) == {"items": [{"a": "widget"}]}
    assert df.select(prune(F.col("t"), "zzz")).first()[0] is None


def test_detail_texts(spark):
    row = spark.sql("select cast(18.5 as decimal(14,4)) p, cast(1.2345 as decimal(14,4)) q, cast(6 as decimal(6,4)) r, cast(null as decimal(6,4)) n")
    got = row.select(readmodels.unit_price_text(F.col("p")), readmodels.unit_price_text(F.col("q")), readmodels.rate_text(F.col("r")), readmodels.rate_text(F.col("n"))).first()
    assert tuple(got) == ("18.50", "1.2345", "6%", "—")
