"""The pipeline on a small corpus with planted cases, and the awkward rows of every stage."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

import corpus_pipeline
from ledgerlark.llm import queries


def write(spark, path, docs, labels, bench):
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long, size string, curve string").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")


def planted():
    rng = random.Random(6)
    word = lambda: "".join(rng.choices("abcdefghijkl", k=rng.randint(2, 7)))
    text = lambda n: " ".join(word() for _ in range(n))
    docs, labels = [], []
    for i in range(400):
        t = text(rng.randint(30, 90)).split()
        toxic = i % 5 == 0
        for _ in range(4 if toxic else 0):
            t[rng.randrange(len(t))] = rng.choice(["vile", "rotten", "awful"])
        docs.append((i, " ".join(t)))
        labels.append((i, 1, int(toxic)))
    item = text(30)
    docs += [(1000, docs[1][1]), (1001, docs[2][1] + " more"), (1002, f"{text(20)} {item} {text(20)}"), (1003, None), (1004, ""), (1004, "")]
    full = [(i, t, "en", f"s{i % 3}", len(t or ""), "x", "y") for i, t in docs]
    return full, labels, [(1, item), (2, None)]


def test_stages(spark, tmp_path):
    docs, labels, bench = planted()
    write(spark, str(tmp_path), docs, labels, bench)
    frames = [spark.read.parquet(f"{tmp_path}/documents.parquet")]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, frames[-1], str(tmp_path))
        out.write.parquet(f"{tmp_path}/{name}")
        frames.append(spark.read.parquet(f"{tmp_path}/{name}"))
        if name != "sharding":
            assert frames[-1].columns == frames[0].columns
    ids = [{r["doc_id"] for r in f.select("doc_id").collect()} for f in frames]
    toxic = {i for i, _, t in labels if t}
    assert len(ids[1] & toxic) <= 0.05 * len(toxic) and len(ids[0] - ids[1] - toxic) <= 0.01 * len(docs)
    assert {1000, 1001} <= ids[1] - ids[2] and {1, 2} <= ids[2]
    assert ids[2] - ids[3] == {1002}
    assert ids[4] <= ids[3] and frames[5].count() == frames[4].count()
    assert {"shard", "slot", "curve"} <= set(frames[5].columns)


def test_similar_rows_are_told_apart_by_id_and_text(spark):
    rng = random.Random(3)
    text = lambda: " ".join(f"w{rng.randrange(10**6)}" for _ in range(40))
    a, b, c, d = (text() for _ in range(4))
    rows = [(1, a), (1, a), (1, a), (5, a + " more"), (5, b), (7, b + " more"), (None, c), (None, c), (None, d), (2, d), (9, None), (9, None), (9, ""), (8, "")]
    docs = spark.createDataFrame([(t, i, "x") for i, t in rows], "text string, doc_id long, lang string")
    out = corpus_pipeline.keep_one_of_similar(spark, docs, "")
    assert out.columns == docs.columns
    got = sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=str)
    assert got == sorted([(1, a), (5, b), (None, c), (2, d), (9, None), (9, ""), (8, "")], key=str)


def test_columns_of_any_name_and_type(spark, tmp_path):
    """Names with dots and quotes, names that stages use inside, and columns that have no order."""
    docs, labels, bench = planted()
    write(spark, str(tmp_path), docs, labels, bench)
    names = ["a.b", "q`t", "toxicity", "toxicity_", "__row", "__id", "row", "copies", "comp", "_0", "score"]
    frame = spark.read.parquet(f"{tmp_path}/documents.parquet").withColumn("a map", F.create_map(F.lit("k"), F.col("doc_id")))
    frame = frame.withColumns({n: F.concat(F.lit(n), F.coalesce(F.col("doc_id"), F.lit(0)).cast("string")) for n in names}).withColumn("list", F.array(F.lit(None).cast("binary")))
    frame.write.parquet(f"{tmp_path}/wide/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{tmp_path}/{name}.parquet").write.parquet(f"{tmp_path}/wide/{name}.parquet")
    out = corpus_pipeline.run(spark, f"{tmp_path}/wide")
    assert out.columns == [*(c for c in frame.columns if c != "curve"), "shard", "slot", "curve"]
    rows = out.collect()
    assert len({r["doc_id"] for r in rows}) > 100
    assert all(r[n] == f"{n}{r['doc_id'] or 0}" for r in rows for n in names) and all(r["a map"] == {"k": r["doc_id"]} for r in rows)


def test_empty_corpus(spark, tmp_path):
    write(spark, str(tmp_path), [], [], [])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_queries_are_registered():
    assert [k.split("_")[0] for k in queries.QUERIES] == [*(f"op{n}" for n in range(1, 14)), "pipeline"]
