"""The corpus pipeline: toxicity filter, near-duplicate removal, decontamination, source mixing, sharding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes every stage's result as Parquet in the
shared scratch folder and reads it again as the next stage's ``docs``. All stages but the last return the columns of
``docs``. The similarity stage knows rows by doc_id, which may be null, and text: of repeated rows one stays. Other columns
may have any name and type.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlark.llm.common import Scratch, quoted, table
from ledgerlark.llm.decontamination import without_matches
from ledgerlark.llm.features import fold
from ledgerlark.llm.jaccard import similar_rows
from ledgerlark.llm.mixing import mix_expand
from ledgerlark.llm.sharding import sharded
from ledgerlark.llm.toxicity import THRESHOLD, toxicity_scores


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents whose toxicity score reaches the threshold, in the pass that scores them."""
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    known = table(spark, sf_dir, "labels").join(ids, "doc_id", "left_semi")
    name = "toxicity"
    while name in docs.columns:
        name += "_"
    scored = toxicity_scores(docs, known, fold(F.col("doc_id"), 3) == 1, docs.columns, name)
    return scored.where(F.col(name) < THRESHOLD).drop(name)


def keep_one_of_similar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of similar rows the one with the smallest doc_id stays, null last; joined the same way at every size.

    Rows are told apart by doc_id and text, so another text with the id of a similar row stays. Rows equal in both count
    as one: of these the one with the smallest JSON of all columns stays.
    """
    groups = similar_rows(docs).select(F.col("doc_id").isNull().alias("__none"), F.coalesce("doc_id", F.lit(0)).alias("__id"), F.col("print").alias("__print"), "comp")
    own = [F.col(c) for c in ("__none", "__id", "__print")]
    linked = groups.where("comp is not null").groupBy("comp").agg(F.min(F.struct(*own)).alias("row")).select("row.*")
    kept = linked.unionAll(groups.where("comp is null").select(*own)).distinct()
    long = F.col("doc_id").cast("long")
    keyed = docs.select(F.struct(*[F.col(quoted(c)) for c in docs.columns]).alias("__row"), long.isNull().alias("__none"), F.coalesce(long, F.lit(0)).alias("__id"), F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("__print"))
    rows = keyed.join(kept.hint("shuffle_merge"), ["__none", "__id", "__print"], "left_semi")
    one = rows.groupBy("__none", "__id", "__print", F.col("__row.text").isNull().alias("__empty")).agg(F.min_by("__row", F.to_json("__row")).alias("__row"))
    return one.select("__row.*")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents with a stretch that matches a benchmark item."""
    return without_matches(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats and thins documents so that sources reach their target weights."""
    return mix_expand(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Assigns shards and slots in Hilbert order; the columns of ``docs`` with shard, slot and curve."""
    return sharded(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("similar", keep_one_of_similar),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("sharding", shard),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch, docs = Scratch(spark), table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = scratch.save(stage(spark, docs, sf_dir), f"{k}_{name}")
    return docs
