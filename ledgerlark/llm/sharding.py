"""Sharding along a Hilbert curve through document metadata.

Language, source and size are quantised to ``BITS`` bits each; a document's cell has a position on the Hilbert curve,
and documents in curve order are cut into runs of equal counts. A shard thus covers few languages, sources and sizes,
and the ranges in its Parquet footers let readers skip it. Law: ``rows`` (counts of shards differ by one at most).

A missing text has size 1; missing metadata form their own cell. Rows with equal ids and equal texts are separate rows
and each gets a slot. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, quoted

BITS = 4


def hilbert_index(cell: tuple[int, ...], bits: int) -> int:
    """Position on the Hilbert curve of a cell of a grid with ``bits`` bits a dimension (Skilling's transposition)."""
    x, n = list(cell), len(cell)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            if x[i] & q:
                x[0] ^= p
            else:
                t = (x[0] ^ x[i]) & p
                x[0] ^= t
                x[i] ^= t
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t, q = 0, 1 << (bits - 1)
    while q > 1:
        if x[n - 1] & q:
            t ^= q - 1
        q >>= 1
    out = 0
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            out = out << 1 | ((x[i] ^ t) >> b & 1)
    return out


def byte_size(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1


def curve_position(df: DataFrame, lang: Column, source: Column, size: Column, out: str) -> DataFrame:
    """Adds the curve position of each row; the table of cells has 2^(3 BITS) rows whatever the input, so it is broadcast."""
    side, spark = 1 << BITS, df.sparkSession
    code = lambda c: F.coalesce(F.pmod(F.crc32(c.cast("binary")), F.lit(side - 1)) + 1, F.lit(0))
    level = F.least(F.lit(side - 1), F.floor(F.log2(size.cast("double"))))
    rows = [(i, hilbert_index((i >> 2 * BITS, i >> BITS & side - 1, i & side - 1), BITS)) for i in range(side**3)]
    cells = spark.createDataFrame(rows, "_cell int, _curve int")
    keyed = df.withColumn("_cell", (code(lang) * side * side + code(source) * side + level).cast("int"))
    return keyed.join(F.broadcast(cells), "_cell").drop("_cell").withColumnRenamed("_curve", out)


def assign_shards(df: DataFrame, shards: int = 8, columns: list[str] | None = None) -> DataFrame:
    """row, size, text_crc32, shard, slot, curve for the rows of ``df(doc_id, text, lang, source, …)`` in Hilbert order.

    ``row`` is a struct of ``columns`` (all by default), so columns of any name can pass through; lang and source may be
    missing. One range shuffle sorts the rows; the rows of each range are counted, and a row's place is its place in its
    range after the rows of the ranges before. Only those counts, one for each range, reach the driver.
    """
    scratch = Scratch(df.sparkSession)
    text = F.col("text").cast("string")
    meta = lambda c: F.col(c).cast("string").alias(c) if c in df.columns else F.lit(None).cast("string").alias(c)
    crc = F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32")
    rows = df.select(F.struct(*[F.col(quoted(c)) for c in columns or df.columns]).alias("row"), "doc_id", meta("lang"), meta("source"), byte_size(text).alias("size"), crc)
    placed = curve_position(rows, F.col("lang"), F.col("source"), F.col("size"), "curve").drop("lang", "source").withColumn("_tie", F.monotonically_increasing_id())
    keys = ["curve", "doc_id", "text_crc32", "_tie"]
    ranged = placed.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id())
    rows = scratch.save(ranged.drop("doc_id", "_tie"), "ranged")
    width = 1 << 33
    counts = sorted((r["p"], r["n"]) for r in rows.groupBy(F.expr(f"_at div {width}").alias("p")).agg(F.count("*").alias("n")).collect())
    before, total = [], 0
    for p, n in counts:
        before.append((p, total))
        total += n
    offsets = df.sparkSession.createDataFrame(before, "_p long, _before long")
    rank = rows.withColumn("_p", F.expr(f"_at div {width}")).join(F.broadcast(offsets), "_p").withColumn("_rank", F.col("_before") + F.col("_at") % width)
    shard = F.expr(f"cast(_rank * {shards} div {max(total, 1)} as int)")
    first = F.expr(f"(shard * {max(total, 1)}L + {shards - 1}) div {shards}")
    return rank.withColumn("shard", shard).withColumn("slot", F.col("_rank") - first).select("row", "size", "text_crc32", "shard", "slot", "curve")


def sharded(df: DataFrame, shards: int = 8) -> DataFrame:
    """The columns of ``df`` with shard, slot and curve; columns of these names are replaced."""
    out = assign_shards(df, shards, [c for c in df.columns if c not in ("shard", "slot", "curve")])
    return out.select("row.*", "shard", "slot", "curve")


def write_shards(df: DataFrame, path: str, shards: int = 8, rows_per_file: int = 1_000_000) -> None:
    """Writes the rows as Parquet, a folder for each shard, in curve order within its files."""
    placed = sharded(df, shards)
    files = placed.repartition("shard", F.floor(F.col("slot") / rows_per_file)).sortWithinPartitions("shard", "slot")
    files.write.partitionBy("shard").parquet(path)
