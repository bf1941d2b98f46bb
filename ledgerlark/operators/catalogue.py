"""Products for items by cosine: a stored index of inverted lists, compared with the items by blocks and checked exactly.

``build_index`` divides the unit vectors of a catalogue into lists around centres and writes two tables: ``products``
(blocks of vectors in the order of their lists) and ``lists`` (centre, size, and the widest angle between the centre and
a product of the list). ``match_items`` stores the items as blocks too and takes all pairs of an item block and a product
block: both are read from their tables, so a vector is shuffled and written once, whatever it is compared with. In a
pair, each list meets the items within reach in numpy, and the best product of each item stays.

Vectors that are null, empty, zero or not finite, or whose length is not the catalogue's commonest one, match nothing
and are not indexed.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.workspace import workspace

LEAST = 0.92
#: Bounds of what passes through the driver: the sample that centres are trained on, and the centres.
SAMPLE_BYTES, CENTRE_BYTES = 64 << 20, 32 << 20
#: Rows of a stored block of each side, bounded in bytes of vectors as well.
PRODUCT_BLOCK, ITEM_BLOCK, BLOCK_BYTES = 4096, 8192, 4 << 20
#: Bytes of vectors in a stored partition: at most the first, and at least the second while there are fewer than SPREAD.
PART_BYTES, LEAST_BYTES, SPREAD = 32 << 20, 2 << 20, 16


def _unit_rows(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(places of the vectors that have a direction and ``width`` entries, their unit rows)."""
    lists = column.cast(pa.large_list(pa.float64()))
    size = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    keep = np.flatnonzero(size == width)
    flat = lists.take(pa.array(keep)).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
    with np.errstate(all="ignore"):
        scaled = flat / np.abs(flat).max(axis=1, keepdims=True, initial=0)
        unit = scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))
    good = np.isfinite(unit).all(axis=1)
    return keep[good], unit[good]


def _vectors(unit: np.ndarray) -> pa.Array:
    n, width = unit.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * width, pa.int32()), pa.array(np.ascontiguousarray(unit).ravel()))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def train_centres(sample: np.ndarray, lists: int, rounds: int = 10) -> np.ndarray:
    """Unit centres of unit rows by spherical k-means; they start at rows spread evenly over the sample."""
    centres = sample[np.linspace(0, len(sample) - 1, lists).astype(int)]
    for _ in range(rounds):
        near = np.concatenate([(sample[k : k + 4096] @ centres.T).argmax(axis=1) for k in range(0, len(sample), 4096)])
        sums = np.zeros_like(centres)
        np.add.at(sums, near, sample)
        length = np.sqrt((sums * sums).sum(axis=1, keepdims=True))
        centres = np.where(length > 1e-9, sums / np.maximum(length, 1e-9), centres)
    return centres


def _store(rows: DataFrame, key: str, centres: np.ndarray, n: int, most: int, path: str, rank: int = 1) -> None:
    """Writes about ``n`` rows (``key``, v) as blocks of at most ``most`` rows to ``path``: ids, lists, cosines, v.

    Each partition is in the order of the nearest lists and the ids. ``cosines`` are those with the centre that is
    ``rank``-th near; ``v`` has the unit rows as bytes.
    """
    kind, width = rows.schema[key].dataType.simpleString(), centres.shape[1]
    shape = f"ids array<{kind}>, lists array<int>, cosines array<double>, v binary"
    most, size = max(1, min(most, BLOCK_BYTES // (8 * max(1, width)))), 8 * n * width

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, unit = _unit_rows(batch.column("v"), width)
            for lo in range(0, len(keep), 1024):
                own = unit[lo : lo + 1024]
                cosine = own @ centres.T
                near, last = cosine.argmax(axis=1), np.partition(cosine, -rank, axis=1)[:, -rank]
                yield pa.RecordBatch.from_arrays([pa.array(near, pa.int32()), batch.column(key).take(pa.array(keep[lo : lo + 1024])), pa.array(last), _vectors(own)], ["list", "id", "cosine", "v"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cuts = np.linspace(0, len(batch), -(-len(batch) // most) + 1).astype(int).tolist()
            for lo, hi in itertools.pairwise(cuts):
                own = batch.slice(lo, hi - lo)
                columns = [pa.ListArray.from_arrays(pa.array([0, hi - lo], pa.int32()), own.column(c)) for c in ("id", "list", "cosine")]
                yield pa.RecordBatch.from_arrays([*columns, pa.array([_matrix(own.column("v"), width).tobytes()], pa.binary())], ["ids", "lists", "cosines", "v"])

    if len(centres):
        parts = max(1, -(-size // PART_BYTES), min(SPREAD, -(-size // LEAST_BYTES)))
        assigned = rows.select(key, "v").mapInArrow(assign, f"list int, id {kind}, cosine double, v array<double>")
        blocks = assigned.repartitionByRange(parts, "list", "id").sortWithinPartitions("list", "id").mapInArrow(pack, shape)
    else:
        blocks = rows.sparkSession.createDataFrame([], shape)
    # as large in the file as in memory, so that the bytes of a partition that is read bound its memory
    blocks.write.mode("overwrite").option("compression", "none").option("parquet.enable.dictionary", "false").parquet(path)


def build_index(products: DataFrame, path: str, lists: int | None = None) -> None:
    """Writes the index of ``products(product_id, v)`` to ``path``.

    ``lists`` follows from the size by default: the square root of the number of products, as far as the centres stay
    within ``CENTRE_BYTES``. Centres are trained on a sample of at most ``SAMPLE_BYTES``, the products of smallest hash;
    every product is indexed.
    """
    vectors = products.where("size(v) > 0").select("product_id", "v")
    common = vectors.groupBy(F.size("v").alias("width")).count().orderBy(F.desc("count"), F.desc("width")).first()
    width, n = (common["width"], common["count"]) if common else (0, 0)
    most = max(1, CENTRE_BYTES // (8 * max(1, width)))
    lists = max(1, min(n, most, lists or int(np.ceil(n**0.5))))
    rows = vectors.where(F.size("v") == width).orderBy(F.xxhash64("product_id"), "product_id").limit(max(1, SAMPLE_BYTES // (8 * max(1, width))))
    _, sample = _unit_rows(rows.toArrow().column("v").combine_chunks(), width) if n else (None, np.zeros((0, 0)))
    centres = train_centres(sample, min(lists, len(sample))) if len(sample) else sample
    _store(vectors, "product_id", centres, n, PRODUCT_BLOCK, f"{path}/products")
    stored = products.sparkSession.read.parquet(f"{path}/products").select(F.explode(F.arrays_zip("lists", "cosines")).alias("p"))
    sizes = stored.groupBy(F.col("p.lists").alias("list")).agg(F.count("*").alias("n"), F.acos(F.least(F.min("p.cosines"), F.lit(1.0))).alias("angle"))
    shape = T.StructType([T.StructField("list", T.IntegerType()), T.StructField("centre", T.ArrayType(T.DoubleType()))])
    centre = products.sparkSession.createDataFrame([(k, c.tolist()) for k, c in enumerate(centres)], shape)
    sizes.join(centre, "list").coalesce(1).write.mode("overwrite").parquet(f"{path}/lists")


def match_items(items: DataFrame, path: str, least: float = LEAST, probes: int | None = None) -> DataFrame:
    """item_id, product_id, cosine: the product of the index most like each item of ``items(item_id, v)``, where at least ``least``.

    With ``probes`` an item is compared with that many lists, those of the nearest centres; without, with every list
    that can hold a match, as the angle to its centre is at most the widest angle in the list and that of ``least``: no
    match is missed then. A product whose id is the item's own is no match. Of equal cosines (to nine places) the smallest
    id wins. The items' blocks are written once, to a new table in the shared folder.
    """
    spark: SparkSession = items.sparkSession
    lists = spark.read.parquet(f"{path}/lists").orderBy("list").toArrow()  # bounded by CENTRE_BYTES
    ids = lists.column("list").to_numpy()
    known = spark.read.parquet(f"{path}/products").select(F.col("ids").alias("product_ids"), "lists", F.col("v").alias("products"))
    kinds = {"item_id": items.schema["item_id"].dataType.simpleString(), "product_id": known.schema["product_ids"].dataType.elementType.simpleString()}
    out = f"item_id {kinds['item_id']}, product_id {kinds['product_id']}, cosine double"
    if not len(ids):
        return spark.createDataFrame([], out)
    width = len(lists.column("centre")[0])
    centres = _matrix(lists.column("centre").combine_chunks(), width)
    # the least cosine between a centre and an item that can match in its list, a little less as acos is inexact near 1
    reach = np.cos(np.minimum(np.pi, lists.column("angle").to_numpy() + np.arccos(least) + 1e-6))

    def best(row: dict[str, pa.Scalar]) -> pa.RecordBatch:
        products, unit = (np.frombuffer(row[c].as_buffer()).reshape(-1, width) for c in ("products", "items"))
        held = row["lists"].values.to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(held)) + 1).tolist(), len(held)]
        place = np.searchsorted(ids, held[cuts[:-1]])
        near = unit @ centres[place].T
        meets = near >= (reach[place] if probes is None else row["cosines"].values.to_numpy()[:, None] - 1e-12)
        found = [(np.zeros(0, int), np.zeros(0, int), np.zeros(0))]
        for k, (lo, hi) in enumerate(itertools.pairwise(cuts)):
            within, names = np.flatnonzero(meets[:, k]), {}
            for at in range(0, len(within), 1024):
                own = within[at : at + 1024]
                cosine = unit[own] @ products[lo:hi].T
                some = np.flatnonzero(cosine.max(axis=1) >= least - 1e-9)
                if not len(some):
                    continue
                own, cosine = own[some], np.round(cosine[some], 9)
                codes = np.array([names.setdefault(x, len(names)) for x in row["product_ids"].values[lo:hi].to_pylist()])
                same = np.array([names.get(x, -1) for x in row["item_ids"].values.take(pa.array(own)).to_pylist()])
                cosine[codes[None, :] == same[:, None]] = -2.0
                top = cosine.argmax(axis=1)  # of equal ones the first, which has the smallest id
                value = cosine[np.arange(len(top)), top]
                hit = np.flatnonzero(value >= least)
                found.append((own[hit], lo + top[hit], value[hit]))
        item, product, value = (np.concatenate(x) for x in zip(*found, strict=True))
        return pa.RecordBatch.from_arrays([row["item_ids"].values.take(pa.array(item)), row["product_ids"].values.take(pa.array(product)), pa.array(value)], ["item_id", "product_id", "cosine"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                yield best({c: batch.column(c)[k] for c in batch.schema.names})

    n, own = items.where(F.size("v") == width).count(), workspace(spark, "items")
    _store(items, "item_id", centres, n, ITEM_BLOCK, own, min(probes or 1, len(ids)))
    wanted = spark.read.parquet(own).select(F.col("ids").alias("item_ids"), "cosines", F.col("v").alias("items"))
    # a product of partitions as they are stored: a task reads one of each side, and nothing is shuffled or broadcast
    found = wanted.crossJoin(known.hint("shuffle_replicate_nl")).mapInArrow(compare, out)
    top = found.groupBy("item_id").agg(F.min(F.struct((-F.col("cosine")).alias("neg"), "product_id")).alias("b"))
    return top.select("item_id", "b.product_id", (-F.col("b.neg")).alias("cosine"))


def unmatched_items(items: DataFrame, matches: DataFrame) -> DataFrame:
    """The ids of items without a product, for review."""
    return items.select("item_id").distinct().join(matches.select("item_id"), "item_id", "left_anti")
