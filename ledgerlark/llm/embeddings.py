"""Near-duplicate embeddings by product quantisation.

A coarse quantiser and residual codebooks are fitted on a bounded sample (``SAMPLE`` distinct vectors); every vector is
then indexed: it goes to the list of its nearest centroid with the codes of its residual. Every vector is also a query:
in the ``PROBES`` nearest lists, distances come from tables of the query's products with the codebooks. A vector whose
estimate, plus the length of its quantisation error, reaches the threshold is reranked by exact cosine in double
precision; that bound loses nothing within the lists probed, and a pair is found if either vector probes the other's list.

Vectors are compared within a label only. Equal vectors of a label form one class with a count, so copies cost nothing.
Lists larger than ``BLOCK`` are compared block by block, each block with each, in tasks of their own. A task returns the
links each class has, as sums, and a spanning forest of its links, so a dense group costs rows in proportion to its size.

Null, zero and empty vectors and those with null or non-finite components link with nothing, as do rows without label.
Vectors of unlike length are never compared. Rows with equal ids are separate rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, connected_components

SAMPLE, LIST, LISTS, PROBES, BLOCK, PARTS, CODES, ROUNDS = 16384, 2048, 4096, 8, 4096, 8, 64, 8


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    c = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(ROUNDS):
        near = (x @ c.T - 0.5 * (c * c).sum(axis=1)).argmax(axis=1)
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        n = np.bincount(near, minlength=len(c))
        c[n > 0] = total[n > 0] / n[n > 0, None]
    return c


class Quantiser:
    def __init__(self, centroids: np.ndarray, books: list[np.ndarray], cuts: np.ndarray):
        self.centroids, self.books, self.cuts = centroids, books, cuts

    @classmethod
    def fit(cls, sample: np.ndarray, lists: int) -> Quantiser:
        rng = np.random.default_rng(5)
        x = _unit(sample)
        cuts = np.linspace(0, x.shape[1], min(PARTS, x.shape[1]) + 1).astype(int)
        coarse = cls(_kmeans(x, min(lists, len(x)), rng), [], cuts)
        rest = x - coarse.centroids[coarse.nearest(x, 1)[:, 0]]
        return cls(coarse.centroids, [_kmeans(rest[:, a:b], min(CODES, len(x)), rng) for a, b in zip(cuts, cuts[1:], strict=False)], cuts)

    def nearest(self, x: np.ndarray, k: int) -> np.ndarray:
        score = x @ self.centroids.T - 0.5 * (self.centroids**2).sum(axis=1)
        return np.argsort(-score, axis=1, kind="stable")[:, :k]

    def encode(self, x: np.ndarray, home: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(codes, length of the error) of the residuals."""
        rest = x - self.centroids[home]
        codes = np.empty((len(x), len(self.books)), np.uint8)
        for j, book in enumerate(self.books):
            part = rest[:, self.cuts[j] : self.cuts[j + 1]]
            codes[:, j] = (part @ book.T - 0.5 * (book * book).sum(axis=1)).argmax(axis=1)
            rest[:, self.cuts[j] : self.cuts[j + 1]] -= book[codes[:, j]]
        return codes, np.sqrt((rest * rest).sum(axis=1))

    def estimates(self, q: np.ndarray, home: int, codes: np.ndarray) -> np.ndarray:
        """Estimated products of unit queries with the coded vectors of a list, by table lookup."""
        out = np.repeat((q @ self.centroids[home])[:, None], len(codes), axis=1)
        for j, book in enumerate(self.books):
            out += (q[:, self.cuts[j] : self.cuts[j + 1]] @ book.T)[:, codes[:, j]]
        return out


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # squares of very large or small components stay finite
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _matrix(blobs, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(blobs), np.float64).reshape(-1, dim)


def _classes(df: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(vec_id, cls) of all rows, cls null where a row links with nothing; (cls, label, v, dim, n) of the classes."""
    v = F.col("embedding").cast("array<double>")
    sound = F.col("label").isNotNull() & F.col("embedding").isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = df.select("vec_id", "label", v.alias("v"), F.coalesce(sound, F.lit(False)).alias("sound"))
    rows = rows.select("vec_id", "label", "v", F.when(F.col("sound"), F.xxhash64("label", "v")).alias("cls"))
    members = scratch.save(rows.select("vec_id", "cls"), "members")
    classes = rows.where("cls is not null").groupBy("cls", "label", "v").agg(F.count("*").alias("n"))
    return members, scratch.save(classes.withColumn("dim", F.size("v")), "classes")


def _links(classes: DataFrame, dim: int, total: int, threshold: float, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(cls, links) partial sums and (a, b) links that connect, among the vectors of one length."""
    spark = classes.sparkSession
    sample = classes.orderBy(F.xxhash64("cls"), "cls").select("v").limit(SAMPLE).collect()  # bounded
    lists = int(np.clip(total // LIST, 1, LISTS))
    fitted = Quantiser.fit(np.array([r["v"] for r in sample], np.float64), lists)
    shared = spark.sparkContext.broadcast((fitted.centroids, fitted.books, fitted.cuts))

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = Quantiser(*shared.value)
        for batch in batches:
            if not batch.num_rows:
                continue
            raw = np.asarray(batch.column("v").flatten()).reshape(-1, dim)
            x = _unit(raw)
            probes = q.nearest(x, PROBES)
            codes, error = q.encode(x, probes[:, 0])
            blob = lambda a: pa.array([r.tobytes() for r in a], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("cls"), batch.column("label"), batch.column("n"), blob(x), blob(codes), pa.array(error), pa.array(list(probes.astype(np.int32)), pa.list_(pa.int32()))], ["cls", "label", "n", "x", "codes", "error", "probes"])

    table = scratch.save(classes.select("cls", F.col("label").cast("string").alias("label"), "n", "v").mapInArrow(index, "cls long, label string, n long, x binary, codes binary, error double, probes array<int>"), f"index{dim}")
    home = table.withColumn("list", F.col("probes")[0])
    again = spark.read.schema(table.schema).parquet(f"{scratch.root}/index{dim}")
    queries = again.select("cls", "label", "n", "x", F.col("probes")[0].alias("home"), F.explode("probes").alias("list"))
    blocks = home.groupBy("label", "list").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("ib"))
    qblocks = queries.groupBy("label", "list").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("qb"))
    sizes = scratch.save(blocks.join(qblocks, ["label", "list"]), f"sizes{dim}")
    side = lambda df, own, other: df.join(sizes, ["label", "list"]).withColumn(own, F.pmod(F.xxhash64("cls"), own).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.col(other) - 1)))
    left = side(home.select("cls", "label", "list", "n", "x", "codes", "error", "probes"), "ib", "qb")
    right = side(queries, "qb", "ib")

    def compare(key, xs: pd.DataFrame, qs: pd.DataFrame) -> pd.DataFrame:
        if xs.empty or qs.empty:
            return pd.DataFrame({c: pd.array([], "Int64") for c in ("cls", "links", "other")})
        q, at = Quantiser(*shared.value), int(key[1])
        x, y = _matrix(xs["x"], dim), _matrix(qs["x"], dim)
        codes, error = np.frombuffer(b"".join(xs["codes"]), np.uint8).reshape(len(x), -1), xs["error"].to_numpy()
        nx, ny, cx, cy, homes = xs["n"].to_numpy(), qs["n"].to_numpy(), xs["cls"].to_numpy(), qs["cls"].to_numpy(), qs["home"].to_numpy()
        probes = np.array(xs["probes"].tolist(), np.int32).reshape(len(x), -1)
        for_x, for_y = np.zeros(len(x), np.int64), np.zeros(len(y), np.int64)
        group = np.arange(len(x))
        edges: list[tuple[int, int]] = []
        for lo in range(0, len(y), 256):
            part = y[lo : lo + 256]
            rows, cols = np.nonzero(q.estimates(part, at, codes) + error >= threshold - 1e-9)
            exact = np.einsum("ij,ij->i", part[rows], x[cols])
            near = (exact >= threshold) & (cx[cols] != cy[lo + rows])
            rows, cols = rows[near] + lo, cols[near]
            np.add.at(for_y, rows, nx[cols])
            twice = (probes[cols] == homes[rows][:, None]).any(axis=1)  # x probes the list of y as well
            np.add.at(for_x, cols[~twice], ny[rows[~twice]])
            for r in np.unique(rows):
                mine = cols[rows == r]
                roots, first = np.unique(group[mine], return_index=True)
                edges += [(cy[r], cx[mine[i]]) for i in first]
                if len(roots) > 1:
                    group[np.isin(group, roots)] = roots[0]
        counted = np.concatenate((for_x, for_y))
        used = counted > 0
        pairs = np.array(edges, np.int64).reshape(-1, 2)
        k, m = int(used.sum()), len(pairs)
        whole = lambda a, b, known: pd.arrays.IntegerArray(np.concatenate((a, b)), ~np.repeat(known, (k, m)))
        none_k, none_m = np.zeros(k, np.int64), np.zeros(m, np.int64)
        return pd.DataFrame({"cls": np.concatenate((np.concatenate((cx, cy))[used], pairs[:, 0])), "links": whole(counted[used], none_m, (True, False)), "other": whole(none_k, pairs[:, 1], (False, True))})

    keys = ["label", "list", "ib", "qb"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(compare, "cls long, links long, other long")
    found = scratch.save(found, f"found{dim}")
    return found.where("links is not null").select("cls", "links"), found.where("other is not null").select(F.col("cls").alias("a"), F.col("other").alias("b"))


def near_duplicates(df: DataFrame, threshold: float = 0.93) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of ``df(vec_id, embedding, label)``."""
    scratch = Scratch(df.sparkSession)
    members, classes = _classes(df, scratch)
    dims = {r["dim"]: r["n"] for r in classes.groupBy("dim").agg(F.count("*").alias("n")).collect()}
    sums = edges = None
    for dim, n in dims.items():
        s, e = _links(classes.where(F.col("dim") == dim), dim, n, threshold, scratch)
        sums, edges = (s, e) if sums is None else (sums.unionAll(s), edges.unionAll(e))
    if sums is None:
        return members.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    comp = scratch.save(connected_components(edges, scratch), "comp").withColumnRenamed("node", "cls")
    own = members.where("cls is not null").groupBy("cls").agg(F.min("vec_id").alias("own"), F.count("*").alias("copies"))
    named = own.join(comp, "cls", "left").withColumn("comp", F.coalesce("comp", "cls"))
    first = named.groupBy("comp").agg(F.min("own").alias("first"))
    linked = sums.groupBy("cls").agg(F.sum("links").alias("links"))
    about = named.join(first, "comp").join(linked, "cls", "left").select("cls", "first", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"))
    out = members.join(about, "cls", "left").select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("first", "vec_id").cast("long").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id") == F.col("component_id"))
