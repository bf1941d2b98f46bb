"""Whitening of embeddings with an exact covariance by digit-slice matrix products.

An entry c becomes the whole number x = floor(1024 c) + 100000. Tasks split the x of a batch into limbs of ``LIMB`` bits,
the last with the sign: the products of limb matrices are sums of at most 2**53 and so exact in double precision, also
through BLAS. A column of ones beside the vectors makes the number of vectors and the sums by dimension part of the same
products. Sums of equal shift are added up over tasks as decimals, recombined as whole numbers of any size, centred
exactly, and only then rounded to doubles and decomposed.

What goes through one place is a matrix of dimensions x dimensions, whatever the number of vectors.

Defined results: rows whose vector is null or has null or non-finite entries, or entries of 2**51 and more, are left
out; a vector shorter than the longest goes on with zeros; rows with equal ids are separate rows. Components with an
eigenvalue of zero (within rounding) have no rows, so equal vectors, a single one or none give an empty result. Only
``vec_id`` and ``embedding`` are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch

SCALE, SHIFT, LIMB, BLOCK, COMPONENTS = 1024, 100_000, 16, 4096, 8
_LIMIT = 2.0**51
_FLUSH = 1 << 30  # rows of which an int64 holds the sums of products of limbs


def integer_rows(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(places of the usable rows, their whole numbers, filled up to ``width``)."""
    lists = column.cast(pa.large_list(pa.float64()))
    n = len(lists)
    size = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = lists.flatten()  # skips null lists
    value = flat.to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(n), size)
    usable = lists.is_valid().to_numpy(zero_copy_only=False).copy()
    usable[row[~(np.abs(value) < _LIMIT)]] = False  # null entries are NaN here
    keep = np.flatnonzero(usable)
    x = np.full((len(keep), width), SHIFT, np.int64)
    own = usable[row]
    place = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
    x[(np.cumsum(usable) - 1)[row[own]], place[own]] = np.floor(value[own] * SCALE).astype(np.int64) + SHIFT
    return keep, x


def limbs(x: np.ndarray) -> list[np.ndarray]:
    """Matrices of doubles whose sum, each shifted by ``LIMB`` bits more, is x; the last one has the sign."""
    out, half = [], 1 << (LIMB - 1)
    while True:
        if len(x) == 0 or (-half <= x.min() and x.max() < half):
            return [*out, x.astype(float)]
        out.append((x & ((1 << LIMB) - 1)).astype(float))
        x = x >> LIMB


def digit_products(x: np.ndarray, into: dict[int, np.ndarray]) -> None:
    """Adds x' x to ``into``, by shift in limbs."""
    parts = limbs(x)
    for a, left in enumerate(parts):
        for b, right in enumerate(parts):
            product = (left.T @ right).astype(np.int64)
            into[a + b] = into[a + b] + product if a + b in into else product


def gram_matrix(vectors: DataFrame, width: int) -> list[list[int]]:
    """The exact products of all pairs of columns, of which the first is a column of ones."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        seen = 0
        for batch in batches:
            _, x = integer_rows(batch.column("embedding"), width)
            for lo in range(0, len(x), BLOCK):
                own = x[lo : lo + BLOCK]
                digit_products(np.column_stack((np.ones(len(own), np.int64), own)), sums)
                seen += len(own)
                if seen + BLOCK >= _FLUSH:
                    yield from _entries(sums)
                    sums, seen = {}, 0
        yield from _entries(sums)

    parts = vectors.mapInArrow(task, "i int, j int, shift int, part long")
    sums = parts.groupBy("i", "j", "shift").agg(F.sum(F.col("part").cast("decimal(38,0)")).alias("part"))
    lines = sums.groupBy("i").agg(F.collect_list(F.struct("j", "shift", F.col("part").cast("string").alias("part"))).alias("line"))
    out = [[0] * (width + 1) for _ in range(width + 1)]
    for i, line in lines.toLocalIterator():
        for j, shift, part in line:
            out[i][j] += int(part) << (LIMB * shift)
            if i != j:
                out[j][i] = out[i][j]
    return out


def _entries(sums: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
    for shift, m in sums.items():
        i, j = np.triu_indices(len(m))
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(np.full(len(i), shift), pa.int32()), pa.array(m[i, j])], ["i", "j", "shift", "part"])


def principal_components(gram: list[list[int]], components: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(unit eigenvectors as rows, their eigenvalues, falling, their parts of the trace) of the covariance."""
    n, d = gram[0][0], len(gram) - 1
    if n < 2:
        return np.zeros((0, d)), np.zeros(0), np.zeros(0)
    centred = [[n * gram[i][j] - gram[0][i] * gram[0][j] for j in range(1, d + 1)] for i in range(1, d + 1)]
    value, vector = np.linalg.eigh(np.array([[c / (n * n) for c in line] for line in centred]))  # whole numbers divide correctly rounded
    order = np.argsort(-value, kind="stable")[: min(components, d)]
    order = order[value[order] > value.max(initial=0) * d * np.finfo(float).eps]
    trace = sum(centred[k][k] for k in range(d)) / (n * n)
    return vector[:, order].T, value[order], value[order] / trace if trace else value[order]


def whitened_vectors(df: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """vec_id, n, deviation, whitened (array), explained (array), identity_error for every usable row of ``df``.

    deviation: the sum over dimensions of (n x - S)^2 as decimal(38,0), null where it has more digits.
    """
    scratch = Scratch(df.sparkSession)
    vectors = df.select("vec_id", "embedding")
    width = vectors.agg(F.max(F.size("embedding"))).first()[0] or 0
    gram = gram_matrix(vectors, max(0, width))
    n, sums = gram[0][0], gram[0][1:]
    axes, value, explained = principal_components(gram, components)
    whole = np.array([s // n if n else 0 for s in sums], np.int64)
    rest = np.array([s % n if n else 0 for s in sums], object)
    scaled, fraction = axes / np.sqrt(value)[:, None], np.array([r / n for r in rest] if n else [], float)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, x = integer_rows(batch.column("embedding"), width)
            x -= whole
            off = _square_sums(x, n, rest)
            w = (x.astype(float) - fraction) @ scaled.T
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * len(scaled), pa.int32()), pa.array(w.ravel()))
            ids = batch.column("vec_id").take(pa.array(keep))
            yield pa.RecordBatch.from_arrays([ids, pa.array(off, pa.decimal128(38, 0)), lists], ["vec_id", "deviation", "whitened"])

    kind = df.schema["vec_id"].dataType.simpleString()
    rows = scratch.save(vectors.mapInArrow(project, f"vec_id {kind}, deviation decimal(38,0), whitened array<double>"), "whitened")
    k = range(len(scaled))
    errors = [F.abs(F.covar_pop(F.col("whitened")[i], F.col("whitened")[j]) - float(i == j)) for i in k for j in k if i <= j]
    error = max(rows.agg(*errors).first()) if errors else None
    return rows.select("vec_id", F.lit(n).cast("long").alias("n"), "deviation", "whitened", F.lit([float(e) for e in explained]).cast("array<double>").alias("explained"), F.lit(error).cast("double").alias("identity_error"))


def _square_sums(x: np.ndarray, n: int, rest: np.ndarray) -> list[int | None]:
    """For each row the sum of (n x - rest)^2, in whole numbers of any size where 64 bits may not do; null beyond 38 digits."""
    most = max(abs(int(x.min(initial=0))), abs(int(x.max(initial=0)))) + 1
    if x.shape[1] * (n * most) ** 2 < 1 << 63:
        d = n * x - rest.astype(np.int64)
        return (d * d).sum(axis=1).tolist()
    totals = (sum((n * int(a) - int(r)) ** 2 for a, r in zip(line, rest, strict=True)) for line in x)
    return [t if t < 10**38 else None for t in totals]
