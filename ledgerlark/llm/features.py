"""Hashed text features and bounded training samples for the classifiers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import tokens
from .common import positional

U = np.uint64


def byte_ngrams(data: np.ndarray, at: np.ndarray, k: int, bits: int) -> Iterator[np.ndarray]:
    """For each row the distinct hashed k-grams of its bytes, sorted."""
    n = len(data) - k + 1
    if n > 0:
        code = np.zeros(n, np.uint32)
        for j in range(k):
            code = code * np.uint32(0x01000193) ^ data[j : j + n]
        code = (code * np.uint32(0x9E3779B1)) >> np.uint32(32 - bits)
    seen = np.zeros(1 << bits, bool)
    for i in range(len(at) - 1):
        lo, hi = at[i], at[i + 1] - k + 1
        if hi <= lo:
            yield np.zeros(0, np.int64)
            continue
        own = code[lo:hi]
        seen[own] = True
        found = np.flatnonzero(seen) if len(own) > 20000 else np.unique(own).astype(np.int64)
        seen[own] = False
        yield found


def word_skipgrams(data: np.ndarray, at: np.ndarray, order: int, skip: int, bits: int) -> Iterator[np.ndarray]:
    """For each row the distinct hashed word n-grams up to ``order`` and word pairs with up to ``skip`` words between.

    Words are lower-cased runs of ASCII letters, digits and non-ASCII bytes: punctuation separates them.
    """
    clean = np.where(_WORD[data], data, np.uint8(32))
    h, _, _, bound = tokens.words(clean, at)
    shift = U(64 - bits)
    for i in range(len(at) - 1):
        w = h[bound[i] : bound[i + 1]]
        if not len(w):
            yield np.zeros(0, np.int64)
            continue
        parts, run = [w], w
        for k in range(1, order):
            if len(w) > k:
                run = tokens.mix(run[:-1] * U(31) + w[k:])
                parts.append(run)
        for gap in range(2, skip + 2):
            if len(w) > gap:
                parts.append(tokens.mix(w[:-gap] * U(131) + w[gap:] + U(gap)))
        yield np.unique(tokens.mix(np.concatenate(parts) + U(7)) >> shift).astype(np.int64)


_WORD = np.zeros(256, bool)
_WORD[128:] = _WORD[48:58] = _WORD[65:91] = _WORD[97:123] = True


def fold(doc_id: Column, folds: int) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(folds))


def training_ids(labels: DataFrame, target: str, held_out: Column, rows: int) -> tuple[DataFrame, np.ndarray]:
    """(doc_id, y: at most ``rows`` labelled rows of each class outside the held-out fold, those of smallest hash; weights).

    Rows with a null id or label are no examples; of rows with equal ids the smallest label counts. The weight of a
    class, 0 and 1, is how many labelled rows each of its sampled rows stands for.
    """
    one = labels.where(~held_out & F.col(target).isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min(F.col(target).cast("int")).alias("y"))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    ids = one.where("y = 1").orderBy(*order).limit(rows).unionAll(one.where("y = 0").orderBy(*order).limit(rows))
    n = one.agg(F.count_if(F.col("y") == 0), F.count_if(F.col("y") == 1)).first()
    return ids, np.maximum(1.0, np.array(n, float) / rows)


def texts_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """doc_id, text, y of the sampled ids. The sample has a fixed bound, so it is broadcast; one text for each id."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(ids), "doc_id")


def one_text(sample: DataFrame) -> DataFrame:
    """doc_id, text, y: of rows with equal ids the one with the smallest text, null first."""
    return sample.groupBy("doc_id").agg(F.min(F.struct("text")).alias("t"), F.min("y").alias("y")).select("doc_id", "t.text", "y")


def indexed_rows(batches: Iterator[pa.RecordBatch], features) -> tuple[list[np.ndarray], np.ndarray]:
    """(index arrays, labels) of a sample's rows, by doc_id. Texts are let go batch by batch."""
    ids, y, rows = [], [], []
    for batch in batches:
        ids += batch.column("doc_id").to_pylist()
        y += batch.column("y").to_pylist()
        rows += [idx.astype(np.int32) for _, _, data, at in tokens.chunks(batch.column("text")) for idx in features(data, at)]
    order = np.argsort(np.array(ids, np.int64), kind="stable")
    return [rows[k] for k in order], np.array(y, float)[order]


def score_frame(docs: DataFrame, features, weigh, keep: list[str] | None = None, name: str = "score") -> DataFrame:
    """``keep`` (doc_id by default) and the score of every row: ``features(bytes, offsets)`` yields index arrays, ``weigh(indices)`` a probability."""
    if keep is None:
        docs, keep = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), ["doc_id"]
    plain, at = positional(docs)
    kept, text = [at[c] for c in keep], at["text"]
    schema = T.StructType([*(plain.schema[c] for c in kept), T.StructField("_score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = np.empty(batch.num_rows)
            for lo, _, data, offsets in tokens.chunks(batch.column(text)):
                for i, idx in enumerate(features(data, offsets)):
                    scores[lo + i] = weigh(idx)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(scores)], [*kept, "_score"])

    return plain.select(*dict.fromkeys([*kept, text])).mapInArrow(run, schema).toDF(*keep, name)


def platt(margin: np.ndarray, y: np.ndarray, weights: np.ndarray, rounds: int = 60) -> tuple[float, float]:
    """(a, b) of the probability 1 / (1 + exp(-(a m + b))), by Newton steps; (1, 0) where one class is missing.

    ``weights`` of the classes 0 and 1 undo their sampling, so the probabilities are those of all labelled rows.
    """
    if not len(y) or y.min() == y.max():
        return 1.0, 0.0
    scale = max(1e-9, float(np.std(margin)))
    m, a, b = margin / scale, 1.0, 0.0
    each = weights[y.astype(int)]
    each = each * (len(y) / each.sum())
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a * m + b, -30, 30)))
        r, v = each * (p - y), each * p * (1 - p) + 1e-9
        g = np.array([(r * m).sum() + 1e-2 * a, r.sum()])
        h = np.array([[(v * m * m).sum() + 1e-2, (v * m).sum()], [(v * m).sum(), v.sum() + 1e-6]])
        step = np.clip(np.linalg.solve(h, g), -2, 2)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return max(1e-6, a) / scale, b


def sigmoid(x: float) -> float:
    return float(1 / (1 + np.exp(-np.clip(x, -30, 30))))
