"""Document quality by a naive Bayes support vector machine.

Features are indicators of hashed byte n-grams. Each is scaled by its class log-count ratio, counted over all labelled
training rows as a grouped sum; a linear hinge-loss model over the scaled indicators is then fitted by dual coordinate
descent on a bounded sample (``SAMPLE`` rows of each class), and margins are calibrated to probabilities on a part of
the sample that the fit didn't see, its classes weighted as they occur in all training labels. The model is ``2 ** BITS`` weights, whatever the input, and is broadcast.

Null and empty texts have no features and get the score of the intercept; with no labels of both classes every score
is 0.5. Scores depend on the text only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import tokens
from .features import byte_ngrams, indexed_rows, one_text, platt, score_frame, sigmoid, texts_of, training_ids

BITS, GRAM, SAMPLE, EPOCHS, C = 18, 3, 4000, 8, 1.0


def _features(data, at):
    return byte_ngrams(data, at, GRAM, BITS)


def log_count_ratios(docs: DataFrame, labels: DataFrame, held_out: Column) -> np.ndarray:
    """r: log of the ratio of the classes' smoothed shares of documents with each feature, from all training rows."""
    known = labels.where(~held_out & F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min(F.col("quality").cast("int")).alias("y"))
    # Labels have no size bound: one way to join them at every size.
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(known.hint("shuffle_merge"), "doc_id").select("text", "y")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, (1 << BITS) + 1), np.int64)
        for batch in batches:
            y = batch.column("y").to_numpy(zero_copy_only=False)
            for lo, _, data, at in tokens.chunks(batch.column("text")):
                for i, idx in enumerate(_features(data, at)):
                    total[y[lo + i], idx] += 1
                    total[y[lo + i], -1] += 1
        used = np.flatnonzero(total.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[0, used]), pa.array(total[1, used])], ["f", "n0", "n1"])

    sums = rows.mapInArrow(count, "f int, n0 long, n1 long").groupBy("f").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).toPandas()  # 2^BITS + 1 rows at most
    n = np.zeros((2, (1 << BITS) + 1))
    n[0, sums["f"]], n[1, sums["f"]] = sums["n0"], sums["n1"]
    share = (n[:, :-1] + 1) / (n[:, -1:] + 2)
    return np.log(share[1] / share[0]).astype(np.float32)


def dual_coordinate_descent(rows: list[np.ndarray], y: np.ndarray, r: np.ndarray, c: np.ndarray, epochs: int) -> tuple[np.ndarray, float]:
    """(weights on the indicators, intercept) of min |w|^2 / 2 + sum c max(0, 1 - y w x): one dual variable at a time."""
    w, b, alpha = np.zeros(len(r)), 0.0, np.zeros(len(rows))
    scaled = [r[i].astype(float) for i in rows]
    norms = [float(np.sqrt(x @ x)) or 1.0 for x in scaled]
    scaled = [x / z for x, z in zip(scaled, norms, strict=True)]
    order = np.random.default_rng(7)
    for _ in range(epochs):
        for k in order.permutation(len(rows)):
            idx, x = rows[k], scaled[k]
            g = y[k] * (w[idx] @ x + b) - 1
            new = min(max(alpha[k] - g / 2.0, 0.0), c[k])  # |x| = 1, and 1 for the intercept
            if new != alpha[k]:
                d = (new - alpha[k]) * y[k]
                w[idx] += d * x
                b += d
                alpha[k] = new
    return w, b


def fit(docs: DataFrame, labels: DataFrame, held_out: Column) -> tuple[np.ndarray, np.ndarray, float, float, float]:
    """(weights by feature, log-count ratios, intercept, slope and offset of the calibration)."""
    ids, weights = training_ids(labels, "quality", held_out, SAMPLE)
    ratios = log_count_ratios(docs, labels, held_out)
    shared = docs.sparkSession.sparkContext.broadcast(ratios)

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, y = indexed_rows(batches, _features)
        if not rows:
            return
        r = shared.value
        test = np.arange(len(rows)) % 5 == 0
        train = np.flatnonzero(~test)
        each = np.where(y == 1, len(y) / max(1, 2 * y.sum()), len(y) / max(1, 2 * (1 - y).sum()))
        w, b = dual_coordinate_descent([rows[i] for i in train], 2.0 * y[train] - 1, r, C * each[train], EPOCHS)
        w = (w * r).astype(np.float32)
        a, o = platt(np.array([_margin(rows[i], w, b, r) for i in np.flatnonzero(test)]), y[test], weights)
        yield pa.RecordBatch.from_arrays([pa.array([w.tobytes()], pa.binary()), *(pa.array([float(v)]) for v in (b, a, o))], ["w", "b", "a", "o"])

    # One text an id before the one task, which keeps feature indices only; it returns one row of fixed size.
    got = one_text(texts_of(docs, ids)).repartition(1).mapInArrow(solve, "w binary, b double, a double, o double").collect()
    shared.unpersist()
    if not got:
        return np.zeros(1 << BITS, np.float32), ratios, 0.0, 1.0, 0.0
    return np.frombuffer(got[0]["w"], np.float32), ratios, got[0]["b"], got[0]["a"], got[0]["o"]


def _margin(idx: np.ndarray, w: np.ndarray, b: float, r: np.ndarray) -> float:
    x = r[idx]
    return float(w[idx].sum() / (np.sqrt(float(x @ x)) or 1.0) + b)


def quality_scores(docs: DataFrame, labels: DataFrame, held_out: Column) -> DataFrame:
    """doc_id, score for every row of ``docs(doc_id, text)``. ``held_out``: condition on labels.doc_id of rows never learnt from."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, held_out))

    def weigh(idx):
        w, r, b, a, o = model.value
        return sigmoid(a * _margin(idx, w, b, r) + o)

    return score_frame(docs, _features, weigh)
