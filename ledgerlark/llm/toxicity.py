"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

The fit passes a bounded sample (``SAMPLE`` rows of each class) ``EPOCHS`` times; each coordinate has its own learning
rate and L1 leaves most weights at zero, so the model is a short sorted list of indices and weights, at most
``2 ** BITS`` of them, and is broadcast. Log-odds are calibrated on a part of the sample that the fit didn't see, its
classes weighted as they occur in all training labels.

Null and empty texts have no features and get the score of the intercept; with no labels of both classes every score
is 0. Scores depend on the text only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame

from .features import indexed_rows, one_text, platt, score_frame, sigmoid, texts_of, training_ids, word_skipgrams

BITS, ORDER, SKIP, SAMPLE, EPOCHS = 20, 2, 2, 6000, 6
ALPHA, BETA, L1, L2 = 0.5, 1.0, 10.0, 1.0
THRESHOLD = 0.7


def _features(data, at):
    return word_skipgrams(data, at, ORDER, SKIP, BITS)


def ftrl(rows: list[np.ndarray], y: np.ndarray) -> tuple[np.ndarray, float]:
    """(weights, intercept): proximal updates with per-coordinate rates; the intercept has no L1."""
    z, n, zb, nb = np.zeros(1 << BITS), np.zeros(1 << BITS), 0.0, 0.0

    def at(zi, ni):
        return np.where(np.abs(zi) <= L1, 0.0, -(zi - np.sign(zi) * L1) / ((BETA + np.sqrt(ni)) / ALPHA + L2))

    order = np.random.default_rng(11)
    for _ in range(EPOCHS):
        for k in order.permutation(len(rows)):
            idx = rows[k]
            w, b = at(z[idx], n[idx]), -zb / ((BETA + np.sqrt(nb)) / ALPHA)
            g = sigmoid(w.sum() + b) - y[k]
            z[idx] += g - (np.sqrt(n[idx] + g * g) - np.sqrt(n[idx])) / ALPHA * w
            n[idx] += g * g
            zb += g - (np.sqrt(nb + g * g) - np.sqrt(nb)) / ALPHA * b
            nb += g * g
    return at(z, n), float(-zb / ((BETA + np.sqrt(nb)) / ALPHA))


def fit(docs: DataFrame, labels: DataFrame, held_out: Column) -> tuple[np.ndarray, np.ndarray, float]:
    """(indices, weights, intercept), with the calibration folded in."""
    ids, weights = training_ids(labels, "toxic", held_out, SAMPLE)

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, y = indexed_rows(batches, _features)
        if not rows:
            return
        test = np.arange(len(rows)) % 5 == 0
        train = np.flatnonzero(~test)
        w, b = ftrl([rows[i] for i in train], y[train])
        a, o = platt(np.array([w[rows[i]].sum() + b for i in np.flatnonzero(test)]), y[test], weights)
        used = np.flatnonzero(w)
        model = [used.astype(np.int32).tobytes()], [(a * w[used]).astype(np.float32).tobytes()], [a * b + o]
        yield pa.RecordBatch.from_arrays([pa.array(model[0], pa.binary()), pa.array(model[1], pa.binary()), pa.array(model[2], pa.float64())], ["i", "w", "b"])

    got = one_text(texts_of(docs, ids)).repartition(1).mapInArrow(solve, "i binary, w binary, b double").collect()  # one row of bounded size
    if not got:
        return np.zeros(0, np.int32), np.zeros(0, np.float32), -30.0
    return np.frombuffer(got[0]["i"], np.int32), np.frombuffer(got[0]["w"], np.float32), got[0]["b"]


def toxicity_scores(docs: DataFrame, labels: DataFrame, held_out: Column, keep: list[str] | None = None, name: str = "score") -> DataFrame:
    """``keep`` (doc_id by default) and the score, as ``name``, for every row of ``docs(doc_id, text)``.

    ``held_out``: condition on labels.doc_id of rows never learnt from.
    """
    sparse = fit(docs, labels, held_out)
    model, dense = docs.sparkSession.sparkContext.broadcast(sparse), {}

    def weigh(idx):
        if "w" not in dense:
            i, w, _ = model.value
            dense["w"] = np.zeros(1 << BITS, np.float32)
            dense["w"][i] = w
        return sigmoid(float(dense["w"][idx].sum()) + model.value[2])

    return score_frame(docs, _features, weigh, keep, name)
