"""Language-model scoring with stupid backoff, computed relationally.

The n-gram counts of the whole corpus form tables partitioned by hash. Documents are dealt into blocks; a block sends
each partition its distinct n-grams with their counts in the block, so that a frequent n-gram costs a row a block, not
one an occurrence. A partition adds up the counts of all blocks and answers each block with the totals of what it asked
for; a block joins them to the n-grams of its documents and sums the scores of each document.

A word's score is the logarithm of c(n-gram) / c(context) for the longest n-gram up to ``ORDER`` seen ``min_count``
times (1 takes every n-gram; by default 2, as a text in the corpus has seen its own n-grams once), less ln(1 / ALPHA) for each order given up; of single words c(word) / c(all words), without minimum. Scores are
rounded to a millionth before they are summed, so sums do not depend on the order.

Words are runs of bytes other than ASCII white space, A-Z as a-z. Documents without words have no score (null). Rows
with equal ids are separate rows. N-grams are told apart by hashes of 48 bits and those of their partition.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens
from .common import Scratch

U = np.uint64
ORDER, MIN_COUNT, ALPHA, BLOCK_BYTES, PART_BYTES = 3, 2, 0.4, 8_000_000, 4_000_000
LOW = U((1 << 48) - 1)


def _ngrams(text: pa.ChunkedArray, orders: tuple[int, ...]) -> tuple[list[np.ndarray], np.ndarray]:
    """(hashes of the n-grams ending at each word, for each order; 0 where there is none), words of each row."""
    parts: dict[int, list] = {n: [] for n in orders}
    sizes = []
    for chunk in text.chunks:
        for _, _, data, at in tokens.chunks(chunk):
            h, _, _, bound = tokens.words(data, at)
            size = np.diff(bound)
            sizes.append(size)
            place = np.arange(len(h)) - np.repeat(bound[:-1], size)
            run = h.copy()
            for n in range(1, max(orders) + 1):
                if n > 1:
                    run = np.concatenate((run[:1], tokens.mix(run[:-1] * U(31) + h[1:] + U(n)))) if len(h) else run
                if n in parts:
                    parts[n].append(np.where(place >= n - 1, run | U(1), U(0)))
    none = np.zeros(0, np.uint64)
    return [np.concatenate(parts[n]) if parts[n] else none for n in orders], np.concatenate(sizes) if sizes else np.zeros(0, np.int64)


def _distinct(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sorted distinct hashes without 0, their counts, index of each entry of h; one past the end for 0)."""
    u, inverse, n = np.unique(h, return_inverse=True, return_counts=True)
    if len(u) and u[0] == 0:
        return u[1:], n[1:], np.where(h == 0, len(u) - 1, inverse - 1)
    return u, n, inverse


def _totals(docs: DataFrame, orders: tuple[int, ...], bits: int, min_count: int, scratch: Scratch) -> DataFrame:
    """block, ord, part, totals: for the distinct n-grams of a block in a partition, in hash order, their corpus counts."""

    def ask(table: pa.Table) -> pa.Table:
        block = table.column("block")[0].as_py()
        rows: dict[str, list] = {"part": [], "ord": [], "grams": [], "counts": []}
        for n, h in zip(orders, _ngrams(table.column("text"), orders)[0], strict=True):
            u, c, _ = _distinct(h)
            part = (u >> U(64 - bits)).astype(np.int64)
            cut = np.searchsorted(part, np.arange((1 << bits) + 1))
            low = np.ascontiguousarray((u & LOW).view(np.uint8).reshape(-1, 8)[:, :6])
            for p in np.flatnonzero(np.diff(cut)):
                rows["part"].append(p)
                rows["ord"].append(n)
                rows["grams"].append(low[cut[p] : cut[p + 1]].tobytes())
                rows["counts"].append(c[cut[p] : cut[p + 1]].astype(np.uint32).tobytes())
        return pa.table({"part": pa.array(rows["part"], pa.int32()), "ord": pa.array(rows["ord"], pa.int32()), "block": pa.array([block] * len(rows["ord"]), pa.int32()), "grams": pa.array(rows["grams"], pa.binary()), "counts": pa.array(rows["counts"], pa.binary())})

    def add(table: pa.Table) -> pa.Table:
        grams, counts = table.column("grams").to_pylist(), table.column("counts").to_pylist()
        raw = np.frombuffer(b"".join(grams), np.uint8).reshape(-1, 6)
        h = np.zeros((len(raw), 8), np.uint8)
        h[:, :6] = raw
        _, inverse = np.unique(h.view(np.uint64).ravel(), return_inverse=True)
        total = np.bincount(inverse, weights=np.frombuffer(b"".join(counts), np.uint32))[inverse].astype(np.int64)
        if table.column("ord")[0].as_py() > 1:
            total[total < min_count] = 0
        cut = np.cumsum([0] + [len(c) // 4 for c in counts])
        answers = [total[a:b].tobytes() for a, b in zip(cut, cut[1:], strict=False)]
        return pa.table({"block": table.column("block"), "ord": table.column("ord"), "part": table.column("part"), "totals": pa.chunked_array([pa.array(answers, pa.binary())])})

    asked = docs.groupBy("block").applyInArrow(ask, "part int, ord int, block int, grams binary, counts binary")
    answered = asked.groupBy("part", "ord").applyInArrow(add, "block int, ord int, part int, totals binary")
    return scratch.save(answered, f"totals{orders[0]}")


def backoff_scores(docs: DataFrame, min_count: int = MIN_COUNT) -> DataFrame:
    """doc_id, n_words, log_micros, score for every row of ``docs(doc_id, text)``.

    log_micros: sum of the words' log scores in millionths; score: their mean.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // BLOCK_BYTES))
    bits = int(np.ceil(np.log2(max(4, size / PART_BYTES))))
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int"))
    first = _totals(dealt, tuple(range(1, ORDER)), bits, min_count, scratch) if ORDER > 1 else None
    last = _totals(dealt, (ORDER,), bits, min_count, scratch)
    answers = last if first is None else first.unionAll(last)
    words = rows.agg(F.sum(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]++")))).first()[0] or 0
    every = spark.sparkContext.broadcast(float(max(1, words)))

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        orders = tuple(range(1, ORDER + 1))
        grams, sizes = _ngrams(left.column("text"), orders)
        given = sorted(zip(right.column("ord").to_pylist(), right.column("part").to_pylist(), right.column("totals").to_pylist(), strict=True), key=lambda r: r[:2])
        counts = []
        for n, h in zip(orders, grams, strict=True):
            u, _, inverse = _distinct(h)
            total = np.append(np.frombuffer(b"".join(t for o, _, t in given if o == n), np.int64), 0)
            if len(total) != len(u) + 1:
                raise ValueError(f"block has {len(u)} n-grams of order {n}, answers have {len(total) - 1}")
            counts.append(total[inverse].astype(float))
        m = len(grams[0])
        place = np.arange(m) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        longest = np.minimum(place, ORDER - 1)
        logs, open_ = np.zeros(m), np.ones(m, bool)
        for n in range(ORDER, 0, -1):
            c = counts[n - 1]
            hit = open_ & ((c > 0) if n > 1 else True) & (place >= n - 1)
            if n > 1:
                context = np.concatenate(([1.0], counts[n - 2][:-1])) if m else c
                ratio = c[hit] / context[hit]
            else:
                ratio = c[hit] / every.value
            logs[hit] = np.log(ratio) + np.log(ALPHA) * (longest[hit] - (n - 1))
            open_ &= ~hit
        micros = np.concatenate(([0], np.cumsum(np.rint(logs * 1e6).astype(np.int64))))
        end = np.cumsum(sizes)
        total = micros[end] - micros[end - sizes]
        return pa.table({"doc_id": left.column("doc_id"), "n_words": pa.array(sizes.astype(np.int64)), "log_micros": pa.array(total)})

    scored = dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(score, "doc_id long, n_words long, log_micros long")
    mean = F.when(F.col("n_words") > 0, F.col("log_micros") / F.col("n_words") / 1e6)
    return scored.select("doc_id", "n_words", F.when(F.col("n_words") > 0, F.col("log_micros")).alias("log_micros"), mean.alias("score"))
