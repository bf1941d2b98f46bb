"""Benchmark decontamination by CGK random walks over edit distance.

Texts are sequences of words (lower-cased, punctuation aside). An item of n words may differ from a stretch of a
document in k = n // 5 words. Chakraborty-Goldenberg-Koucky walks read a window from some word on: at each step the
current word is put out, and a random bit of word and step says whether the walk goes on to the next. Walks over like
windows put out like words, so edit distance becomes Hamming distance, and words sampled at a few steps are the keys of
a locality-sensitive hash.

Windows start at every word of a document, and in an item at each of k + 1 equal pieces. k edits leave one piece whole,
so a window of the item starts with ``run`` words that the stretch has too (two to four, by the item's length). A walk
meets there if its last sample lies within these words and reads enough of them; the share of walks that do is known
beforehand (binomial), and the number of repetitions follows from it: together they miss a match with a probability of
at most 1 - ``TARGET``, wherever its edits are. Further whole pieces only add to this.

A proposed place goes on only where the n words around it hold as many item trigrams as k edits leave, and then as many
of the item's words; the rest are verified by the exact edit distance between the item and its best-matching stretch.

Items reach the tasks as hash tables in blocks of at most ``BLOCK_WORDS`` words (a longer item is a block alone), each
block one pass over the documents, so a broadcast never exceeds a block. Of documents only those with a verified stretch
are returned; null and empty texts match nothing. Items of fewer than ``shortest`` words (5 by default) are not searched
and are reported by ``short_items``: they allow no edit, and clean texts hold so few words by chance; with ``shortest``
1 they are searched like the rest.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens
from .common import positional
from .features import _WORD

U = np.uint64
SHORTEST, BLOCK_WORDS, EDITS, TARGET = 5, 1_000_000, 5, 0.999  # one edit for so many words of an item
#: By the words at the start of a window that are surely whole: steps of a walk, and places that it must have gone on.
WALKS = {1: (0, 0), 2: (1, 1), 3: (3, 1), 4: (5, 2)}


def word_hashes(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, bounds by row) of the words of each row, punctuation aside."""
    h, _, _, bound = tokens.words(np.where(_WORD[data], data, np.uint8(32)), at)
    return h, bound


def runs(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the runs of n words from each word, without those past the end."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    out = np.full(len(h) - n + 1, n, np.uint64)
    for j in range(n):
        out = out * tokens.BASE + h[j : len(h) - n + 1 + j]
    return tokens.mix(out)


def pieces(n: int) -> np.ndarray:
    """Bounds of the pieces of an item of n words, one more than the edits that it may take."""
    parts = n // EDITS + 1
    return np.arange(parts + 1) * n // parts


def surely_whole(n: int) -> int:
    """The words of the shortest piece of an item of n words, at most the longest that ``WALKS`` knows."""
    return min(max(WALKS), n // (n // EDITS + 1))


def repetitions(run: int) -> int:
    """Walks of which one at least, with probability ``TARGET``, has gone far enough but not beyond ``run`` words."""
    steps, least = WALKS[run]
    meets = sum(math.comb(steps, j) for j in range(least, run)) / 2**steps
    return 1 if meets == 1 else math.ceil(math.log(1 - TARGET) / math.log(1 - meets))


def samples(run: int, walk: int) -> list[int]:
    """The steps that are sampled: the first, the last, and half of those between."""
    steps = WALKS[run][0]
    between = np.random.default_rng((run, walk)).permutation(np.arange(1, max(1, steps)))[: steps // 2]
    return sorted({0, *between.tolist(), steps})


def signatures(h: np.ndarray, runs: list[int]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(run, walk, key, last place) of the windows from each word of ``h``, for every walk of the given runs."""
    padded = np.concatenate((h, np.zeros(max((WALKS[c][0] for c in runs), default=0), np.uint64)))
    for walk in range(max(map(repetitions, runs), default=0)):
        own = [c for c in runs if walk < repetitions(c)]
        bits = tokens.mix(padded + U((walk + 1) * int(tokens.BASE) % 2**64))
        places = [np.arange(len(h))]
        for step in range(max(WALKS[c][0] for c in own)):
            places.append(places[-1] + ((bits[places[-1]] >> U(step)) & U(1)).astype(np.int64))
        for c in own:
            key = np.zeros(len(h), np.uint64)
            for step in samples(c, walk):
                key = key * tokens.BASE + padded[places[step]]
            yield c, walk, tokens.mix(key), places[WALKS[c][0]]


def edit_match(item: np.ndarray, text: np.ndarray) -> tuple[int, int, int]:
    """(edit distance, first word, end word) of the stretch of ``text`` closest to ``item``, in whole words."""
    m = len(text)
    ramp = np.arange(m + 1)
    row, origin = np.zeros(m + 1, np.int64), ramp.copy()
    for i, w in enumerate(item):
        new = np.empty(m + 1, np.int64)
        new[0] = i + 1
        best = np.minimum(row[1:] + 1, row[:-1] + (text != w))
        new[1:] = best
        came = np.where(best == row[:-1] + (text != w), origin[:-1], origin[1:])
        came = np.concatenate(([0], came))
        shifted = new - ramp
        low = np.minimum.accumulate(shifted)
        source = np.maximum.accumulate(np.where(shifted == low, ramp, 0))
        row, origin = low + ramp, came[source]
    end = int(row.argmin())
    return int(row[end]), int(origin[end]), end


class _Items:
    """A block of items: their words, their trigrams, and for each walk a table from keys to places."""

    def __init__(self, block: list[tuple[int, bytes]]):
        self.words = [np.frombuffer(b, np.uint64) for _, b in block]
        self.ids = [i for i, _ in block]
        self.size = np.array([len(w) for w in self.words], np.int64)
        self.trigrams = _Bits(np.concatenate([runs(w, 3) for w in self.words]))
        end = np.cumsum(self.size)
        of_run: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        for k, n in enumerate(self.size.tolist()):
            cut = pieces(n)[:-1]
            of_run.setdefault(surely_whole(n), []).append((np.full(len(cut), k), cut))
        self.runs = sorted(of_run)
        windows = {c: [np.concatenate(x) for x in zip(*parts, strict=True)] for c, parts in of_run.items()}
        self.tables = {}
        for c, walk, key, last in signatures(np.concatenate(self.words), self.runs):
            items, at = windows[c]
            start = end[items] - self.size[items] + at
            good = (last[start] < end[items]) & (last[start] - start >= WALKS[c][1])
            keys = key[start[good]]
            order = np.argsort(keys, kind="stable")
            self.tables[c, walk] = keys[order], items[good][order], at[good][order], _Bits(keys)

    def candidates(self, h: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """Distinct (row, item, word of ``h`` where the item would start), sorted, that trigrams don't rule out."""
        known = np.zeros(len(h) + 1, np.int64)
        three = runs(h, 3)
        np.cumsum(self.trigrams.may_hold(three), out=known[1 : len(three) + 1])
        known[len(three) + 1 :] = known[len(three)]
        out = [np.zeros((0, 3), np.int64)]
        for c, walk, key, last in signatures(h, self.runs):
            keys, items, at, maybe = self.tables[c, walk]
            place = np.flatnonzero(maybe.may_hold(key))
            place = place[last[place] - place >= WALKS[c][1]]
            lo, hi = np.searchsorted(keys, key[place], "left"), np.searchsorted(keys, key[place], "right")
            times = hi - lo
            for part in np.split(np.arange(len(place)), np.flatnonzero(np.diff(np.cumsum(times) >> 18)) + 1):  # bounded memory
                if not len(part):
                    continue
                which = np.repeat(lo[part] - np.cumsum(times[part]) + times[part], times[part]) + np.arange(times[part].sum())
                p, k = np.repeat(place[part], times[part]), items[which]
                row = np.searchsorted(bound, p, "right") - 1
                start, size, slack = p - at[which], self.size[k], self.size[k] // EDITS
                a, b = np.maximum(bound[row], start - slack), np.minimum(bound[row + 1], start + size + slack)
                ok = (last[p] < bound[row + 1]) & (b - a >= size - slack) & (known[np.maximum(b - 2, a)] - known[a] >= size - 2 - 3 * slack)
                out.append(np.unique(np.stack([row[ok], k[ok], start[ok]], axis=1), axis=0))
        return np.unique(np.concatenate(out), axis=0)


class _Bits:
    """Whether a key may be among given ones: a bit for each value of its leading bits."""

    def __init__(self, keys: np.ndarray):
        bits = min(24, max(12, len(keys).bit_length() + 4))
        self.shift = U(64 - bits)
        self.seen = np.zeros(1 << bits, bool)
        self.seen[keys >> self.shift] = True

    def may_hold(self, keys: np.ndarray) -> np.ndarray:
        return self.seen[keys >> self.shift]


def item_blocks(items: DataFrame, shortest: int = SHORTEST) -> Iterator[list[tuple[int, bytes]]]:
    """Blocks of (item_id, word hashes) of items of at least ``shortest`` words, at most ``BLOCK_WORDS`` each, as a stream."""

    def run(batches):
        for batch in batches:
            ids, hashes = [], []
            for lo, hi, data, at in tokens.chunks(batch.column("text")):
                h, bound = word_hashes(data, at)
                for i in range(hi - lo):
                    w = h[bound[i] : bound[i + 1]]
                    if len(w) >= max(1, shortest):
                        ids.append(batch.column("item_id")[lo + i].as_py())
                        hashes.append(w.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(hashes, pa.binary())], ["item_id", "hashes"])

    rows = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "item_id long, hashes binary")
    block, size = [], 0
    for r in rows.toLocalIterator():
        if block and size + len(r["hashes"]) // 8 > BLOCK_WORDS:
            yield block
            block, size = [], 0
        block.append((r["item_id"], bytes(r["hashes"])))
        size += len(r["hashes"]) // 8
    if block:
        yield block


def short_items(items: DataFrame, shortest: int = SHORTEST) -> DataFrame:
    """Items with fewer than ``shortest`` words, which are not searched for; words as ``word_hashes`` takes them."""
    words = F.regexp_count(F.coalesce(F.col("text").cast("string"), F.lit("")), F.lit(r"[A-Za-z0-9[^\x00-\x7F]]+"))
    return items.where(words < shortest)


def benchmark_matches(docs: DataFrame, items: DataFrame, shortest: int = SHORTEST) -> DataFrame:
    """doc_id, item_id, distance, words, first_word, end_word: verified stretches of documents, the best for each item.

    A stretch matches when its edit distance in words is at most a fifth of the item's length (``EDITS``).
    """
    out = None
    for block in item_blocks(items, shortest):
        found = _search(docs, block)
        out = found if out is None else out.unionAll(found)
    return out if out is not None else docs.sparkSession.createDataFrame([], _SCHEMA)


_SCHEMA = "doc_id long, item_id long, distance int, words int, first_word int, end_word int"


def without_matches(docs: DataFrame, items: DataFrame, shortest: int = SHORTEST) -> DataFrame:
    """The rows of ``docs``, in its columns, in which no stretch matches an item: one filter for each block of items."""
    for block in item_blocks(items, shortest):
        docs = _clean(docs, block)
    return docs


def _matches(items: _Items, texts: pa.Array) -> Iterator[tuple[int, int, int, int, int, int]]:
    """(row, item_id, distance, first word, end word, words of the item): the best match of each row and item."""
    for lo, hi, data, at in tokens.chunks(texts):
        h, bound = word_hashes(data, at)
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        for d, k, a, b in _stretches(items, h, bound):
            base, slack = int(bound[d]), int(items.size[k]) // EDITS
            if (had := best.get((d, k))) and had[0] == 0:
                continue
            dist, first, end = edit_match(items.words[k], h[a:b])
            if dist <= slack and (had is None or dist < had[0]):
                best[d, k] = dist, a - base + first, a - base + end
        for (d, k), (dist, first, end) in best.items():
            yield lo + d, items.ids[k], dist, first, end, len(items.words[k])


def _stretches(items: _Items, h: np.ndarray, bound: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """(row, item, first word, end word) to verify: candidates' surroundings, those that overlap as one."""
    last: tuple[int, int, int, int] | None = None
    for d, k, s in items.candidates(h, bound).tolist():
        item, n = items.words[k], int(items.size[k])
        slack = n // EDITS
        a, b = max(int(bound[d]), s - slack), min(int(bound[d + 1]), s + n + slack)
        if last and last[:2] == (d, k) and b <= last[3]:
            continue
        if np.isin(item, h[a:b]).sum() < n - slack:  # each word that is absent costs an edit
            continue
        if last and last[:2] == (d, k) and a <= last[3]:
            last = d, k, last[2], b
            continue
        if last:
            yield last
        last = d, k, a, b
    if last:
        yield last


def _search(docs: DataFrame, block: list[tuple[int, bytes]]) -> DataFrame:
    shared, built = docs.sparkSession.sparkContext.broadcast(block), []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not built:
            built.append(_Items(shared.value))
        for batch in batches:
            rows = list(_matches(built[0], batch.column("text")))
            ids = batch.column("doc_id").take(pa.array([r[0] for r in rows], pa.int64()))
            cols = [pa.array([r[j] for r in rows], t) for j, t in ((1, pa.int64()), (2, pa.int32()), (5, pa.int32()), (3, pa.int32()), (4, pa.int32()))]
            yield pa.RecordBatch.from_arrays([ids, *cols], ["doc_id", "item_id", "distance", "words", "first_word", "end_word"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, _SCHEMA)


def _clean(docs: DataFrame, block: list[tuple[int, bytes]]) -> DataFrame:
    shared, built = docs.sparkSession.sparkContext.broadcast(block), []
    plain, at = positional(docs)
    text = at["text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not built:
            built.append(_Items(shared.value))
        for batch in batches:
            keep = np.ones(batch.num_rows, bool)
            keep[[r[0] for r in _matches(built[0], batch.column(text))]] = False
            yield batch.filter(pa.array(keep))

    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)
