"""Audit of how sources differ in their words, by mergeable radix tries.

Terms are runs of ASCII letters and characters beyond ASCII, with A-Z in lower case. A language keeps the terms of at
least ``MIN_DOCS`` of its rows. For a group, a source of a language, a kept term that occurs c times there has
p = 1 + floor(SCALE (c + 1) / (N + V)), with V kept terms and N their occurrences in the group; f = floor((p - q)^2 / q)
compares p with the q of another source, or of the whole language.

A partition counts the terms of its texts in radix tries of bytes, one for a language, whose leaves have a counter for
each source. Tries are cut into subtries by prefix, written front-coded, and dealt by ranges of prefixes, where subtries
of equal prefix merge and terms of too few rows go. Prefixes with very many leaves are made longer first, so no merge
gets more than a bounded number of different terms. What is left is walked in UTF-8 order: blocks of terms give the sums
of f for pairs of sources, and each group's best terms, which have equal values in the order of the walk.

A task holds a trie of at most ``LEAVES`` new leaves, or one merged subtrie, and sums for ``SLAB`` sources against all
of the language: the number of pairs of sources is that of the result.

All arithmetic is on whole numbers. Null lang, source and text are ''. Each row is a document, also where ids or whole
rows repeat. Groups without terms, and languages without kept terms, have their pairs too. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import tokens
from .common import Scratch

MIN_DOCS, BEST, SCALE_STEPS = 3, 200, 3  # the scale is 1000 to the power of the steps
LEAVES, HEAVY, DEPTH, SLAB, CELLS, CHUNK = 300_000, 4_000_000, 2, 256, 1 << 21, 8_000_000
_LETTER = np.zeros(256, bool)
_LETTER[128:] = _LETTER[65:91] = _LETTER[97:123] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_MASK = np.array([0] + [(2**64 - 1) << (64 - 8 * k) & (2**64 - 1) for k in range(1, 9)], np.uint64)
_SUBTRIE = "lang string, prefix binary, leaves long, names array<string>, shared binary, sizes binary, tails binary, docs binary, ends binary, source binary, counts binary"
_MERGED = _SUBTRIE + ", totals array<struct<source:string,n:long>>"


class Trie:
    """A radix trie: an edge holds a run of bytes; leaves are numbered in the order in which they come."""

    def __init__(self):
        self.edge, self.kids, self.leaf, self.n = [b""], [{}], [-1], 0

    def add(self, term: bytes) -> int:
        edge, kids, leaf, node, at = self.edge, self.kids, self.leaf, 0, 0
        while at < len(term):
            below = kids[node]
            kid = below.get(term[at]) if below is not None else None
            if kid is None:
                if below is None:
                    below = kids[node] = {}
                below[term[at]] = len(edge)
                node = len(edge)
                edge.append(term[at:])
                kids.append(None)
                leaf.append(-1)
                break
            run = edge[kid]
            if not term.startswith(run, at):
                common = 1
                while at + common < len(term) and run[common] == term[at + common]:
                    common += 1
                middle = len(edge)
                edge.append(run[:common])
                kids.append({run[common]: kid})
                leaf.append(-1)
                edge[kid] = run[common:]
                below[term[at]] = kid = middle
                run = edge[middle]
            node, at = kid, at + len(run)
        if leaf[node] < 0:
            leaf[node] = self.n
            self.n += 1
        return leaf[node]

    def walk(self) -> Iterator[tuple[bytes, int]]:
        """(term, leaf) in the order of the terms' bytes."""
        todo = [(0, b"")]
        while todo:
            node, prefix = todo.pop()
            prefix += self.edge[node]
            if self.leaf[node] >= 0:
                yield prefix, self.leaf[node]
            if self.kids[node]:
                todo += [(self.kids[node][b], prefix) for b in sorted(self.kids[node], reverse=True)]


class Counted:
    """A trie with, for each leaf, the number of rows and a counter for each source."""

    def __init__(self):
        self.trie, self.names, self.parts, self.docs = Trie(), {}, [], []

    def source(self, name: str) -> int:
        return self.names.setdefault(name, len(self.names))

    def add(self, leaves: np.ndarray, docs: np.ndarray, at: np.ndarray, source: np.ndarray, counts: np.ndarray) -> None:
        """``docs`` for each of ``leaves``; ``counts`` for places ``at`` in ``leaves`` and sources."""
        self.docs.append((leaves, docs))
        self.parts.append((leaves[at], source, counts))
        if sum(len(p[0]) for p in self.parts[1:]) > 4 * LEAVES:
            self.parts = [self.cells()]

    def cells(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(leaf, source, count) by leaf and source, each once."""
        leaf, source, count = (np.concatenate(p) for p in zip(*self.parts, strict=True))
        width = max(1, len(self.names))
        key, inverse = np.unique(leaf * width + source, return_inverse=True)
        total = np.zeros(len(key), np.int64)
        np.add.at(total, inverse, count)
        return key // width, key % width, total

    def rows(self, lang: str, depth: int, least: int = 0, prefix: bytes | None = None) -> Iterator[dict]:
        """A subtrie for each prefix of ``depth`` bytes, or one for all terms as ``prefix``; terms of fewer than ``least`` rows go."""
        docs = np.zeros(self.trie.n, np.int64)
        for leaves, n in self.docs:
            np.add.at(docs, leaves, n)
        leaf, source, count = self.cells()
        start = np.searchsorted(leaf, np.arange(self.trie.n + 1))
        names, now, own = list(self.names), prefix, []
        for term, k in self.trie.walk():
            if docs[k] < least:
                continue
            if prefix is None and term[:depth] != now:
                if own:
                    yield self._row(lang, now, own, docs, start, names, source, count)
                now, own = term[:depth], []
            own.append((term, k))
        if own:
            yield self._row(lang, now, own, docs, start, names, source, count)

    @staticmethod
    def _row(lang: str, prefix: bytes, own: list, docs: np.ndarray, start: np.ndarray, names: list, source: np.ndarray, count: np.ndarray) -> dict:
        terms, leaves = [t for t, _ in own], np.array([k for _, k in own])
        size = start[leaves + 1] - start[leaves]
        end = np.cumsum(size)
        cells = np.arange(end[-1]) + np.repeat(start[leaves] - (end - size), size)
        used, code = np.unique(source[cells], return_inverse=True)
        shared = [0] + [_common(a, b) for a, b in zip(terms, terms[1:], strict=False)]
        tails = [t[n:] for t, n in zip(terms, shared, strict=True)]
        total = np.zeros(len(used), np.int64)
        np.add.at(total, code, count[cells])
        return {
            "lang": lang,
            "prefix": prefix,
            "leaves": len(terms),
            "names": [names[i] for i in used],
            "shared": np.array(shared, np.uint32).tobytes(),
            "sizes": np.array([len(t) for t in tails], np.uint32).tobytes(),
            "tails": b"".join(tails),
            "docs": docs[leaves].tobytes(),
            "ends": end.astype(np.int64).tobytes(),
            "source": code.astype(np.int32).tobytes(),
            "counts": count[cells].tobytes(),
            "totals": [{"source": names[i], "n": int(n)} for i, n in zip(used, total, strict=True)],
        }


def _common(a: bytes, b: bytes) -> int:
    n = 0
    for x, y in zip(a, b, strict=False):
        if x != y:
            break
        n += 1
    return n


def _terms(row: dict) -> list[bytes]:
    """The terms of a written subtrie."""
    out, last, at, tails = [], b"", 0, row["tails"]
    for n, size in zip(np.frombuffer(row["shared"], np.uint32).tolist(), np.frombuffer(row["sizes"], np.uint32).tolist(), strict=True):
        last = last[:n] + tails[at : at + size]
        at += size
        out.append(last)
    return out


def _cells(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place of the term, index in names, count) of a written subtrie."""
    size = np.diff(np.frombuffer(row["ends"], np.int64), prepend=0)
    return np.repeat(np.arange(len(size)), size), np.frombuffer(row["source"], np.int32).astype(np.int64), np.frombuffer(row["counts"], np.int64)


def _merge(into: Counted, row: dict) -> None:
    add = into.trie.add
    leaves = np.fromiter((add(t) for t in _terms(row)), np.int64, row["leaves"])
    at, source, count = _cells(row)
    names = np.array([into.source(s) for s in row["names"]], np.int64)
    into.add(leaves, np.frombuffer(row["docs"], np.int64), at, names[source], count)


def _words(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """(row of each term occurrence, its index in the list, the different terms) of a run of texts."""
    n = len(data)
    letter = np.zeros(n + 1, bool)
    letter[:n] = _LETTER[data]
    edge = np.zeros(n + 1, bool)
    edge[at] = True
    first = np.flatnonzero(letter & (edge | ~np.concatenate(([False], letter[:-1]))))
    end = np.flatnonzero(letter[:-1] & (edge[1:] | ~letter[1:])) + 1
    size, low = end - first, np.concatenate((_LOWER[data], np.zeros(8, np.uint8)))
    digit = np.ndarray(n + 1, ">u8", low, strides=(1,))
    digits, raw, terms = -(-size // 8), low.tobytes(), []
    code = np.empty(len(first), np.int64)
    for k in np.unique(digits).tolist():
        own = np.flatnonzero(digits == k)
        if k > 8:
            words = [raw[a:b] for a, b in zip(first[own].tolist(), end[own].tolist(), strict=True)]
            c, distinct = pd.factorize(np.array([*words, None], object)[:-1])
            distinct = list(distinct)
        else:
            c = np.zeros(len(own), np.int64)
            for j in range(k):
                d = digit[first[own] + 8 * j].astype(np.uint64) & _MASK[np.minimum(size[own] - 8 * j, 8)]
                d, values = pd.factorize(d)
                c = pd.factorize(c * len(values) + d)[0] if j else d
            place = np.empty(c.max() + 1, np.int64)
            place[c[::-1]] = own[::-1]
            distinct = [raw[a:b] for a, b in zip(first[place].tolist(), end[place].tolist(), strict=True)]
        code[own] = c + len(terms)
        terms += distinct
    return np.searchsorted(at, first, "right") - 1, code, terms


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Subtries of the tries of a partition, by language and prefix."""
    tries: dict[str, Counted] = {}
    for batch in batches:
        langs, sources = (batch.column(c).dictionary_encode() for c in ("lang", "source"))
        lang_of, source_of = (c.indices.to_numpy().astype(np.int64) for c in (langs, sources))
        lang_names, source_names = langs.dictionary.to_pylist(), sources.dictionary.to_pylist()
        for lo, hi, data, at in tokens.chunks(batch.column("text"), CHUNK):
            row, code, terms = _words(data, at)
            for k in np.unique(lang_of[lo:hi]).tolist():
                own = np.flatnonzero(lang_of[lo + row] == k)
                if not len(own):
                    continue
                trie = tries.setdefault(lang_names[k], Counted())
                used, c = np.unique(code[own], return_inverse=True)
                once = np.unique(c * (hi - lo) + row[own]) // (hi - lo)
                cell, n = np.unique(c * len(source_names) + source_of[lo + row[own]], return_counts=True)
                names = np.full(len(source_names), -1)
                for s in np.unique(cell % len(source_names)).tolist():
                    names[s] = trie.source(source_names[s])
                add = trie.trie.add
                leaves = np.fromiter((add(terms[i]) for i in used.tolist()), np.int64, len(used))
                trie.add(leaves, np.bincount(once, minlength=len(used)), cell // len(source_names), names[cell % len(source_names)], n)
            if sum(t.trie.n for t in tries.values()) > LEAVES:
                yield from _written(tries)
                tries = {}
    yield from _written(tries)


def _written(tries: dict[str, Counted]) -> Iterator[pa.RecordBatch]:
    for lang, trie in tries.items():
        yield from _batches(trie.rows(lang, DEPTH), _SUBTRIE)


def _batches(rows: Iterator[dict], ddl: str, size: int = 500) -> Iterator[pa.RecordBatch]:
    kinds = {"string": pa.string(), "binary": pa.binary(), "long": pa.int64(), "array<string>": pa.list_(pa.string())}
    kinds["array<struct<source:string,n:long>>"] = pa.list_(pa.struct([("source", pa.string()), ("n", pa.int64())]))
    schema = pa.schema([(c, kinds[k]) for c, k in (f.split(" ", 1) for f in ddl.split(", "))])
    own = []
    for row in rows:
        own.append(row)
        if len(own) == size:
            yield pa.RecordBatch.from_pylist(own, schema)
            own = []
    if own:
        yield pa.RecordBatch.from_pylist(own, schema)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for k in range(batch.num_rows):
            yield batch.slice(k, 1).to_pylist()[0]


def _longer_prefixes(tries: DataFrame, scratch: Scratch, heavy: int) -> DataFrame:
    """The subtries, with prefixes of more than ``heavy`` leaves in all of them cut at longer prefixes."""
    for depth in range(DEPTH, 16 * DEPTH, DEPTH):
        large = tries.where(F.length("prefix") == depth).groupBy("lang", "prefix").agg(F.sum("leaves").alias("n")).where(F.col("n") > heavy).select("lang", "prefix")
        large = scratch.save(large, f"heavy{depth}")
        if large.isEmpty():
            break

        def cut(batches: Iterator[pa.RecordBatch], depth: int = depth + DEPTH) -> Iterator[pa.RecordBatch]:
            for row in _rows(batches):
                one = Counted()
                _merge(one, row)
                yield from _batches(one.rows(row["lang"], depth), _SUBTRIE)

        rest = tries.join(large, ["lang", "prefix"], "left_anti").select(tries.columns)
        again = tries.join(large, ["lang", "prefix"], "left_semi").select(tries.columns)
        tries = scratch.save(rest.unionAll(again.mapInArrow(cut, _SUBTRIE)), f"tries{depth}")
    return tries


def kept_terms(docs: DataFrame, scratch: Scratch, heavy: int = HEAVY) -> DataFrame:
    """Merged subtries of the terms that each language keeps, with their occurrences by source in ``totals``."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, trie = None, None
        for row in _rows(batches):
            if (row["lang"], row["prefix"]) != now:
                if trie:
                    yield from _batches(trie.rows(now[0], 0, MIN_DOCS, now[1]), _MERGED)
                now, trie = (row["lang"], row["prefix"]), Counted()
            _merge(trie, row)
        if trie:
            yield from _batches(trie.rows(now[0], 0, MIN_DOCS, now[1]), _MERGED)

    tries = scratch.save(docs.mapInArrow(_count, _SUBTRIE), "tries")
    dealt = _longer_prefixes(tries, scratch, heavy).repartitionByRange("lang", "prefix").sortWithinPartitions("lang", "prefix")
    return scratch.save(dealt.mapInArrow(merge, _MERGED), "kept")


def _p(count: np.ndarray, whole: np.ndarray | int) -> np.ndarray:
    """1 + floor(1000**SCALE_STEPS (count + 1) / whole), digit by digit so that nothing overflows."""
    rest, out = count + 1, np.zeros(count.shape, np.int64)
    for _ in range(SCALE_STEPS + 1):
        out = out * 1000 + rest // whole
        rest = rest % whole * 1000
    return out + 1


class _Best:
    """The terms of highest value of a group; of equal values the first in the order of bytes."""

    def __init__(self):
        self.rows: list[tuple[int, bytes]] = []

    def offer(self, value: np.ndarray, terms: list[bytes], at: np.ndarray) -> None:
        if len(self.rows) == BEST:
            ok = np.flatnonzero(value >= -self.rows[-1][0])
            value, at = value[ok], at[ok]
        if len(value):
            order = np.argsort(-value, kind="stable")[:BEST]
            self.rows = sorted(self.rows + [(-int(value[k]), terms[at[k]]) for k in order.tolist()])[:BEST]


def _scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of f for pairs of sources, and the best terms of each group, of a partition's terms."""
    sums: dict[tuple, np.ndarray] = {}
    best: dict[tuple, _Best] = {}
    names: dict[str, list[str]] = {}

    def out() -> Iterator[pa.RecordBatch]:
        for (lang, slab), m in sums.items():
            own = names[lang]
            for k, line in enumerate(m):
                yield _table([lang] * len(own), [own[slab * SLAB + k]] * len(own), "pair", own, line)
        for (lang, source), b in best.items():
            yield _table([lang] * len(b.rows), [source] * len(b.rows), "term", [t.decode() for _, t in b.rows], [-v for v, _ in b.rows])
        sums.clear()
        best.clear()

    for row in _rows(batches):
        lang, slab, sources = row["lang"], row["slab"], [s["source"] for s in row["sources"]]
        whole = np.array([s["n"] for s in row["sources"]], np.int64) + row["kept"]
        every = int(whole.sum()) - (len(sources) - 1) * row["kept"]
        names[lang] = sources
        lines = range(slab * SLAB, min((slab + 1) * SLAB, len(sources)))
        if (lang, slab) not in sums and sum(m.size for m in sums.values()) + len(lines) * len(sources) > 4 * CELLS:
            yield from out()
            names[lang] = sources
        m = sums.setdefault((lang, slab), np.zeros((len(lines), len(sources)), np.int64))
        index = {s: k for k, s in enumerate(sources)}
        code = np.array([index[s] for s in row["names"]], np.int64)
        at, source, count = _cells(row)
        source, terms = code[source], _terms(row)
        step = max(1, CELLS // len(sources))
        for lo in range(0, len(terms), step):
            hi = min(lo + step, len(terms))
            own = slice(*np.searchsorted(at, [lo, hi]))
            c = np.zeros((hi - lo, len(sources)), np.int64)
            c[at[own] - lo, source[own]] = count[own]
            p, q = _p(c, whole), _p(c.sum(axis=1), every)
            for k, g in enumerate(lines):
                d = p[:, g : g + 1] - p
                m[k] += (d * d // p).sum(axis=0)
                more = np.flatnonzero((c[:, g] > 0) & (p[:, g] > q))
                if len(more):
                    d = p[more, g] - q[more]
                    best.setdefault((lang, sources[g]), _Best()).offer(d * d // q[more], terms, lo + more)
    yield from out()


def _table(lang: list, source: list, part: str, item: list, value) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(source, pa.string()), pa.array([part] * len(lang)), pa.array(item, pa.string()), pa.array(value, pa.int64())], ["lang", "source", "part", "item", "value"])


def source_divergence(docs: DataFrame, heavy: int = HEAVY) -> DataFrame:
    """lang, source, part, item, value, rank: how each source of ``docs(text, lang, source)`` differs from others.

    Part ``pair`` has every other source of the language with the sum of f over all kept terms; part ``term`` the
    ``BEST`` terms of the group that are more frequent in it than in the language. Ranks go by value, falling, then item.
    """
    scratch = Scratch(docs.sparkSession)
    text = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")]
    rows = docs.select(*text)
    kept = kept_terms(rows, scratch, heavy)
    groups = rows.groupBy("lang", "source").count().drop("count")
    n = kept.select("lang", F.explode("totals").alias("t")).groupBy("lang", "t.source").agg(F.sum("t.n").alias("n"))
    v = kept.groupBy("lang").agg(F.sum("leaves").alias("kept"))
    groups = scratch.save(groups.join(n, ["lang", "source"], "left").select("lang", "source", F.coalesce("n", F.lit(0)).alias("n")), "groups")
    every = groups.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("source", "n"))).alias("sources")).join(v, "lang")
    every = scratch.save(every.select("lang", "sources", "kept", F.explode(F.sequence(F.lit(0), ((F.size("sources") - 1) / SLAB).cast("int"))).alias("slab")), "every")
    scored = scratch.save(kept.drop("totals", "docs").join(every, "lang").mapInArrow(_scores, "lang string, source string, part string, item string, value long"), "scored")
    sums = scored.where("part = 'pair' and source <> item").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    pairs = groups.select("lang", "source").join(groups.select("lang", F.col("source").alias("item")), "lang").where("source <> item")
    pairs = pairs.join(sums, ["lang", "source", "item"], "left").select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).alias("value"))
    order = W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    best = scored.where("part = 'term'").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= BEST)
    return pairs.withColumn("rank", F.row_number().over(order)).unionByName(best).select("lang", "source", "part", "item", "value", "rank")
