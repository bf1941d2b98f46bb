"""Repeated byte strings, source divergence and whitening against brute force and on awkward rows."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ledgerlark.llm import divergence, suffixes, whitening

from .test_text_operators import SCHEMA, corpus, frame

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def repeat_rows(length: int) -> list:
    rng = random.Random(length)
    rows = corpus(n=30)
    base = "".join(rng.choices("äbc dé", k=400))
    for k in range(40):  # pieces of a common text cut at any byte, between own texts; runs of one character
        at = rng.randrange(300)
        own = "".join(rng.choices("xyzwvu ", k=rng.randrange(60)))
        rows.append((20_000 + k, own + base[at : at + rng.randrange(20, 100)] + own[:10] + "a" * rng.randrange(90)))
    rng.shuffle(rows)
    return rows


def brute_spans(rows: list, length: int) -> Counter:
    least: dict[bytes, float] = {}
    texts = [(i, float("inf") if i is None else i, (t or "").encode()) for i, t in rows]
    for _, rank, b in texts:
        for s in range(len(b) - length + 1):
            least[b[s : s + length]] = min(rank, least.get(b[s : s + length], rank))
    out = Counter()
    for i, rank, b in texts:
        gone = np.zeros(len(b) + 2, int)
        for s in range(len(b) - length + 1):
            if least[b[s : s + length]] < rank:
                gone[s + 1] += 1
                gone[s + length + 1] -= 1
        mark = np.concatenate((np.cumsum(gone)[:-1] > 0, [False])).astype(int)
        first, end = np.flatnonzero(np.diff(mark) == 1), np.flatnonzero(np.diff(mark) == -1)
        kept = bytes(x for k, x in enumerate(b) if not mark[k + 1])
        out[(i, len(b), tuple(zip(first.tolist(), end.tolist(), strict=True)), kept)] += 1
    return out


@pytest.mark.parametrize(("length", "block"), [(50, 3000), (24, 700), (50, None)])
def test_repeated_spans_match_brute_force(spark, length, block):
    rows = repeat_rows(length)
    found = suffixes.repeated_spans(frame(spark, rows).repartition(3), length, block).collect()
    got = Counter((r.doc_id, r.n_bytes, tuple((s.start, s.end) for s in r.spans), bytes(r.kept)) for r in found)
    assert got == brute_spans(rows, length)


def test_anchors_are_equal_for_equal_strings_across_runs(monkeypatch):
    """Runs of bytes that are looked at one after another give the anchors of the whole."""
    rng = random.Random(1)
    text = pa.array(["".join(rng.choices("ab", k=5000)) + "c" * 700, "", "x" * 49, "y" * 50])
    whole = suffixes.Block(text, np.arange(4), 50)
    monkeypatch.setattr(suffixes, "_SPAN", 97)
    cut = suffixes.Block(text, np.arange(4), 50)
    for name in ("place", "first", "last", "key", "owner"):
        assert (getattr(whole, name) == getattr(cut, name)).all()
    assert (whole.last - whole.first + 1).sum() == 5700 - 49 + 1


def test_empty_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert suffixes.repeated_spans(empty).count() == 0
    assert divergence.source_divergence(empty).count() == 0
    nothing = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert whitening.whitened_vectors(nothing).count() == 0


def brute_divergence(rows: list) -> dict:
    counts, docs, groups = defaultdict(Counter), defaultdict(Counter), set()
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        terms = ["".join(c.lower() if c < "\x80" else c for c in t) for t in TERM.findall(text or "")]
        counts[lang, source].update(terms)
        docs[lang].update(set(terms))
    out = {}
    for lang in {g[0] for g in groups}:
        kept = [t for t, n in docs[lang].items() if n >= 3]
        own = sorted(s for g, s in groups if g == lang)
        every = sum((counts[lang, s] for s in own), Counter())

        def p(c, kept=kept):
            n = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 1) // (n + len(kept)) for t in kept}

        q, by = p(every), {s: p(counts[lang, s]) for s in own}
        for s in own:
            pairs = [(-sum((by[s][t] - by[o][t]) ** 2 // by[o][t] for t in kept), o.encode()) for o in own if o != s]
            terms = [(-((by[s][t] - q[t]) ** 2 // q[t]), t.encode()) for t in kept if counts[lang, s][t] and by[s][t] > q[t]]
            for part, items in (("pair", pairs), ("term", sorted(terms)[: divergence.BEST])):
                for rank, (value, item) in enumerate(sorted(items), 1):
                    out[lang, s, part, item.decode()] = (-value, rank)
    return out


@pytest.mark.parametrize("tight", [False, True])
def test_source_divergence_matches_brute_force(spark, monkeypatch, tight):
    rng = random.Random(5)
    words = [*("".join(rng.choices("abcdé", k=rng.randint(1, 12))) for _ in range(400)), "ab" * 40, "ab" * 41, "中文" * 30, "É", "ÀB", "nul\x00nul", "sieben7acht"]
    weights = [1 / (k + 1) for k in range(len(words))]
    rows = [(rng.choice(["en", "de", None]), rng.choice(["s1", "s2", "\U0001f600", "￿", None, ""]), " ".join(rng.choices(words, weights, k=rng.randrange(60)))) for _ in range(200)]
    rows += [("xx", "a", "rare"), ("xx", "b", None), ("en", "quiet", "12 34"), ("en", "s1", "The the THE " * 3000), ("en", "s1", "z" * 100_000)] + [("de", "s2", words[0])] * 300
    if tight:
        monkeypatch.setattr(divergence, "LEAVES", 50)
        monkeypatch.setattr(divergence, "CHUNK", 2000)
        monkeypatch.setattr(divergence, "CELLS", 64)
        monkeypatch.setattr(divergence, "SLAB", 2)
        monkeypatch.setattr(divergence, "BEST", 7)
    docs = spark.createDataFrame([(1, t, l, s, "x", 3) for l, s, t in rows], "doc_id long, text string, lang string, source string, prefix string, leaves int").repartition(5)
    found = divergence.source_divergence(docs, heavy=60 if tight else divergence.HEAVY).collect()
    got = {(r.lang, r.source, r.part, r["item"]): (r.value, r.rank) for r in found}
    assert len(got) == len(found)
    assert got == brute_divergence(rows)


def test_trie_walks_in_the_order_of_bytes():
    rng = random.Random(2)
    terms = {"".join(rng.choices("abé中", k=rng.randint(1, 9))).encode() for _ in range(2000)}
    trie = divergence.Trie()
    leaves = {t: trie.add(t) for t in rng.sample(sorted(terms), len(terms))}
    assert all(trie.add(t) == leaves[t] for t in terms) and trie.n == len(terms)
    assert list(trie.walk()) == [(t, leaves[t]) for t in sorted(terms)]


def test_probabilities_do_not_overflow():
    count, whole = np.array([10**15, 0, 9 * 10**14]), 9 * 10**15
    assert divergence._p(count, whole).tolist() == [1 + 10**9 * (c + 1) // whole for c in count.tolist()]


def vectors() -> list:
    rng = np.random.default_rng(4)
    base = rng.normal(size=(12, 12))
    rows = [(k, [float(v) for v in np.float32(rng.normal(size=12) @ base * 3)]) for k in range(300)]
    rows += [(7, rows[7][1]), (None, rows[8][1]), (301, [1.5] * 5), (302, []), (303, [-1e9] + [0.25] * 11)]
    return rows + [(400, None), (401, [float("nan")] * 12), (402, [1.0, None]), (403, [float("inf")] + [0.0] * 11)]


def test_whitening_matches_exact_arithmetic(spark, monkeypatch):
    rows = vectors()
    monkeypatch.setattr(whitening, "BLOCK", 32)
    df = spark.createDataFrame([(i, v, 1, 2.0) for i, v in rows], "vec_id long, embedding array<float>, n int, whitened double").repartition(4)
    found = whitening.whitened_vectors(df, components=5).collect()
    x = [[int(np.floor(np.float64(np.float32(c)) * 1024)) + 100_000 for c in [*v, *[0.0] * (12 - len(v))]] for _, v in rows[:305]]
    n, sums = len(x), [sum(c) for c in zip(*x, strict=True)]
    assert Counter((r.vec_id, r.n, int(r.deviation)) for r in found) == Counter((rows[k][0], n, sum((n * a - s) ** 2 for a, s in zip(x[k], sums, strict=True))) for k in range(n))
    exact = [[Fraction(sum((n * r[i] - sums[i]) * (n * r[j] - sums[j]) for r in x), n**3) for j in range(12)] for i in range(12)]
    value, vector = np.linalg.eigh(np.array([[float(c) for c in line] for line in exact]))
    centred = np.array([[float(Fraction(n * a - s, n)) for a, s in zip(r, sums, strict=True)] for r in x])
    want = centred @ vector[:, ::-1][:, :5] / np.sqrt(value[::-1][:5])
    by_id = {rows[k][0]: want[k] for k in range(n)}
    got = np.array([r.whitened for r in found])
    sign = np.sign((got * np.array([by_id[r.vec_id] for r in found])).sum(axis=0))
    assert np.abs(got * sign - np.array([by_id[r.vec_id] for r in found])).max() < 1e-6
    trace = float(sum(exact[k][k] for k in range(12)))
    assert np.allclose(found[0].explained, value[::-1][:5] / trace, rtol=1e-9)
    assert max(r.identity_error for r in found) < 1e-6


def test_digit_products_are_exact():
    rng = np.random.default_rng(1)
    x = rng.integers(-(2**61), 2**61, (50, 4))
    x[0] = [2**61 - 1, -(2**61), 0, 32768]
    sums: dict[int, np.ndarray] = {}
    whitening.digit_products(x, sums)
    got = [[sum(int(m[i, j]) << (16 * s) for s, m in sums.items()) for j in range(4)] for i in range(4)]
    assert got == [[sum(int(a) * int(b) for a, b in zip(x[:, i], x[:, j], strict=True)) for j in range(4)] for i in range(4)]


def test_whitening_of_equal_vectors_is_empty(spark):
    same = spark.createDataFrame([(k, [1.0, 2.0]) for k in range(4)], "vec_id long, embedding array<double>")
    rows = whitening.whitened_vectors(same).collect()
    assert [len(r.whitened) for r in rows] == [0] * 4 and [int(r.deviation) for r in rows] == [0] * 4


def test_flat_directions_have_no_component(spark):
    rows = [(k, [float(k), 2.0 * k, 5.0]) for k in range(20)]
    found = whitening.whitened_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    assert found.select(F.size("whitened")).distinct().collect() == [(1,)]
