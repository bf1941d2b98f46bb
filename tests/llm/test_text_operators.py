"""Operators on texts against brute force and on awkward rows: nulls, empty and very long texts, repeats, other columns."""

from __future__ import annotations

import hashlib
import itertools
import math
import random
import re
import time
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from ledgerlark.llm import chat, decontamination, jaccard, lm, mixing, pii, quality, sharding, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Extra columns with names that operators use inside.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, shard string, copies int, cls string, score string, row string"


def corpus(seed: int = 3, n: int = 60) -> list[tuple[int | None, str | None]]:
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 6))) for _ in range(300)]
    texts = [" ".join(rng.choices(vocabulary, k=rng.randint(1, 120))) for _ in range(n)]
    for k in range(15):  # near copies: a few words replaced, added or taken away
        words = texts[k].split()
        for _ in range(max(1, len(words) // 40)):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        texts.append(" ".join(words))
    passage = " ".join(rng.choices(vocabulary, k=60))
    texts += [f"{passage} {rng.choice(vocabulary)} {' '.join(rng.choices(vocabulary, k=8))}" for _ in range(40)]
    texts += [texts[0], texts[0].upper(), "", "one", "one", "two words", " \t\n", " x É", "z" * 200000, "lange " * 30000]
    return [*((i, t) for i, t in enumerate(texts)), (10_000, None), (5, texts[5]), (5, texts[5]), (None, texts[6])]


def frame(spark, rows):
    full = [(i, t, "en" if (i or 0) % 3 else None, None if (i or 0) % 7 == 0 else f"s{(i or 0) % 4}", len(t or ""), "big", "x", 9, "c", "s", "r") for i, t in rows]
    return spark.createDataFrame(full, SCHEMA)


def lower(text: str) -> str:
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def words_of(text: str | None) -> list[str]:
    return WORD.findall(lower(text or ""))


def shingles(text: str | None) -> frozenset:
    w = words_of(text)
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def components(rows, linked):
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(range(len(rows)), 2):
        if linked(a, b):
            parent[root(a)] = root(b)
    groups = defaultdict(list)
    for k in range(len(rows)):
        groups[root(k)].append(k)
    return {k: g for g in groups.values() for k in g}


def test_jaccard_components_match_brute_force(spark):
    rows = corpus()
    sets = [shingles(t) for _, t in rows]
    group = components(rows, lambda a, b: bool(sets[a]) and bool(sets[b]) and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]))
    smallest = lambda k: min((rows[j][0] for j in group[k] if rows[j][0] is not None), default=None)
    expected = Counter((rows[k][0], len(sets[k]), smallest(k)) for k in range(len(rows)))
    got = Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.similarity_components(frame(spark, rows)).collect())
    assert got == expected
    assert sum(1 for k in group if len(group[k]) > 1) > 20


@pytest.mark.parametrize("seed", [10])
def test_jaccard_links_a_pair_under_boilerplate(spark, seed):
    """No class is plausible with the centre it shares most with, so only the later rounds can link the pair."""
    rng = random.Random(seed)
    unlike = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    passage = unlike(80)
    one = passage + unlike(20)
    near = [*one[:50], "other", *one[51:]]
    rows = list(enumerate(" ".join(t) for t in [one, near, *(passage + unlike(20) for _ in range(40))]))
    sets = [shingles(t) for _, t in rows]
    group = components(rows, lambda a, b: 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]))
    got = {r["doc_id"]: r["component_id"] for r in jaccard.similarity_components(frame(spark, rows)).collect()}
    assert got == {k: min(group[k]) for k in group} and got[1] == 0 and got[2] == 2


@pytest.mark.parametrize("seed", [1, 2])
def test_sent_ngrams_meet_for_every_similar_pair(seed):
    import numpy as np

    rng = np.random.default_rng(seed)
    met = 0
    for _ in range(600):
        n = int(rng.integers(1, 200))
        base = np.unique(rng.integers(1, 2**63, n).astype(np.uint64))
        drop = int(rng.integers(0, max(1, len(base) // 9 + 1)))
        other = np.unique(np.concatenate((base[drop:], rng.integers(1, 2**63, int(rng.integers(0, len(base) // 9 + 2))).astype(np.uint64))))
        both = len(np.intersect1d(base, other))
        if len(other) and len(base) + len(other) > 2 * both and 100 * both >= 80 * (len(base) + len(other) - both):
            met += 1
            hot = np.sort(rng.choice(base, int(rng.integers(0, len(base) + 1)), replace=False))
            a, b = (set(jaccard.sent_ngrams(s, 80, hot).tolist()) for s in (base, other))
            assert a & b, (len(base), len(other), both)
            assert jaccard._most_overlap(jaccard._bucket_counts(base), jaccard._bucket_counts(other)) >= both
    assert met > 100


def test_jaccard_groups_of_near_copies_match_brute_force(spark, monkeypatch):
    """Groups whose members are partly like their centre, partly only like each other, in several blocks."""
    monkeypatch.setattr(jaccard, "BLOCK", 16)
    monkeypatch.setattr(jaccard, "HOT", 8)
    rng = random.Random(21)
    word = lambda: f"w{rng.randrange(10**6)}"
    texts = []
    for _ in range(3):
        base = [word() for _ in range(120)]
        for _ in range(45):
            t = list(base)
            for at in rng.sample(range(120), rng.randint(0, 9)):
                t[at] = word()
            texts.append(" ".join(t))
    texts += [" ".join(word() for _ in range(n)) for n in range(1, 12) for _ in range(4)]
    texts += ["a b c d e f g h", "a b c d e f g h i", "a b c d e f", "b c d e f", "a b c d e f g h i j k l m", "a b c d e f g h i j k l m n"]
    rows = list(enumerate(texts))
    sets = [shingles(t) for _, t in rows]
    group = components(rows, lambda a, b: 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]))
    got = {r["doc_id"]: r["component_id"] for r in jaccard.similarity_components(frame(spark, rows)).collect()}
    assert got == {k: min(group[k]) for k in group}
    assert 3 < len({min(g) for g in group.values() if len(g) > 1}) < 60


def test_empty_tables(spark):
    none = frame(spark, [])
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    held = F.lit(False)
    assert jaccard.similarity_components(none).count() == 0
    assert lm.backoff_scores(none).count() == 0
    assert pii.find_personal_data(none).count() == 0
    assert sharding.assign_shards(none).count() == 0
    assert mixing.mix_copies(none).count() == 0
    assert quality.quality_scores(none, labels, held).count() == 0
    assert toxicity.toxicity_scores(none, labels, held).count() == 0
    items = spark.createDataFrame([], "item_id long, text string")
    assert decontamination.benchmark_matches(none, items).count() == 0
    assert chat.format_examples(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


@pytest.mark.parametrize("least", [1, 2])
def test_backoff_scores_match_brute_force(spark, least):
    rows = corpus(5, 40)
    docs = [words_of(t) for _, t in rows]
    counts = [Counter(tuple(w[i : i + n]) for w in docs for i in range(len(w) - n + 1)) for n in (1, 2, 3)]
    total = sum(counts[0].values())
    expected = Counter()
    for (i, _), w in zip(rows, docs, strict=True):
        micros = 0
        for k in range(len(w)):
            for n in range(min(3, k + 1), 0, -1):
                gram = tuple(w[k - n + 1 : k + 1])
                c = counts[n - 1][gram]
                if n == 1 or c >= least:
                    below = total if n == 1 else counts[n - 2][gram[:-1]]
                    micros += round((math.log(c / below) + math.log(0.4) * (min(3, k + 1) - n)) * 1e6)
                    break
        expected[i, len(w), micros if w else None] += 1
    got = Counter((r["doc_id"], r["n_words"], r["log_micros"]) for r in lm.backoff_scores(frame(spark, rows), least).collect())
    assert got == expected


def test_decontamination_finds_edited_items_and_nothing_else(spark):
    rng = random.Random(11)
    item = lambda n: [f"w{rng.randrange(5000)}" for _ in range(n)]
    items = [item(rng.randint(12, 60)) for _ in range(30)]
    docs, truth = [], set()
    for k, words in enumerate(items):
        x = list(words)
        for _ in range(len(x) // 12):
            x[rng.randrange(len(x))] = "changed"
        docs.append((k, " ".join(item(40) + x + item(33))))
        truth.add((k, k))
        docs.append((100 + k, " ".join(item(90))))
        docs.append((200 + k, " ".join(item(10) + words[: len(words) // 2] + item(10))))
    docs += [(900, None), (901, ""), (902, "word " * 50000), (903, " ".join(items[0]).upper().replace(" ", ", "))]
    truth.add((903, 0))
    bench = [(k, " ".join(w)) for k, w in enumerate(items)] + [(77, None), (78, ""), (79, "too short"), (80, None)]
    found = decontamination.benchmark_matches(frame(spark, docs), spark.createDataFrame(bench, "item_id long, text string")).collect()
    assert {(r["doc_id"], r["item_id"]) for r in found} <= truth
    assert len(found) >= 0.95 * len(truth)
    assert all(r["distance"] <= 0.2 * r["words"] for r in found)


@pytest.mark.parametrize("percent", [0, 10, 15, 20])
def test_decontamination_misses_no_match(spark, percent):
    """Every planted item of 5 to 600 words that brute force finds within a fifth of its words is found, at any place."""
    import numpy as np

    rng = random.Random(percent)
    word = lambda: f"w{rng.randrange(3000)}"
    items, docs, truth = [], [], set()
    for n in [*range(5, 16), *range(5, 16), 19, 20, 24, 25, 40, 41, 60, 99, 160, 200, 290, 500, 600, 600]:
        item = [word() for _ in range(n)]
        edited = list(item)
        places = range(n // 5) if n == 600 and percent == 20 else rng.sample(range(n), n * percent // 100)
        for at in sorted(places, reverse=True):
            kind = 0 if n == 600 and percent == 20 else rng.randrange(3)
            if kind == 0:
                del edited[at]
            elif kind == 1:
                edited[at] = "changed"
            else:
                edited.insert(at, "added")
        k = len(items)
        items.append(item)
        docs.append((k, " ".join([*(word() for _ in range(rng.randint(0, 23))), *edited, *(word() for _ in range(rng.randint(0, 23)))])))
    number: dict[str, int] = {}
    coded = lambda words: np.array([number.setdefault(w, len(number)) for w in words], np.uint64)
    for k, item in enumerate(items):
        for d, t in docs:
            if decontamination.edit_match(coded(item), coded(t.split()))[0] <= len(item) // 5:
                truth.add((d, k))
    assert {(k, k) for k in range(len(items))} <= truth
    bench = [(k, " ".join(w)) for k, w in enumerate(items)]
    found = decontamination.benchmark_matches(frame(spark, docs), spark.createDataFrame(bench, "item_id long, text string")).collect()
    assert {(r["doc_id"], r["item_id"]) for r in found} == truth


@pytest.mark.parametrize("percent", [8, 15, 20])
@pytest.mark.parametrize("kind", ["replaced", "added", "removed", "mixed", "spaced", "head"])
def test_decontamination_recall(kind, percent):
    """Items of 1 to 400 words with up to the given share of edits, among them evenly spaced ones, which leave short runs only."""
    import numpy as np
    import pyarrow as pa

    rng = random.Random(f"{kind}{percent}")
    word = lambda: f"w{rng.randrange(5000)}"
    items, texts = [], []
    for n in [*range(1, 41), *range(1, 41), 60, 60, 99, 150, 200, 300, 400, 400]:
        item = [word() for _ in range(n)]
        edits = min(n // 5, n * percent // 100)
        places = {"head": range(edits), "spaced": [(j + 1) * n // (edits + 1) for j in range(edits)]}.get(kind) or rng.sample(range(n), edits)
        edited = list(item)
        for at in sorted(places, reverse=True):
            how = {"head": "removed", "spaced": "replaced", "mixed": rng.choice(["replaced", "added", "removed"])}.get(kind, kind)
            edited[at : at + (how != "added")] = [] if how == "removed" else [word()]
        items.append(item)
        texts.append(" ".join([*(word() for _ in range(rng.randint(0, 40))), *edited, *(word() for _ in range(rng.randint(0, 40)))]))
    hashed = [decontamination.word_hashes(np.frombuffer(" ".join(t).encode(), np.uint8), np.array([0, len(" ".join(t))]))[0] for t in items]
    block = decontamination._Items([(k, h.tobytes()) for k, h in enumerate(hashed)])
    found = {(r[0], r[1]) for r in decontamination._matches(block, pa.array(texts))}
    assert sum((k, k) in found for k in range(len(items))) >= 0.99 * len(items)


def test_decontamination_searches_short_items_on_request(spark):
    docs = frame(spark, [(0, "one two three"), (1, "two, THREE four"), (2, "three two"), (3, "")])
    bench = spark.createDataFrame([(7, "two three"), (8, "four"), (9, "five six"), (10, "one two three four five")], "item_id long, text string")
    pairs = lambda df: {(r["doc_id"], r["item_id"]) for r in df.collect()}
    assert pairs(decontamination.benchmark_matches(docs, bench)) == set()
    assert pairs(decontamination.benchmark_matches(docs, bench, shortest=1)) == {(0, 7), (1, 7), (1, 8)}
    assert {r["item_id"] for r in decontamination.short_items(bench).collect()} == {7, 8, 9}


def test_ftrl_matches_a_plain_solver():
    """Per-coordinate updates written out one by one, in the same order of rows."""
    import numpy as np

    rng = np.random.default_rng(2)
    rows = [np.unique(rng.integers(0, 300, int(rng.integers(0, 30)))) for _ in range(150)]
    y = np.array([float(7 in r or 11 in r) for r in rows])
    w, b = toxicity.ftrl(rows, y)
    alpha, beta, l1, l2 = toxicity.ALPHA, toxicity.BETA, toxicity.L1, toxicity.L2
    z, n = defaultdict(float), defaultdict(float)

    def weight(i):
        if i == "b":
            return -z[i] * alpha / (beta + math.sqrt(n[i]))
        return 0.0 if abs(z[i]) <= l1 else -(z[i] - math.copysign(l1, z[i])) / ((beta + math.sqrt(n[i])) / alpha + l2)

    order = np.random.default_rng(11)
    for _ in range(toxicity.EPOCHS):
        for k in order.permutation(len(rows)):
            names = [*rows[k].tolist(), "b"]
            ws = {i: weight(i) for i in names}
            g = 1 / (1 + math.exp(-sum(ws.values()))) - y[k]
            for i in names:
                sigma = (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / alpha
                z[i] += g - sigma * ws[i]
                n[i] += g * g
    assert np.allclose([w[i] for i in range(300)], [weight(i) for i in range(300)]) and math.isclose(b, weight("b"), rel_tol=1e-9)
    assert 0 < np.count_nonzero(w) < 300


def test_dual_coordinate_descent_matches_a_plain_solver():
    """The hinge-loss optimum found by projected gradient steps on the whole dual."""
    import numpy as np

    rng = np.random.default_rng(3)
    rows = [np.unique(rng.integers(0, 40, int(rng.integers(1, 12)))) for _ in range(80)]
    r = rng.normal(size=40)
    y = np.where([r[i].sum() + rng.normal() > 0 for i in rows], 1.0, -1.0)
    c = rng.uniform(0.3, 1.5, 80)
    w, b = quality.dual_coordinate_descent(rows, y, r, c, 400)
    x = np.zeros((80, 41))
    for k, i in enumerate(rows):
        x[k, i] = r[i] / np.sqrt(r[i] @ r[i])
    x[:, 40] = 1
    q = (x @ x.T) * np.outer(y, y)
    a, step = np.zeros(80), 1 / np.linalg.eigvalsh(q).max()
    for _ in range(20000):
        a = np.clip(a + step * (1 - q @ a), 0, c)
    best = x.T @ (a * y)
    loss = lambda u: u @ u / 2 + (c * np.maximum(0, 1 - y * (x @ u))).sum()
    assert abs(loss(np.append(w, b)) - loss(best)) <= 1e-3 * loss(best)
    assert abs(loss(best) - (a.sum() - a @ q @ a / 2)) <= 1e-3 * loss(best)


def test_log_count_ratios_match_brute_force(spark):
    import numpy as np

    texts = [(k, t) for k, (_, t) in enumerate(corpus(8, 20))][:40]
    labels = [(k, k % 2, 0) for k in range(40) if k % 5]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = quality.log_count_ratios(docs, known, F.col("doc_id") % 4 == 2)
    count, size = [Counter(), Counter()], [0, 0]
    for k, y, _ in labels:
        if k % 4 != 2:
            raw = np.frombuffer((texts[k][1] or "").encode(), np.uint8)
            size[y] += 1
            count[y].update(next(quality._features(raw, np.array([0, len(raw)]))).tolist())
    expected = [math.log((count[1][f] + 1) / (size[1] + 2) / ((count[0][f] + 1) / (size[0] + 2))) for f in range(1 << quality.BITS)]
    assert np.allclose(got, expected, atol=1e-6)


def test_personal_data_spans_are_added(spark):
    """Spans that no base rule takes, but that look like those it takes, are found; numbers in clean texts are left alone."""
    rng = random.Random(12)
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 8)))
    digit = lambda n: "".join(rng.choices("0123456789", k=n))
    rows = []
    for k in range(600):
        w = [word() for _ in range(20)]
        w[5] = f"contact {word()}.{word()}@{word()}.com"
        w[9] = f"phone +1 ({digit(3)}) 555-{digit(4)}"
        w[14] = f"order {digit(9)}"
        rows.append((k, " ".join(w)))
    hidden = f"please contact {word()}.{word()}(at){word()}.com soon"
    rows += [(1000, hidden), (1001, "plain words and 12 numbers 2024 only"), (1002, "long " + "123 " * 30000), (1003, None)]
    got = {r["doc_id"]: r for r in pii.find_personal_data(frame(spark, rows)).collect()}
    assert not got[1000]["base"] and [hidden[s["start"] : s["end"]] for s in got[1000]["all"]] == [hidden.split()[2]]
    assert not got[1001]["all"] and not got[1003]["all"]
    assert all(set(map(tuple, r["base"])) <= set(map(tuple, r["all"])) for r in got.values())
    assert sum(len(got[k]["all"]) for k in range(600)) <= 1.1 * sum(len(got[k]["base"]) for k in range(600))


def test_secrets_are_found_by_name_and_by_format(spark):
    """Tokens with a name before them, and those of the same format without one; other long runs are left alone."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 8)))
    token = lambda: "".join(rng.choices("0123456789abcdef", k=40))
    rows, planted, clean = [], {}, set()
    for k in range(500):
        w = [word() for _ in range(12)]
        secret = token()
        if k % 30 == 0:
            w[6] = secret
        elif k % 5 < 4:
            w[6] = rng.choice(['token = "{}"', "api_key: {}", "password={}"]).format(secret)
        else:
            w[6], secret = rng.choice(["word" * 9, "2024-01-02T10-11-12-000000", "IMG_2024_PARTY_IN_THE_PARK", "see/path/of/some/file/v2"]), None
            clean.add(k)
        rows.append((k, "é " + " ".join(w)))
        planted[k] = secret
    got = {r["doc_id"]: r for r in pii.find_personal_data(frame(spark, rows)).collect()}
    for k, secret in planted.items():
        found = [rows[k][1][s["start"] : s["end"]] for s in got[k]["all"] if s["kind"] == pii.SECRET]
        assert found == ([secret] if secret else []), (k, found)
        assert not got[k]["base"] or all(s["kind"] < pii.SECRET for s in got[k]["base"])
    assert len(clean) == 100


def test_every_base_span_is_proposed(spark):
    """Whole, on the driver's texts: of what no generator proposes, the trees could learn nothing."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = docs.select(pii._spans(F.col("text")).alias("base"), pii._proposals(F.col("text")).alias("p")).where("size(base) > 0").collect()
    base = {(k, tuple(s)) for k, r in enumerate(rows) for s in r["base"]}
    proposed = {(k, (p["start"], p["kind"], p["end"])) for k, r in enumerate(rows) for p in r["p"]}
    assert len(base) > 50 and len(base & proposed) >= 0.99 * len(base)
    assert {s[1] for _, s in base & proposed} == {0, 1, 2, 3}


def test_personal_data_in_texts_of_many_matches(spark):
    """More matches than a block holds, and a telephone number that the base rule takes with the digits that follow it."""
    text = "é " + " ".join(f"a{k}@b.org 10.0.{k % 300}.7" for k in range(700))
    found = pii.find_personal_data(frame(spark, [(1, text), (2, text * 2)])).collect()
    for r in found:
        assert [tuple(s) for s in r["base"]] == base_spans(text * r["doc_id"])
        assert {tuple(s) for s in r["base"]} <= {tuple(s) for s in r["all"]}


def test_personal_data_without_quadratic_work(spark):
    """Time grows about in proportion to the matches of one text."""
    sizes, seconds = (4000, 32000), []
    for n in sizes:
        docs = spark.createDataFrame([(1, "x@y.zz 10.0.0.1 " * n)], "doc_id long, text string")
        start = time.perf_counter()
        (row,) = pii.find_personal_data(docs).select(F.size("base").alias("n")).collect()
        seconds.append(time.perf_counter() - start)
        assert row["n"] == 2 * n
    assert seconds[1] < 24 * seconds[0] + 5


def test_edit_match_is_exact():
    import numpy as np

    rng = np.random.default_rng(0)
    for _ in range(200):
        a, b = (rng.integers(0, 4, int(rng.integers(1, 9))).astype(np.uint64) for _ in range(2))
        best = min((_distance(a, b[i:j]), 0) for i in range(len(b) + 1) for j in range(i, len(b) + 1))[0]
        dist, lo, hi = decontamination.edit_match(a, b)
        assert dist == best == _distance(a, b[lo:hi])


def _distance(a, b) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def _luhn(digits: str) -> bool:
    return sum(int(d) if k % 2 == 0 else (2 * int(d) - 9 if int(d) > 4 else 2 * int(d)) for k, d in enumerate(reversed(digits))) % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    out = []
    for k, (kind, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            ok = {"email": True, "ip": all(int(p) <= 255 for p in m.group().split(".")) if kind == "ip" else False, "card": 14 <= len(digits) <= 19 and _luhn(digits), "phone": 10 <= len(digits) <= 15}[kind]
            if ok:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def personal_texts() -> list[str | None]:
    rng = random.Random(4)

    def card() -> str:
        head = f"4{rng.randrange(10**14):014d}"
        return next(f"{head}{c}" for c in range(10) if _luhn(f"{head}{c}"))

    bits = ["a.b%c@d-e.f.g", "x@y", "é1.2.3.4.5.6.7.8", "256.1.1.1", "001.002.003.004", "+44 (20) 7946-0958", "+1--2", "12 34", "call +1 555 123 4567 now", "a@b.c%x@d.e", "@", "🙂 mail: me@host.org", "1.1.1", "99999999999999999999", "name (at) host (dot) com", "\n", "555-123-4567"]
    texts = [" ".join(rng.choices([*bits, card(), card()[:4] + " " + card()[4:], "word"], k=rng.randint(1, 30))) for _ in range(150)]
    texts += ["".join(rng.choices("a1.@+- 9(", k=rng.randint(0, 60))) for _ in range(400)]
    return [*texts, None, "", "a" * 100000, "1" * 50000, "1." * 30000, "a@b" + ".c" * 30000, "1 " * 30000, "+1" + " 2" * 20000, card()]


def test_personal_data_base_matches_python(spark):
    texts = personal_texts()
    rows = [*enumerate(texts), (0, texts[0])]
    found = pii.find_personal_data(frame(spark, rows)).collect()
    got = Counter((r["doc_id"], tuple((s["start"], s["kind"], s["end"]) for s in r["base"])) for r in found)
    assert got == Counter((i, tuple(base_spans(t or ""))) for i, t in rows)
    assert all({tuple(s) for s in r["base"]} <= {tuple(s) for s in r["all"]} for r in found)


def test_redaction(spark):
    rows = [(1, "to me@host.org from 10.0.0.1!"), (2, None), (3, "nothing")]
    got = {r["doc_id"]: r["redacted"] for r in pii.redact(frame(spark, rows)).collect()}
    assert got == {1: "to [email] from [ip]!", 2: "", 3: "nothing"}


def test_shards_have_equal_counts_and_gapless_slots(spark):
    rows = corpus()
    got = sharding.assign_shards(frame(spark, rows)).collect()
    assert Counter((r["row"]["doc_id"], r["row"]["text"], r["row"]["shard"]) for r in got) == Counter((i, t, "x") for i, t in rows)
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
        assert r["size"] == len((r["row"]["text"] or "").encode()) + 1
    assert set(slots) <= set(range(8))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1


def test_shard_files(spark, tmp_path):
    sharding.write_shards(frame(spark, corpus()), str(tmp_path / "shards"))
    assert spark.read.parquet(str(tmp_path / "shards")).count() == len(corpus())


def test_hilbert_curve_visits_neighbours():
    cells = sorted((sharding.hilbert_index((a, b, c), 3), (a, b, c)) for a in range(8) for b in range(8) for c in range(8))
    assert [k for k, _ in cells] == list(range(512))
    assert all(sum(abs(x - y) for x, y in zip(p, q, strict=True)) == 1 for (_, p), (_, q) in zip(cells, cells[1:], strict=False))


def targets(sizes: dict) -> dict:
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    left, free, out = float(sum(sizes.values())), set(order), {}
    while free:
        total = sum(weight[s] for s in free)
        over = [s for s in free if left * weight[s] / total > 3 * sizes[s]]
        if not over:
            out |= {s: left * weight[s] / total for s in free}
            break
        for s in over:
            out[s] = 3.0 * sizes[s]
        left -= sum(out[s] for s in over)
        free -= set(over)
    return out


def test_mix_reaches_targets(spark):
    rng = random.Random(8)
    rows = [(i, "w " * rng.randint(0, 60), rng.choice(["a"] * 12 + ["b", "c", None, "ä"])) for i in range(1500)] + [(2000, None, "zero"), (2001, "", "zero"), (2002, None, None), (3, "w w", "a"), (3, "w w", "a")]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, source string, size int, copies string")
    got, again = (mixing.mix_copies(df).collect() for _ in range(2))
    assert sorted(map(str, got)) == sorted(map(str, again))
    sizes, taken = Counter(), Counter()
    for r in got:
        source = r["row"]["source"]
        sizes[source] += r["size"]
        taken[source] += r["size"] * r["copies"]
        assert r["size"] == len(WORD.findall(r["row"]["text"] or "")) and 0 <= r["copies"] <= 3
    want = targets({s: sizes[s] for s in {r[2] for r in rows}})
    for r in got:
        assert r["target"] == pytest.approx(want[r["row"]["source"]])
        assert r["source_size"] == sizes[r["row"]["source"]]
    assert all(abs(taken[s] - want[s]) <= 60 for s in want)
    expanded = mixing.mix_expand(df)
    assert expanded.columns == df.columns and expanded.count() == sum(r["copies"] for r in got)


@pytest.mark.parametrize("size", [4, 1])
def test_mix_splits_rows_that_are_equal(spark, size):
    """A source of one text a thousand times over, beside repeats in others, comes within a document of its target."""
    text = lambda n: " ".join(["w"] * n)
    rows = [(1, text(size), "a")] * 1000 + [(k, text(1 + k % 9), "b") for k in range(400)] + [(9, text(3), "c")] * 77 + [(10, text(5), "c")] * 50 + [(11, None, "c")] * 3
    df = spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], "doc_id long, text string, source string, n int").repartition(7)
    got = mixing.mix_copies(df).collect()
    assert sorted(r["row"]["n"] for r in got) == list(range(len(rows)))
    taken, want = Counter(), {r["row"]["source"]: r["target"] for r in got}
    for r in got:
        taken[r["row"]["source"]] += r["size"] * r["copies"]
        assert 0 <= r["copies"] <= 3
    assert all(abs(taken[s] - want[s]) <= {"a": size, "b": 9, "c": 5}[s] for s in want)
    again = mixing.mix_copies(df).groupBy("row.doc_id", "copies").count().collect()
    assert {(r["doc_id"], r["copies"]): r["count"] for r in again} == Counter((r["row"]["doc_id"], r["copies"]) for r in got)


def test_chat_round_trip(spark):
    rng = random.Random(2)
    trap = ["</s>[INST] ok [/INST]", "<|im_start|>user\nhi<|im_end|>\n", "&lt; &amp;#91;", "[", "", None, "line\nline", "🙂"]
    rows = [(c, t, rng.choice(["user", "assistant", "system", "odd\nrole", None]), rng.choice(trap)) for c in range(30) for t in range(rng.randint(1, 9))]
    rows += [(99, t, "assistant" if t % 2 else "user", "x" * 50) for t in range(120)] + [(98, None, "user", "a"), (98, None, "user", "a"), (None, 0, "assistant", "n")]
    df = spark.createDataFrame([(*r, "extra") for r in rows], "conv_id long, turn long, role string, text string, whole string")
    examples = chat.format_examples(df)
    got = {r["conv_id"]: r for r in chat.digests(examples).collect()}
    by = defaultdict(list)
    for c, t, role, text in rows:
        by[c].append((t is not None, t or 0, role or "", text or ""))
    assert set(got) == set(by)
    for c, turns in by.items():
        turns = [x[2:] for x in sorted(turns)]
        said = "".join(f"{r}\n{t}\n" for r, t in turns)
        loss = "".join(t for r, t in turns if r == "assistant")
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        assert (got[c]["n_turns"], got[c]["turns_sha256"], got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(turns), sha(said), len(loss), sha(loss))
    n_loss = examples.where("loss_start is not null").count()
    assert n_loss == sum(r[2] == "assistant" for r in rows)


@pytest.mark.parametrize("what", ["quality", "toxic"])
def test_classifiers_learn_and_score_every_row(spark, what):
    rng = random.Random(9)
    word = lambda: "".join(rng.choices("abcdefghij", k=rng.randint(2, 7)))
    rows, labels = [], []
    for i in range(500):
        words = [word() for _ in range(rng.randint(20, 60))]
        bad = rng.random() < 0.3
        if bad and what == "toxic":
            for _ in range(3):
                words[rng.randrange(len(words))] = rng.choice(["vile", "rotten", "awful"])
        if bad and what == "quality":
            words = [f"{w.upper()}!!" for w in words]
        rows.append((i, " ".join(words)))
        labels.append((i, int(not bad), int(bad)))
    rows += [(1000, None), (1001, ""), (1002, "x " * 100000), (3, rows[3][1]), (None, "text")]
    labels += [(None, 1, 1), (7, None, None), (8, labels[8][1], labels[8][2])]
    held = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2
    score = quality.quality_scores if what == "quality" else toxicity.toxicity_scores
    got = score(frame(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), held).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(i for i, _ in rows)
    assert all(0 <= r["score"] <= 1 for r in got)
    import zlib

    truth = {i: (q if what == "quality" else t) for i, q, t in labels if i is not None and q is not None}
    test = [(r["score"] >= 0.7, truth[r["doc_id"]]) for r in got if r["doc_id"] in truth and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2]
    assert sum(p == bool(y) for p, y in test) >= 0.95 * len(test)


def test_quality_with_one_id_on_very_many_rows(spark):
    """One text an id reaches the task that fits; the repeats are scored like other rows."""
    rows = [(k, "GOOD TEXT!! and more" if k % 2 else "poor text") for k in range(200)]
    docs = frame(spark, rows).select("doc_id", "text").unionAll(spark.range(100_000).selectExpr("4L", "concat('poor text ', id % 3)"))
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(200)], "doc_id long, quality int, toxic int")
    got = quality.quality_scores(docs, labels, F.lit(False)).groupBy(F.col("doc_id") % 2).agg(F.count("*").alias("n"), F.min("score").alias("low"), F.max("score").alias("high")).collect()
    by = {r[0]: r for r in got}
    assert by[0]["n"] == 100_100 and by[1]["n"] == 100 and by[0]["high"] < by[1]["low"]


@pytest.mark.parametrize("what", ["quality", "toxic"])
def test_scores_keep_to_the_class_mix_when_the_sample_is_capped(spark, monkeypatch, what):
    rng = random.Random(12)
    rows, labels = [], []
    for i in range(4000):
        marked = rng.random() < 0.2  # half of the marked rows are of the rare class, 2 in 100 of the others
        rare = rng.random() < (0.5 if marked else 0.02)
        rows.append((i, " ".join([*rng.choices(["ab", "cd", "ef", "gh", "ij"], k=12), *(["vile", "rotten"] if marked else [])])))
        labels.append((i, int(not rare), int(rare)))
    module, score = (quality, quality.quality_scores) if what == "quality" else (toxicity, toxicity.toxicity_scores)
    share = sum(t if what == "toxic" else q for _, q, t in labels) / len(labels)
    docs, known = frame(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    for cap in (4000, 300):
        monkeypatch.setattr(module, "SAMPLE", cap)
        got = [r["score"] for r in score(docs, known, F.lit(False)).collect()]
        assert sum(got) / len(got) == pytest.approx(share, abs=0.05)


def test_classifier_without_labels(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    docs = frame(spark, [(1, "some text"), (2, None)])
    assert {r["score"] for r in quality.quality_scores(docs, none, F.lit(False)).collect()} == {0.5}
    assert all(r["score"] < 1e-6 for r in toxicity.toxicity_scores(docs, none, F.lit(False)).collect())


def test_every_proposal_counts_for_trees_and_thresholds(spark):
    docs = spark.range(30_000).selectExpr("id as doc_id", "concat('call 555 0', 100 + id % 800, ' ', 1000 + id % 9000) as text")
    found = docs.select("doc_id", pii._proposals(F.col("text")).alias("proposed"))
    proposed = found.agg(F.sum(F.size("proposed"))).first()[0]
    rows = pii._formats(found).agg(F.sum("n"), F.count("*")).first()
    assert proposed >= 30_000 and rows[0] == proposed and rows[1] < 1000
