"""Embedding near-duplicates against brute force."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from ledgerlark.llm import embeddings


def test_links_match_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(1)
    rows = []
    for c in range(40):
        centre = rng.normal(size=16)
        for _ in range(int(rng.integers(1, 8))):
            rows.append((len(rows), (centre + rng.normal(size=16) * 0.12).tolist(), int(c % 3)))
    rows += [(len(rows) + k, rows[0][1], rows[0][2]) for k in range(30)]
    n = len(rows)
    odd = [(n, None, 1), (n + 1, [0.0] * 16, 1), (n + 2, [float("nan")] * 16, 1), (n + 3, rows[0][1], None), (n + 4, [None] * 16, 1), (n + 5, [], 1), (n + 6, [1.0, 2.0], 1), (n + 7, [2.0, 4.0], 1), (n + 8, [1e300] * 16, 2), (n + 9, [1e-300] * 16, 2), (3, rows[3][1], rows[3][2])]
    rows += odd
    monkeypatch.setattr(embeddings, "LIST", 20)
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<double>, label int, cls string, n int")
    got = sorted((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in embeddings.near_duplicates(df).collect())

    def unit(v):
        x = np.array(v, float)
        x = x / np.abs(x).max()
        return x / np.sqrt(x @ x)

    good = [k for k, (_, v, lab) in enumerate(rows) if lab is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    vec = {k: unit(rows[k][1]) for k in good}
    links = {k: set() for k in range(len(rows))}
    for a in good:
        for b in good:
            if a != b and rows[a][2] == rows[b][2] and len(vec[a]) == len(vec[b]) and vec[a] @ vec[b] >= 0.93:
                links[a].add(b)

    def reach(k):
        seen, todo = {k}, [k]
        while todo:
            for j in links[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        return min(rows[j][0] for j in seen)

    expected = sorted((rows[k][0], len(links[k]), reach(k), rows[k][0] == reach(k)) for k in range(len(rows)))
    same = sum(a == b for a, b in zip(got, expected, strict=True))
    assert same >= 0.97 * len(rows)
    assert sum(r[1] for r in got) <= sum(r[1] for r in expected)
    assert sum(r[1] for r in got) >= 0.95 * sum(r[1] for r in expected)


def test_recall_with_many_lists(spark, monkeypatch):
    """8 of 200 lists are probed; queries are the ids divisible by 20, against all vectors of one large and two small labels."""
    rng = np.random.default_rng(4)
    monkeypatch.setattr(embeddings, "LIST", 250)
    loose = rng.normal(size=(38000, 32))
    centres = rng.normal(size=(3000, 32))
    near = np.repeat(centres, 4, axis=0) + rng.normal(size=(12000, 32)) * rng.uniform(0.1, 0.28, size=(12000, 1))
    v = np.concatenate((loose, near))[rng.permutation(50000)]
    label = np.where(np.arange(50000) % 10 < 8, 0, np.arange(50000) % 10 - 7)
    table = pa.table({"vec_id": np.arange(50000), "embedding": pa.array(list(v), pa.list_(pa.float64())), "label": label})
    got = embeddings.near_duplicates(spark.createDataFrame(table)).where("vec_id % 20 = 0").toPandas().set_index("vec_id")["n_links"]
    x = v / np.sqrt((v * v).sum(axis=1, keepdims=True))
    q = np.arange(0, 50000, 20)
    linked = (x[q] @ x.T >= 0.93) & (label[q][:, None] == label[None])
    true = linked.sum(axis=1) - 1
    found = got.loc[q].to_numpy()
    assert true.sum() > 500 and (found <= true).all()
    recall = found.sum() / true.sum()
    print(f"recall {recall:.4f} of {true.sum()} links")
    assert recall >= 0.9


def test_empty_table(spark):
    assert embeddings.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0
