"""Vector search against brute force: whole queries, recall, ties, copies and rows that take no part."""

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from helpers import SMALL, save

from octofold.llm import vector_search as V


def brute(rows, k=20):
    """Plain lists: (query_id, rank, vec_id, score)."""
    good = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            good[i] = min(good.get(i, v), v)
    out = []
    for q in (i for i in good if i % 20 == 0):
        scored = []
        for i, v in good.items():
            if i != q:
                total = 0.0
                for x, y in zip(good[q], v):
                    total += x * y
                scored.append((-total, i))
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(sorted(scored)[:k])]
    return sorted(out)


def test_equals_sql(spark):
    duck = duckdb.connect()
    duck.sql(f"create view embeddings as select * from '{SMALL}/embeddings.parquet'")
    want = duck.sql(V.ORACLE["op12_vector_search"]).fetchall()
    assert sorted(map(tuple, V.op12_vector_search(spark, SMALL).collect())) == sorted(want)


@pytest.mark.parametrize("clusters", [1, 40])
def test_recall_and_work(clusters):
    """Recall of 0.99 at least, with exact products for a small part of all pairs, fewer on clusters."""
    rng = np.random.default_rng(clusters)
    middles = rng.standard_normal((clusters, 48))
    x = middles[rng.integers(0, clusters, 6000)] * (clusters > 1) + rng.standard_normal((6000, 48)) * (0.3 if clusters > 1 else 1)
    codec = V.Codec(x[:2000])
    parts = codec.encode(x)
    ids = np.arange(6000)
    best, exact = V.search(codec, x[:300], ids[:300], x, ids, *parts[:2], *parts[2:], 20)
    scores = x[:300] @ x.T
    scores[np.arange(300), np.arange(300)] = -np.inf
    want = np.argsort(-scores, axis=1)[:, :20]
    assert np.mean([len(set(a) & set(b)) / 20 for a, b in zip(want, best.id)]) >= 0.99
    assert exact < 300 * 6000 * 0.25


def test_bounds_hold():
    """Errors of the estimates have the promised size and no bias."""
    rng = np.random.default_rng(3)
    x, q = rng.standard_normal((4000, 32)) + 0.5, rng.standard_normal((20, 32))
    codec = V.Codec(x[:1000])
    cell, code, radius, scale, error = codec.encode(x)
    signs = np.unpackbits(code, axis=1).astype(float) * 2 - 1
    guess = scale[:, None] * (signs @ (q @ codec.rotation.T).T / codec.bits**0.5) + (codec.centroids @ q.T)[cell]
    off = (guess - x @ q.T) / (error[:, None] * np.linalg.norm(q, axis=1))
    assert abs(off.mean()) < 0.05 and 0.7 < off.std() < 1.1 and (off < -V.SIGMAS).mean() < 1e-3


def test_odd_rows(spark, tmp_path):
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.integers(-3, 4, 6)]) for i in range(90)]
    rows += [(i, [1.0, 2.0, 0.0, 0.0, 1.0, 0.0]) for i in range(100, 150)]  # ties: more than k copies
    rows += [(160, None), (180, []), (200, [0.0] * 6), (220, [1.0, None, 0, 0, 0, 0]), (240, [float("nan")] * 6), (260, [float("inf")] * 6), (280, [1.0, 2.0]), (None, [1.0] * 6), (-20, [1.0] * 6)]
    rows += [rows[0], rows[3], (5, [9.0] * 6), (300, [1e200, 0, 0, 0, 0, 0])]  # repeated whole, and with another vector
    table = {"vec_id": pa.array([i for i, _ in rows], pa.int64()), "embedding": pa.array([v for _, v in rows], pa.list_(pa.float64())), "score": pa.array(["x"] * len(rows)), "cell": pa.array([None] * len(rows), pa.int32())}
    got = sorted(map(tuple, V.op12_vector_search(spark, save(tmp_path, embeddings=table)).collect()))
    assert got == brute([r for r in rows if r[0] != 280])
    few = {"vec_id": pa.array([0, 1, 20], pa.int64()), "embedding": pa.array([[1.0], [2.0], [-1.0]], pa.list_(pa.float32()))}
    (tmp_path / "few").mkdir()
    assert sorted(map(tuple, V.op12_vector_search(spark, save(tmp_path / "few", embeddings=few)).collect())) == [(0, 1, 1, 2.0), (0, 2, 20, -1.0), (20, 1, 0, -1.0), (20, 2, 1, -2.0)]
