import math

import numpy as np
from pyspark.sql import functions as F

from graphloom.llm import topk
from graphloom.llm.topk import best_of, top_k


def brute(rows, k=5):
    sound = list({(i, tuple(math.floor(256 * float(x)) for x in v)) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)})
    out = []
    for q, a in sound:
        if q % 50 == 0:
            best = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in sound if i != q)[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    return sorted(out)


def run(spark, rows):
    df = spark.createDataFrame([(i, v, 1.0) for i, v in rows], "vec_id long, embedding array<float>, score double")
    return sorted(map(tuple, top_k(df, F.col("vec_id") % 50 == 0).collect()))


def vectors(n, d, seed, spread=False):
    rng = np.random.default_rng(seed)
    v = rng.normal(size=(n, d)).astype(np.float32)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    return v * rng.lognormal(0, 1, (n, 1)).astype(np.float32) if spread else v


def test_against_brute_force(spark, monkeypatch):
    for name, value in (("MOST_ROWS", 64), ("LEAST_ROWS", 64), ("QUERY_ROWS", 4)):
        monkeypatch.setattr(topk, name, value)
    for spread in (False, True):
        rows = [(k, v.tolist()) for k, v in enumerate(vectors(600, 8, 3, spread))]
        rows += [(700 + k, rows[0][1]) for k in range(20)] + [(900, None), (None, rows[0][1]), (950, [float("nan")] * 8), (951, [None] * 8), (1000, [0.0] * 8), (1050, rows[5][1]), (1050, rows[5][1]), (1100, [0.5])]
        assert run(spark, rows) == brute(rows)


def test_small_tables(spark):
    assert run(spark, [(50, [0.5, 0.25])]) == []
    assert run(spark, [(1, [0.5]), (2, [0.5])]) == []
    rows = [(50, [0.5, 0.25]), (1, [1.0, 1.0]), (2, [])]
    assert run(spark, rows) == brute(rows)
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert top_k(df, F.col("vec_id") % 50 == 0).count() == 0


def test_pruning_changes_nothing():
    x = np.floor(256 * vectors(3000, 64, 5, True)).astype(np.int64)
    x = x[np.argsort(-(x**2).sum(axis=1))]
    ids, axes = np.arange(len(x)), np.linalg.svd(x.T.astype(float) @ x)[0]
    full = x[:40] @ x.T
    for row, best in best_of(ids[:40], x[:40], ids, x, np.full(40, -np.inf), 5, axes, step=200).items():
        want = sorted((-s, i) for i, s in enumerate(full[row].tolist()) if i != row)[:5]
        assert best == [(-s, i) for s, i in want]
