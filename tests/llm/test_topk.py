import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import topk


def brute(rows, queries, k=10):
    good = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = set()
    for q, a in {(i, tuple(v)) for i, v in good if i in queries}:
        best = sorted((-sum(x * y for x, y in zip(a, v)), i) for i, v in good if i != q and len(v) == len(a))[:k]
        out |= {(q, r, i, -s) for r, (s, i) in enumerate(best, 1)}
    return out


@pytest.mark.parametrize("seed, width", [(1, 16), (2, 5), (3, 64)])
def test_against_brute_force(spark, seed, width):
    r = random.Random(seed)
    centres = [[r.gauss(0, 1) for _ in range(width)] for _ in range(5)]
    rows = [(i, [c + r.gauss(0, 0.2) for c in centres[i % 5]]) for i in range(400)]
    rows += [(1000 + i, rows[i][1]) for i in range(30)]  # ties
    rows += [(2000, None), (2001, [None] * width), (2002, [float("nan")] * width), (2003, [float("inf")] * width), (2004, [1.0] * (width + 1)), (2100, [2.0] * (width + 1)), (2200, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {tuple(x) for x in topk.top_k(df, F.pmod("vec_id", F.lit(100)) == 0).collect()}
    assert got == brute(rows, {i for i, _ in rows if i % 100 == 0})


def test_groups_don_t_matter(spark, monkeypatch):
    r = random.Random(9)
    rows = [(i, [r.gauss(0, 1) for _ in range(8)]) for i in range(300)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    one = {tuple(x) for x in topk.top_k(df, F.lit(True)).collect()}
    monkeypatch.setattr(topk, "GROUP_MB", 0.02)  # several groups of queries
    monkeypatch.setattr(topk, "CANDIDATES_AT_ONCE", 37)
    assert {tuple(x) for x in topk.top_k(df, F.lit(True)).collect()} == one == brute(rows, {i for i, _ in rows})


def test_bounds_prune_clustered_vectors():
    """Of vectors around 40 centres most pairs need no exact score, fewer at each level."""
    r = np.random.RandomState(6)
    centres = r.normal(size=(40, 64)) * np.linspace(2, 0.05, 64)
    m = np.floor(1024 * (centres[r.randint(0, 40, 6000)] + 0.1 * r.normal(size=(6000, 64)) * np.linspace(1, 0.1, 64)))
    s = topk.Search(np.arange(40), np.arange(40), m[:40], 10, topk.axes(m[:4096]))
    for i in range(0, 6000, 1000):
        s.add(np.arange(i, i + 1000), m[i : i + 1000])
    assert s.pairs == 40 * 5999 and sorted(s.left, reverse=True) == s.left
    assert s.left[-1] < 0.2 * s.pairs, [x / s.pairs for x in s.left]


def test_extra_columns_of_clashing_names(spark):
    rows = [(i, [float(i % 7), 1.0], "x", 5) for i in range(50)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, v string, key int").select("*", F.lit(1).alias("g"), F.lit("m").alias("m"))
    assert {tuple(x) for x in topk.top_k(df, F.col("vec_id") == 3, k=2).collect()} == brute([r[:2] for r in rows], {3}, 2)


def test_bounds_hold():
    r = np.random.RandomState(4)
    a, b = r.normal(size=(50, 13)), r.normal(size=(60, 13))
    exact, last = a @ b.T, None
    for s in (1, 2, 4, 13):
        bound = topk.statistics(a, s) @ topk.statistics(b, s).T
        assert (bound >= exact - 1e-9).all()
        last = bound
    assert np.allclose(last, exact)


def test_empty(spark):
    assert topk.top_k(spark.createDataFrame([], "vec_id long, embedding array<double>"), F.lit(True)).collect() == []
