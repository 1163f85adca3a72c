"""Exact top-k against brute force: negative scores, ties, copies, odd rows, few rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from creditloom.llm import topk

SCHEMA = "vec_id long, embedding array<float>, item long, q long, v string"


def slow(rows, every, k):
    whole = {}
    for key, vector in rows:
        if key is not None and vector and all(x is not None and np.isfinite(x) for x in vector):
            whole[key] = np.floor(1024 * np.array(vector, np.float32).astype(float)).astype(int)
    width = max({len(v) for v in whole.values()}, key=[len(v) for v in whole.values()].count, default=0)
    whole = {key: v for key, v in whole.items() if len(v) == width}
    out = []
    for key in whole:
        if key % every == 0:
            best = sorted((-int(whole[key] @ v), other) for other, v in whole.items() if other != key)[:k]
            out += [(key, rank, other, -score) for rank, (score, other) in enumerate(best, 1)]
    return sorted(out)


def check(spark, rows, every, k, **more):
    table = spark.createDataFrame([(key, v, 1, 2, "x") for key, v in rows], SCHEMA)
    got = topk.top_k(table, F.col("vec_id") % every == 0, k, **more).collect()
    assert sorted(map(tuple, got)) == slow(rows, every, k)


def vectors(n, width, seed=0, digits=3):
    rng = np.random.default_rng(seed)
    return [[float(x) for x in row] for row in np.round(rng.standard_normal((n, width)) / 4, digits)]


@pytest.mark.parametrize("lists", [1, 2, 3, 9])
def test_against_brute_force(spark, monkeypatch, lists):
    monkeypatch.setattr(topk, "ITEM_ROWS", 60)
    monkeypatch.setattr(topk, "QUERY_ROWS", 20)
    monkeypatch.setattr(topk, "PAIRS", 500)
    rows = list(enumerate(vectors(400, 8)))
    check(spark, rows, 4, 7, lists=lists)


def test_all_scores_negative(spark):
    rows = [(i, [abs(x) if i % 10 else -abs(x) for x in v]) for i, v in enumerate(vectors(200, 6, 1))]
    check(spark, rows, 10, 5)


def test_ties_and_copies(spark):
    rows = list(enumerate(vectors(60, 4, 2, digits=0))) + [(i, [0.25, -0.5, 0.0, 1.0]) for i in range(100, 200)]
    rows += [(i, [0.0] * 4) for i in range(300, 330)]
    check(spark, rows, 5, 10)
    check(spark, rows + rows, 5, 10)  # a repeated row counts once


def test_odd_rows(spark):
    good = list(enumerate(vectors(30, 3, 3)))
    odd = [(None, [1.0, 2.0, 3.0]), (100, None), (101, []), (102, [1.0, None, 1.0]), (103, [float("nan")] * 3), (104, [float("inf"), 0.0, 0.0]),
           (105, [1.0, 2.0]), (110, [1e9, 0.0, 0.0])]
    table = spark.createDataFrame([(key, v, 1, 2, "x") for key, v in good + odd], SCHEMA)
    got = topk.top_k(table, F.col("vec_id") % 5 == 0, 4).collect()
    assert sorted(map(tuple, got)) == slow(good, 5, 4)


def test_few_or_no_rows(spark):
    check(spark, list(enumerate(vectors(5, 4, 4))), 2, 10)
    check(spark, [(0, [1.0, 2.0])], 1, 10)
    check(spark, [], 1, 10)
    check(spark, [(1, [1.0, 2.0]), (3, [0.5, 0.5])], 2, 10)  # no queries


def test_large_components_stay_exact():
    rng = np.random.default_rng(5)
    a, b = rng.integers(-(1 << 23), 1 << 23, (3, 500)), rng.integers(-(1 << 23), 1 << 23, (4, 500))
    want = [[sum(int(x) * int(y) for x, y in zip(r, s)) for s in b] for r in a]
    assert topk._products(a, b).tolist() == want
