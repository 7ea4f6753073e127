"""The metric index against all pairs: exact results, few pairs where rows have clusters, any number of queries and slices."""

import numpy as np
import pytest

from fluvial.operators import metric
from fluvial.operators.learning import knn_predict


def frame(spark, x):
    return spark.createDataFrame([(i, r.tolist(), float(i % 7)) for i, r in enumerate(x)], "id long, v array<double>, y double").repartition(3)


def plain(x, queries, k):
    d = np.sqrt(((x[queries][:, None] - x) ** 2).sum(2))
    d[np.arange(len(queries)), queries] = np.inf
    return {(q, r + 1): n for q, row in zip(queries.tolist(), np.argsort(d, 1, kind="stable")[:, :k].tolist(), strict=True) for r, n in enumerate(row)}


@pytest.mark.parametrize("spread", [0.02, 1.0])
def test_equals_all_pairs(spark, spread):
    rng = np.random.default_rng(2)
    x = (rng.normal(size=(12, 5)) * 2)[rng.integers(0, 12, 500)] + spread * rng.normal(size=(500, 5))
    x[100:110] = x[90:100]  # ties at distance 0
    df = frame(spark, x)
    index = metric.MetricIndex.build(df, "id", "v")
    assert int(index.count.sum()) == 500
    near, pairs = index.search(df.where("id % 5 = 0"), "id", "v", 4)
    got = {(r["q"], r["rank"]): r["n"] for r in near.collect()}
    assert got == plain(x, np.arange(0, 500, 5), 4)
    share = pairs.first()["pairs"] / (100 * 499)
    assert share < (0.35 if spread < 0.1 else 1.0)
    y = np.arange(500) % 7
    mean = {r["q"]: r["predicted"] for r in metric.predicted(near, df, "id", "y").collect()}
    want = {q: knn_predict(np.delete(x, q, 0), np.delete(y, q), x[q : q + 1], 4)[0] for q in range(0, 500, 5)}
    assert all(np.isclose(mean[q], want[q]) for q in want)


def test_slices_and_groups(spark, monkeypatch):
    """One cell of many rows in slices, with more queries than a task holds."""
    monkeypatch.setattr(metric, "SLICE", 40)
    monkeypatch.setattr(metric, "QUERIES", 16)
    monkeypatch.setattr(metric, "HELD", 256)
    x = np.random.default_rng(3).normal(size=(150, 3))
    df = frame(spark, x)
    near, _ = metric.MetricIndex.build(df, "id", "v", pivots=2).search(df, "id", "v", 3)
    assert {(r["q"], r["rank"]): r["n"] for r in near.collect()} == plain(x, np.arange(150), 3)


def test_odd_rows(spark):
    """Fewer rows than k; null vectors and keys left out; an empty base finds nothing."""
    df = spark.createDataFrame([(1, [0.0], 1.0), (2, [1.0], 2.0), (3, None, 3.0), (None, [5.0], 4.0)], "id long, v array<double>, y double")
    near, _ = metric.MetricIndex.build(df, "id", "v").search(df, "id", "v", 5)
    assert sorted((r["q"], r["n"], r["rank"]) for r in near.collect()) == [(1, 2, 1), (2, 1, 1)]
    assert metric.predicted(near, df, "id", "y", classify=True).count() == 2
    empty = metric.MetricIndex.build(df.limit(0), "id", "v")
    assert empty.search(df, "id", "v", 5)[0].count() == 0
