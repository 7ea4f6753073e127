"""Counts of swapped and tied pairs against all pairs, with one key that has most rows."""

import numpy as np
import pytest

from fluvial.operators import pairs, stats


def plain(x, y):
    sx, sy = (np.sign(np.subtract.outer(v, v))[np.triu_indices(len(v), 1)] for v in (x, y))
    return int((sx * sy < 0).sum()), int((sx * sy).sum()), np.sqrt(np.abs(sx).sum() * np.abs(sy).sum())


def test_inversions():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 3, 50, 257):
        for top in (1, 2, 10, 1000):
            y = rng.integers(0, top, n)
            assert pairs.inversions(y) == sum(int((y[:i] > y[i]).sum()) for i in range(n))


@pytest.mark.parametrize("top", [2, 9, 10_000])
def test_one_large_key(spark, top):
    """A key of nearly all rows spans ranges; ties in x, in y and in both; null keys; rows with nulls left out."""
    rng = np.random.default_rng(top)
    keys = ["a"] * 400 + ["b"] * 30 + [None] * 25 + ["c"]
    x, y = rng.integers(0, top, len(keys)), rng.integers(0, max(2, top // 3), len(keys))
    rows = [(k, float(u), float(v)) for k, u, v in zip(keys, x, y, strict=True)]
    df = spark.createDataFrame([*rows, ("a", None, 1.0), ("b", 1.0, None), ("a", float("nan"), 1.0)], "k string, x double, y double").repartition(7)
    good = df.dropna(subset=["x", "y"])
    got = {r["k"]: int(r["swapped"]) for r in pairs.swapped(good, ["x"], "y", ["k"]).collect()}
    tau = {r["k"]: r["tau"] for r in stats.kendall(df, "x", "y", ["k"]).collect()}
    for k in set(keys):
        at = [i for i, q in enumerate(keys) if q == k]
        count, s, scale = plain(x[at], y[at])
        assert got[k] == count
        assert np.isclose(tau[k], s / scale) if scale else tau[k] is None
    count, s, scale = plain(x, y)
    assert int(pairs.swapped(good, ["x"], "y", []).first()["swapped"]) == count
    assert np.isclose(stats.kendall(df, "x", "y").first()["tau"], s / scale)
    order = spark.createDataFrame([(i, float(v)) for i, v in enumerate(y)], "i int, v double").repartition(5)
    assert stats.mann_kendall(order, "v", "i").first()["s"] == plain(np.arange(len(y)), y)[1]
    assert stats.kendall(df.limit(0), "x", "y", ["k"]).count() == 0
