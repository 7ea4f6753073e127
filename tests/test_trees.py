"""Trees and forests from level-wise sums against plain ones."""

import numpy as np
import pytest

from fluvial.operators import trees


def plain_tree(x, y, w, depth, least=2, at=0):
    """{heap place: (feature, threshold, mean)} by trying all midpoints."""
    mean = (w * y).sum() / w.sum()
    best = None
    if depth and w.sum() >= least:
        for f in range(x.shape[1]):
            v = np.unique(x[w > 0, f])
            for c in (v[1:] + v[:-1]) / 2:
                a = x[:, f] <= c
                gain = (w[a] * y[a]).sum() ** 2 / w[a].sum() + (w[~a] * y[~a]).sum() ** 2 / w[~a].sum() - (w * y).sum() ** 2 / w.sum()
                if best is None or gain > best[0] + 1e-9:
                    best = gain, f, c, a
    if best is None or best[0] <= 1e-12 * (w * y * y).sum():
        return {at: (-1, None, mean)}
    _, f, c, a = best
    return {at: (f, c, mean)} | plain_tree(x[a], y[a], w[a], depth - 1, least, 2 * at + 1) | plain_tree(x[~a], y[~a], w[~a], depth - 1, least, 2 * at + 2)


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(8)
    x = np.column_stack([rng.integers(0, 12, 300), rng.integers(0, 7, 300) / 4, rng.normal(size=300).round(1)]).astype(float)
    return x, (3 * (x[:, 0] > 5) + x[:, 1] * (x[:, 2] > 0) + 0.1 * rng.normal(size=300)).round(3)


def frame(spark, x, y):
    return spark.createDataFrame([(i, *map(float, r), float(v)) for i, (r, v) in enumerate(zip(x, y, strict=True))], "id long, a double, b double, c double, y double")


def test_tree_equals_plain_one(spark, rows):
    x, y = rows
    df = frame(spark, x, y)
    got = trees.grow(df, "y", ["a", "b", "c"], ["id"], depth=3)
    want = plain_tree(x, y, np.ones(len(y)), 3)
    for at, (f, c, mean) in want.items():
        assert got.feature[0, at] == f and np.isclose(got.value[0, at], mean) and (f < 0 or np.isclose(got.threshold[0, at], c)), at
    by_expression = [r["p"] for r in df.select("id", got.expression().alias("p")).orderBy("id").collect()]
    assert np.allclose(by_expression, got.predict(x)[:, 0])


def test_forest_equals_plain_ones(spark, rows):
    """Bags by hash: the same trees whatever the partitions, and intervals of their predictions."""
    x, y = rows
    df = frame(spark, x, y)
    ids = np.array([r[0] for r in df.selectExpr("xxhash64(id)").collect()])
    got = [trees.grow(df.repartition(n), "y", ["a", "b", "c"], ["id"], depth=2, trees=5, bag=7) for n in (1, 3)]
    assert np.allclose(got[0].value, got[1].value, equal_nan=True)
    plain = []
    for t in range(5):
        w = trees.bag_weights(ids, t, 7)
        assert 0.8 < w.mean() < 1.2
        tree = plain_tree(x[w > 0], y[w > 0], w[w > 0], 2)
        for at, (_, _, mean) in tree.items():
            assert np.isclose(got[0].value[t, at], mean)
        plain.append(tree)
    p = got[0].predict(x)
    found = trees.forest_intervals(df, got[0], ["id"]).orderBy("id").toPandas()
    assert np.allclose(found[["lower", "median", "upper"]].to_numpy(float), np.quantile(p, [0.05, 0.5, 0.95], axis=1).T)


def test_many_trees_take_more_passes(spark, rows, monkeypatch):
    x, y = rows
    df = frame(spark, x, y)
    whole = trees.grow(df, "y", ["a", "b", "c"], ["id"], depth=2, trees=4, bag=3, tried=2)
    monkeypatch.setattr(trees, "HELD", 3000)
    assert np.allclose(trees.grow(df, "y", ["a", "b", "c"], ["id"], depth=2, trees=4, bag=3, tried=2).value, whole.value, equal_nan=True)


def test_odd_rows(spark):
    """Nulls and NaN are left out, a constant target is one leaf, quantiles cut a feature of many values, an empty table predicts nothing."""
    rows = [(1, 1.0, 2.0), (2, None, 2.0), (3, float("nan"), 9.0), (4, 5.0, None), (5, 7.0, 2.0)]
    df = spark.createDataFrame(rows, "id long, a double, y double")
    one = trees.grow(df, "y", ["a"], ["id"])
    assert one.feature[0, 0] == -1 and one.value[0, 0] == 2.0
    many = spark.range(5000).selectExpr("id", "cast(id as double) a", "if(id < 1000, 1.0D, 3.0D) y")
    cut = trees.grow(many, "y", ["a"], ["id"], depth=1, bins=10)
    assert abs(cut.threshold[0, 0] - 1000) <= 300 and len(cut.cuts[0]) <= 10
    assert np.isnan(trees.grow(df.limit(0), "y", ["a"], ["id"]).value).all()
    got = {r["id"]: r["mean"] for r in trees.forest_intervals(df, one, ["id"]).collect()}
    assert got == {1: 2.0, 2: 2.0, 3: 2.0, 4: 2.0, 5: 2.0} or got[2] is None
