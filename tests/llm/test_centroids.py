"""Operator 11 against whole-number arithmetic done plainly, on ordinary and on odd rows."""

import hashlib
import math

import numpy as np
import pytest

from fluvial.llm import centroids, vectors


def plain(rows, components=4, k=3, scale=64, rounds=3, seed=1):
    """(id, cluster, distance, inertia of the cluster, inertia, hash) with Python integers."""
    good = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if v is not None and len(v) == components and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted(good, key=lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest(), r[1]))
    centres = [list(v) for _, v in first[:k]]
    for r in range(rounds + 1):
        dist = [[sum((a - b) ** 2 for a, b in zip(v, c, strict=True)) for c in centres] for _, v in good]
        label = [min(range(len(d)), key=lambda j: (d[j], j)) for d in dist]
        for j in range(len(centres) if r < rounds else 0):
            own = [v for (_, v), g in zip(good, label, strict=True) if g == j]
            centres[j] = [sum(c) // len(own) for c in zip(*own, strict=True)] if own else centres[j]
    best = [min(d) for d in dist] if good else []
    top = (1 << 63) - 1
    sums = {g: min(top, sum(b for b, h in zip(best, label, strict=True) if h == g)) for g in set(label)} if good else {}
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return [(i, g, min(top, b), sums[g], min(top, sum(best)), names[g]) for (i, _), g, b in zip(good, label, best, strict=True)]


def same(spark, rows, kind="double", **options):
    frame = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], f"vec_id long, embedding array<{kind}>, cluster string, v int")
    got = centroids.cluster(frame, components=4, k=3, **options)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(plain(rows, **options), key=str)


def test_ordinary_rows(spark):
    rng = np.random.default_rng(3)
    same(spark, [(i, v) for i, v in enumerate(rng.normal(size=(300, 4)).tolist())])


@pytest.mark.parametrize("scale", [2.0**20, 2.0**24, 2.0**40, 1e200])
def test_large_magnitudes_fall_back_to_integers(spark, scale):
    rng = np.random.default_rng(4)
    rows = [(i, v) for i, v in enumerate((rng.normal(size=(60, 4)) * np.where(rng.random(60) < 0.3, scale, 1.0)[:, None]).tolist())]
    same(spark, [*rows, (99, [1.7e308, -1.7e308, 0.0, 1.0])])


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    bad = [(1, None), (2, []), (3, [1.0] * 5), (4, [1.0, None, 1.0, 1.0]), (5, [nan] * 4), (6, [1.0, -inf, 0.0, 0.0])]
    twice = [(7, [0.5, 0.25, -0.5, 0.0])] * 3 + [(7, [0.5, 0.25, -0.5, 0.125]), (None, [9.0, 9.0, 9.0, 9.0]), (8, [-0.01, 0.0, 0.0, 0.0])]
    same(spark, bad + twice)
    same(spark, bad + twice[:1])
    same(spark, [(i, [1.0, 1.0, 1.0, 1.0]) for i in range(20)])  # all the same: ties, and clusters that stay empty
    assert centroids.cluster(spark.createDataFrame(bad, "vec_id long, embedding array<float>")).count() == 0


def test_products_of_any_magnitude():
    rng = np.random.default_rng(5)
    for top in (10, 1 << 24, 1 << 30, 1 << 33):
        a, b = rng.integers(-top, top, (7, 5)), rng.integers(-top, top, (9, 5))
        want = [[max(-vectors.LONGEST, min(vectors.LONGEST, sum(int(p) * int(q) for p, q in zip(x, y, strict=True)))) for y in b] for x in a]
        assert vectors.products(a, b).tolist() == want
