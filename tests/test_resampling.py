"""Replicates against samples written out: each row as often as its weight says."""

import numpy as np

from fluvial.operators import resampling


def l_moments(x):
    x, n = np.sort(x), len(x)
    b = [np.mean([x[j] * np.prod([(j - k) / (n - 1 - k) for k in range(r)]) for j in range(n)]) for r in range(4)]
    return b[0], 2 * b[1] - b[0], 6 * b[2] - 6 * b[1] + b[0], 20 * b[3] - 30 * b[2] + 12 * b[1] - b[0]


def test_replicates_equal_samples_written_out(spark):
    rng = np.random.default_rng(4)
    x, y = rng.gamma(2.0, size=90).round(2), rng.normal(size=90)
    df = spark.createDataFrame([(i, "ab"[i % 2], float(a), float(b)) for i, (a, b) in enumerate(zip(x, y, strict=True))], "id long, k string, x double, y double")
    moments = {r["replicate"]: r for r in resampling.moments(df.repartition(5), "id", "x", 6, 9).collect()}
    lmom = {r["replicate"]: r for r in resampling.l_moments(df, "id", "x", 6, 9).collect()}
    lines = {(r["k"], r["replicate"]): r for r in resampling.regression(df, "id", "y", "x", 6, 9, ["k"]).collect()}
    for r in range(6):
        w = resampling.bag_weights(np.arange(90), r, 9).astype(int)
        s = np.repeat(x, w)
        assert np.allclose([moments[r]["n"], moments[r]["mean"], moments[r]["sd"], moments[r]["skew"]], [len(s), s.mean(), s.std(), ((s - s.mean()) ** 3).mean() / s.std() ** 3])
        a, b, c, d = l_moments(s)
        assert np.allclose([lmom[r]["n"], lmom[r]["l1"], lmom[r]["l2"], lmom[r]["t3"], lmom[r]["t4"]], [len(s), a, b, c / b, d / b])
        for k in (0, 1):
            at = np.repeat(np.arange(90), w)
            at = at[at % 2 == k]
            assert np.allclose([lines["ab"[k], r]["slope"], lines["ab"[k], r]["intercept"]], np.polyfit(x[at], y[at], 1))


def test_weights_and_limits(spark):
    """Weights have mean and variance of one; limits of a mean are near the normal ones; nulls and empty tables."""
    w = np.stack([resampling.bag_weights(np.arange(20_000), r, 1) for r in range(4)])
    assert np.abs(w.mean(1) - 1).max() < 0.03 and np.abs(w.var(1) - 1).max() < 0.06 and np.abs(np.corrcoef(w) - np.eye(4)).max() < 0.03
    df = spark.range(4000).selectExpr("id", "cast(pmod(id * 37, 101) as double) x").unionByName(spark.createDataFrame([(9001, None)], "id long, x double"))
    got = resampling.limits(resampling.moments(df, "id", "x", 200), "mean").first()
    error = 101 / 12**0.5 / 4000**0.5
    assert abs(got["error"] / error - 1) < 0.15 and abs(got["lower"] - (50 - 1.645 * error)) < 0.4 * error
    assert resampling.moments(df.limit(0), "id", "x", 5).count() == 0 == resampling.l_moments(df.limit(0), "id", "x", 5).count()
