"""Series, powers, outliers and intervals against published or hand-made values."""

import math

import numpy as np
from fluvial.functions import linalg, optimize, outliers
from fluvial.functions import special as S
from fluvial.operators import learning, numbering, powers, sampling, series, stats
from pyspark.sql import functions as F

#: Monthly flows of the sample for clusters of peaks, compared in its publication with the POT package of R.
FLOWS = [122, 244, 214, 173, 229, 156, 212, 263, 146, 183, 161, 205, 135, 331, 225, 174, 98.8, 149, 238, 262, 132, 235, 216, 240, 230, 192, 195, 172, 173, 172, 153, 142, 317, 161, 201, 204, 194, 164, 183, 161, 167, 179, 185, 117, 192, 337, 125, 166, 99.1, 202, 230, 158, 262, 154, 164, 182, 164, 183, 171, 250, 184, 205, 237, 177, 239, 187, 180, 173, 174]


def monthly(spark, values):
    rows = [("a", i, None if v is None else float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "k string, i int, v double").select("k", F.expr("timestamp_ntz '2023-01-01' + make_ym_interval(0, i)").alias("ts"), "v")


def test_clusters_of_peaks(spark):
    flows = monthly(spark, FLOWS)
    for threshold, steps, first in ((100, 2, [331, 337, 262]), (90, 1, [337]), (150, 5, [331, 240, 317, 337]), (200, 2, [263, 331, 262, 317, 337, 250])):
        got = [r["peak"] for r in series.peaks_over(flows, threshold, steps, ["k"]).orderBy("at").collect()]
        assert got == first, threshold


def test_gap_at_the_end_goes_on(spark):
    gap = monthly(spark, [22, 16, 33, 5, 12, 36, 48, 10, 18, 15, math.nan, math.nan])
    got = [r["filled"] for r in series.interpolate(gap, 2, ["k"]).orderBy("ts").collect()]
    assert math.isclose(got[10], 11.9, abs_tol=1e-6) and math.isclose(got[11], 8.9, abs_tol=1e-6)
    wide = [r["filled"] for r in series.interpolate(monthly(spark, [1, None, None, None, 5, None, None, None, None]), 2, ["k"]).orderBy("ts").collect()]
    assert wide == [1, None, None, None, 5, None, None, None, None]


def test_water_year_with_a_gap_has_no_sum(spark):
    flows = monthly(spark, [*range(1, 13), 1, math.nan, *range(3, 13)])
    got = {r["water_year"]: r["b"] for r in series.water_year(flows, 1, "sum", ["k"]).collect()}
    assert got == {2023: 78.0, 2024: None}


def test_power_of_a_sample(spark):
    x = [1, 3, 59, 1, 6, 4, 9, 13, 5, 84, 35, 8, 31, 34, 9, 1, 35, 66, 1, 65, 4, 68, 46]
    df = spark.createDataFrame([(float(v),) for v in x], "x double")
    assert math.isclose(powers.fit_power(df, "x"), 0.1314482, abs_tol=2e-6)
    assert powers.fit_power(df.where("x < 0"), "x") is None


def test_low_outliers():
    z = S.normal_quantile((np.arange(60) + 0.5) / 60)
    x = np.exp(0.3 * z)
    assert outliers.multiple_grubbs_beck(x) == 0
    x[:2] = 1e-4, 2e-4
    assert outliers.multiple_grubbs_beck(x) == 2


def test_identity_link_is_not_clipped(spark):
    rows = [(float(i), 100.0 + 3 * i + (-1) ** i) for i in range(40)]
    df = spark.createDataFrame(rows, "x double, y double")
    a, b = learning.glm(df, "y", ["x"], "gaussian"), learning.linear(df, "y", ["x"])
    assert np.allclose(a.coefficients, b.coefficients) and np.allclose(a.errors, b.errors, rtol=1e-6)
    r = b.intervals(df.where("x = 20"), 0.9).first()
    x = np.arange(40.0)
    half = float(S.t_quantile(np.array(0.95), 38.0)) * b.sigma * math.sqrt(1 + 1 / 40 + (20 - x.mean()) ** 2 / ((x - x.mean()) ** 2).sum())
    assert math.isclose(r["upper"] - r["predicted"], half, rel_tol=1e-9) and math.isclose(r["predicted"] - r["lower"], half, rel_tol=1e-9)


def test_limits_need_estimates(spark):
    reps = sampling.bootstrap(spark, "normal", [10.0, 2.0], 30, 20, [0.5])
    for how in ("normal", "bias_corrected", "pivotal", "bca", "student"):
        try:
            sampling.percentile_intervals(reps, [0.5], how=how)
        except ValueError:
            continue
        raise AssertionError(how)


def test_inversions_and_concordance():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 7, 64, 100):
        x, y = rng.integers(0, 9, n), rng.integers(0, 9, n)
        assert stats.inversions(y) == sum(y[i] > y[j] for i in range(n) for j in range(i + 1, n))
        if n > 1:
            s = sum(int(np.sign(x[i] - x[j]) * np.sign(y[i] - y[j])) for i in range(n) for j in range(i))
            assert stats.concordance(x, y) == (s, sum(x[i] != x[j] for i in range(n) for j in range(i)), sum(y[i] != y[j] for i in range(n) for j in range(i)))


def test_numbers_and_ranks_without_keys(spark):
    x = [5.0, 1.0, 1.0, 3.0, 5.0, 5.0, 2.0, None]
    df = spark.createDataFrame(list(enumerate(x)), "i int, x double")
    got = {r["i"]: r["__i"] for r in numbering.numbered(df, ["x", "i"]).collect()}
    order = sorted(range(8), key=lambda i: (x[i] is not None, x[i] or 0, i))
    assert got == {i: k + 1 for k, i in enumerate(order)}
    ranks = {r["i"]: r["__r"] for r in numbering.average_ranks(df, "x").collect()}
    assert ranks == {0: 6.0, 1: 1.5, 2: 1.5, 3: 4.0, 4: 6.0, 5: 6.0, 6: 3.0}


def test_factors_of_matrices():
    a = np.random.default_rng(2).normal(size=(5, 3))
    q, r = linalg.qr(a)
    assert np.allclose(q @ r, a) and np.allclose(q.T @ q, np.eye(3)) and np.allclose(np.tril(r, -1), 0)
    b = np.arange(5.0)
    assert np.allclose(linalg.qr_solve(a, b), np.linalg.lstsq(a, b, rcond=None)[0]) and np.allclose(linalg.svd_solve(a, b), linalg.qr_solve(a, b))
    s = a.T @ a
    w, v = linalg.eigen(s)
    assert np.allclose(v @ np.diag(w) @ v.T, s) and math.isclose(linalg.determinant(s), np.linalg.det(s))
    assert np.allclose(linalg.gauss_jordan(s)[0], np.linalg.inv(s))


def test_adaptive_rules_on_hard_integrands():
    f = lambda x: np.sqrt(np.abs(x - 0.3))
    truth = 2 / 3 * (0.3**1.5 + 0.7**1.5)
    assert all(abs(rule(f, 0, 1, 1e-9) - truth) < 1e-7 for rule in (optimize.gauss_lobatto, optimize.gauss_kronrod, optimize.adaptive))
    assert abs(optimize.brent_minimum(lambda x: (x - 1.234) ** 2 + 1, -5, 5) - 1.234) < 1e-6
