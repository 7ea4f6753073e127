"""Published samples and results."""

import math

import numpy as np
import pytest

from fluvial.functions import distributions as D
from fluvial.operators import sampling, sequences, stats
from pyspark.sql import functions as F

#: Annual peak flows of the Harricana River at Amos, a published sample.
HARRICANA = [122, 244, 214, 173, 229, 156, 212, 263, 146, 183, 161, 205, 135, 331, 225, 174, 98.8, 149, 238, 262, 132, 235, 216, 240, 230, 192, 195, 172, 173, 172, 153, 142, 317, 161, 201, 204, 194, 164, 183, 161, 167, 179, 185, 117, 192, 337, 125, 166, 99.1, 202, 230, 158, 262, 154, 164, 182, 164, 183, 171, 250, 184, 205, 237, 177, 239, 187, 180, 173, 174]
#: A published sample for L-moments.
PEAKS = [1953, 1939, 1677, 1692, 2051, 2371, 2022, 1521, 1448, 1825, 1363, 1760, 1672, 1603, 1244, 1521, 1783, 1560, 1357, 1673, 1625, 1425, 1688, 1577, 1736, 1640, 1584, 1293, 1277, 1742, 1491]
#: A published sample for the one-sample t test.
NOISE = [8.782932, 10.64199, -1.63955, -6.802458, 9.088312, -27.26934, 9.451478, -4.142762, -4.262396, -13.78983, -1.743717, 27.259681, 5.559418, 7.803247, -11.25798, 12.253498, -13.295363, -4.973664, 16.81069, 4.480855, 11.694329, 21.836776, -9.664926, -23.297061, -23.965643, 27.076463, -7.22471, 9.305697, 9.181852, -2.434665]


def test_moments(spark):
    r = stats.describe(sequences.to_frame(spark, HARRICANA), "v").first()
    want = {"minimum": 98.8, "maximum": 337, "mean": 191.317391304348, "geometric": 185.685629284673, "harmonic": 180.183870381546, "variance": 2300.31616368286, "pop_variance": 2266.97824826717, "sd": 47.9616113541118, "pop_sd": 47.6127950058298, "skew": 0.8605451107461, "kurt": 1.3434868130194}
    assert all(math.isclose(r[k], v, rel_tol=1e-10) for k, v in want.items())


def test_percentiles(spark):
    got = [r["value"] for r in stats.percentiles(sequences.to_frame(spark, HARRICANA), "v", [0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99]).orderBy("p").collect()]
    assert np.allclose(got, [99.004, 123.2, 164, 183, 216, 262.6, 332.92])


def test_l_moments_and_fits(spark):
    m = stats.l_moments(sequences.to_frame(spark, PEAKS), "v")
    r = m.first()
    assert np.allclose([r["l1"], r["l2"], r["t3"], r["t4"]], [1648.8064516, 138.2365591, 0.1033903, 0.1940943], atol=1e-6)
    fits = {"gev": [1543.933, 218.1148, 0.1068473], "gumbel": [1533.69, 199.4332], "generalized_pareto": [1285.909, 589.7772, 0.6251903], "generalized_logistic": [1625.42, 135.8186, -0.1033903]}
    for name, want in fits.items():
        p = m.select(D.from_l_moments(name, F.col("l1"), F.col("l2"), F.col("t3")).alias("p")).first()["p"]
        assert np.allclose(p, want, rtol=1e-5, atol=1e-3), name
        assert np.allclose(sampling.estimate(name, np.array(PEAKS, float)), want, rtol=1e-5, atol=1e-3)


def test_tests(spark):
    noise = sequences.to_frame(spark, NOISE)
    r = stats.t_tests(noise, "v", F.lit(True)).first()
    assert math.isclose(r["p_one"], 0.6489, abs_tol=1e-4)
    g = stats.grubbs_beck(sequences.to_frame(spark, HARRICANA), "v").first()
    assert math.isclose(g["high"], 378.2, abs_tol=0.1) and math.isclose(g["low"], 91.2, abs_tol=0.1)


def test_serial_tests(spark):
    rng = np.random.default_rng(2)
    free, tied = rng.normal(size=300), np.cumsum(rng.normal(size=300))
    a, b = (sequences.summary_tests(sequences.to_frame(spark, x)).first() for x in (free, tied))
    assert a["ljung_box"] > 0.01 and a["wald_wolfowitz"] > 0.01 and b["ljung_box"] < 1e-6 and b["wald_wolfowitz"] < 1e-6


def test_partial_autocorrelation_and_decomposition(spark):
    p = sequences.partial_autocorrelation([0.6**k for k in range(5)])
    assert np.allclose(p, [1, 0.6, 0, 0, 0])
    t = np.arange(120)
    df = sequences.to_frame(spark, 10 + np.sin(2 * np.pi * t / 12)).withColumn("k", F.lit("a"))
    got = sequences.decompose(df, 12, ["k"]).where("ts >= 24").toPandas()
    assert np.abs(got.rest).max() < 0.2


@pytest.mark.parametrize("n", [0, 1, 2, 3])
def test_tiny_samples(spark, n):
    df = sequences.to_frame(spark, [1.0, 2.0, 4.0][:n]) if n else sequences.to_frame(spark, [1.0]).limit(0)
    r = stats.describe(df, "v").first()
    assert r["n"] == n and r["kurt"] is None and (r["skew"] is None) == (n < 3)
    assert stats.l_moments(df, "v").count() == 0
