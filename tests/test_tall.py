"""Factors, mixtures and densities by partial sums against numpy on the whole matrix."""

import numpy as np
import pytest

from fluvial.functions.distributions import kernel_density as plain_density
from fluvial.operators import density, tall


def frame(spark, x, n=5):
    return spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, v array<double>").repartition(n)


@pytest.mark.parametrize("shape", [(200, 6), (3, 6), (6, 6), (1, 1)])
def test_qr_and_svd(spark, shape):
    x = np.random.default_rng(sum(shape)).normal(size=shape)
    df = frame(spark, x)
    r = tall.tall_r(df, "v")
    assert np.allclose(r.T @ r, x.T @ x) and np.allclose(np.tril(r, -1), 0) and (np.diag(r) >= 0).all()
    s, v = tall.singular_values(df, "v")
    want = np.linalg.svd(x)[1]
    assert np.allclose(s[: len(want)], want) and np.allclose(v.T @ v, np.eye(len(v)))
    if shape[0] >= shape[1]:
        q = np.array([row["q"] for row in tall.tall_q(df, "v", r, ["id"]).orderBy("id").collect()])
        assert np.allclose(q.T @ q, np.eye(shape[1])) and np.allclose(q @ r, x)


def test_factor_of_odd_rows(spark):
    df = spark.createDataFrame([(1, None), (2, [1.0, None]), (3, [float("nan"), 1.0]), (4, [3.0, 4.0])], "id long, v array<double>")
    assert np.allclose(np.abs(tall.tall_r(df, "v")), [[3.0, 4.0]])
    assert tall.tall_r(df.limit(0), "v").size == 0 == len(tall.singular_values(df.limit(0), "v")[0])


def test_mixture(spark):
    """The likelihood never falls; weights, means and covariances are those of the samples; the first round is that of plain sums."""
    rng = np.random.default_rng(6)
    x = np.concatenate([rng.normal([0, 0], [1, 2], (300, 2)), rng.normal([6, 5], [1.5, 0.5], (100, 2))])
    got = tall.fit_mixture(frame(spark, x), "v", [[1, 1], [5, 5]])
    assert (np.diff(got.loglik) > -1e-6).all() and len(got.loglik) < 200
    assert np.allclose(got.weights, [0.75, 0.25], atol=0.02) and np.allclose(got.means, [x[:300].mean(0), x[300:].mean(0)], atol=0.1)
    own = {r["id"]: r["component"] for r in tall.assigned(frame(spark, x), "v", got, ["id"]).collect()}
    assert sum(own[i] == (i >= 300) for i in range(400)) > 395
    one = tall.fit_mixture(frame(spark, x), "v", [[1, 1], [5, 5]], rounds=1)
    d = np.exp(-((x[:, None] - np.array([[1, 1], [5, 5]])) ** 2).sum(2) / 2)
    r = d / d.sum(1, keepdims=True)
    assert np.allclose(one.means, (r.T @ x) / r.sum(0)[:, None]) and np.allclose(one.weights, r.mean(0))
    assert tall.fit_mixture(frame(spark, x).limit(0), "v", [[0, 0]]).loglik == []


@pytest.mark.parametrize("kernel", ["gaussian", "epanechnikov", "triangular", "uniform"])
def test_density_on_a_grid(spark, kernel):
    rng = np.random.default_rng(7)
    x = np.concatenate([rng.normal(size=300), [4.0] * 20])
    df = spark.createDataFrame([("a", float(v)) for v in x] + [("b", 1.0), ("b", None), ("b", float("nan"))], "k string, v double")
    got = density.kernel_density(df, "v", 400, ["k"], kernel, h=0.5).orderBy("x").toPandas()
    a = got[got.k == "a"]
    want = plain_density(a["x"].to_numpy(), x, 0.5, kernel)
    smooth = 0.03 if kernel in ("gaussian", "triangular") else 0.12  # edges of a kernel fall between grid points
    assert np.abs(a["density"].to_numpy() - want).max() < smooth * want.max()
    if kernel == "gaussian":
        step = a["x"].iloc[1] - a["x"].iloc[0]
        assert np.abs(a["density"].to_numpy() - want).max() <= step**2 * 0.4 / (8 * 0.5**3) + 1e-12
    assert np.isclose(a["density"].sum() * (a["x"].iloc[1] - a["x"].iloc[0]), 1, atol=0.01) and (got.k == "b").sum() > 0
    assert density.kernel_density(df.limit(0), "v", 50).count() == 0
