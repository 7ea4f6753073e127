"""Likelihood searches by partial sums against searches of whole samples."""

import numpy as np
import pytest

from fluvial.functions import distributions as D
from fluvial.operators import likelihood


@pytest.mark.parametrize(("name", "params"), [("gumbel", [100.0, 20.0]), ("weibull", [3.0, 1.7]), ("gamma", [2.0, 3.5]), ("gev", [50.0, 10.0, 0.1]), ("logistic", [5.0, 2.0]), ("generalized_logistic", [5.0, 2.0, -0.1])])
def test_no_worse_than_a_whole_search(spark, name, params):
    """Two groups, one of nearly all rows: parameters as good as those of Nelder-Mead on the whole sample."""
    rng = np.random.default_rng(3)
    samples = {"a": D.evaluate(name, "quantile", rng.random(900), params), "b": D.evaluate(name, "quantile", rng.random(60), params), "c": np.ones(2)}
    df = spark.createDataFrame([(k, float(v)) for k, x in samples.items() for v in x], "k string, v double").repartition(5)
    got = {r["k"]: r for r in likelihood.fit(df, "v", ["k"], name).collect()}
    assert got["c"]["n"] == 2 and np.isnan(got["c"]["params"]).all()
    for k in "ab":
        p = D.maximum_likelihood(name, samples[k])
        want = float(D.evaluate(name, "log_pdf", samples[k], p).sum())
        mine = float(D.evaluate(name, "log_pdf", samples[k], got[k]["params"]).sum())
        assert mine >= want - 1e-3 and np.isclose(mine, got[k]["loglik"], atol=1e-3) and got[k]["converged"]
        assert np.allclose(got[k]["params"], p, rtol=2e-2, atol=2e-2)


def test_closed_forms_and_odd_rows(spark):
    """Null and NaN are left out; a null key is a group; no keys are one group; an empty table has none."""
    rows = [("a", 1.0), ("a", 2.0), ("a", 4.0), ("a", 9.0), ("a", None), ("a", float("nan")), ("a", float("inf")), (None, 1.0), (None, 3.0), (None, 3.0), (None, 5.0)]
    df = spark.createDataFrame(rows, "k string, v double")
    got = {r["k"]: r for r in likelihood.fit(df, "v", ["k"], "normal").collect()}
    assert set(got) == {"a", None} and got["a"]["n"] == 4 and np.allclose(got["a"]["params"], [4.0, np.std([1, 2, 4, 9])]) and np.allclose(got[None]["params"], [3.0, np.sqrt(2.0)])
    one = likelihood.fit(df.where("k is null"), "v", [], "exponential").collect()
    assert len(one) == 1 and one[0]["params"] == [1.0, 2.0] and np.isclose(one[0]["loglik"], -4 * (np.log(2) + 1))
    assert likelihood.fit(df.limit(0), "v", ["k"], "gumbel").count() == 0
