"""Natural breaks by cells against those of all values."""

import numpy as np
import pytest

from fluvial.operators import breaks
from fluvial.operators.learning import natural_breaks


@pytest.mark.parametrize("k", [1, 2, 3, 5])
def test_equal_to_all_values(spark, k, monkeypatch):
    monkeypatch.setattr(breaks, "CELLS", 12)
    rng = np.random.default_rng(k)
    x = np.concatenate([rng.normal(0, 1, 120), rng.normal(6, 0.5, 60), rng.gamma(2, 4, 60)]).round(2)
    got, fit = breaks.natural_breaks(spark.createDataFrame([(float(v),) for v in x], "v double").repartition(4), "v", k)
    values, counts = np.unique(x, return_counts=True)
    want, good = natural_breaks(values.tolist(), k, counts.tolist())
    assert np.allclose(got, want) and np.isclose(fit, good)


def test_odd_columns(spark):
    df = spark.createDataFrame([(1.0,), (1.0,), (2.0,), (None,), (float("nan"),)], "v double")
    assert breaks.natural_breaks(df, "v", 2) == ([1.0, 2.0], 1.0)
    assert breaks.natural_breaks(df, "v", 5)[0] == [1.0, 2.0]
    assert breaks.natural_breaks(df.limit(0), "v", 2)[0] == []
