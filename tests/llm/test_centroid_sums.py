"""Operator 11: sums of distances that 64-bit integers made, beside ones far beyond 64 bits."""

import numpy as np
import pytest

from fluvial.llm import vectors

from test_centroids import same


@pytest.mark.parametrize("scale", [2.0**20, 2.0**24, 2.0**40, 1e200])
def test_distances_of_all_magnitudes_in_one_sum(spark, scale):
    rng = np.random.default_rng(4)
    rows = [(i, v) for i, v in enumerate((rng.normal(size=(60, 4)) * np.where(rng.random(60) < 0.3, scale, 1.0)[:, None]).tolist())]
    same(spark, [*rows, (99, [1e300, -1e300, 0.0, 1.0])])


def test_distances_are_whole_numbers_without_bounds():
    x = np.array([[1.0] * 4, [2.0**22] * 4, [2.0**40] * 4])
    _, dist = vectors.nearest(x, 64, np.zeros((1, 4), object))
    assert [type(d) for d in dist] == [int] * 3 and dist.tolist() == [4 * (64 * int(v)) ** 2 for v in x[:, 0]]
