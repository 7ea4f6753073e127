"""Queries and operators that take every row of their tables."""

import numpy as np
from fluvial.operators import learning, relational
from fluvial.plans import models

D = "/root/testdata/sf0.001"


def test_nearest_of_more_queries_than_one_block(spark):
    x = np.random.default_rng(3).normal(size=(60, 3))
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, e array<double>")
    got = {(r["q"], r["rank"]): r["n"] for r in relational.nearest(v, v, "id", "e", 2, most_queries=7).collect()}
    d = ((x[:, None] - x) ** 2).sum(2) + np.diag(np.full(60, np.inf))
    assert got == {(i, k + 1): n for i, row in enumerate(np.argsort(d, 1)[:, :2].tolist()) for k, n in enumerate(row)}


def test_forest_intervals_of_all_parts(spark, tmp_path):
    rows = [(k, k % 2 + 1, 100.0 if k < 200 else 300.0) for k in range(400)]
    spark.createDataFrame(rows, "p_partkey long, p_size int, p_retailprice double").write.parquet(f"{tmp_path}/part.parquet")
    got = models.random_forest_intervals(spark, str(tmp_path)).collect()
    assert sorted(r["p_partkey"] for r in got) == list(range(400))
    assert all(abs(r["mean"] - 200) < 5 for r in got)  # the first 200 rows alone give 100


def test_posterior_of_all_customers(spark, tmp_path):
    x = 4500 + 3000 * np.random.default_rng(5).normal(size=2000)
    x[:100] -= 3000
    spark.createDataFrame([(k, float(v)) for k, v in enumerate(x)], "c_custkey long, c_acctbal double").write.parquet(f"{tmp_path}/customer.parquet")
    got = {r["param"]: r for r in models.posterior_of_normal(spark, str(tmp_path)).collect()}
    error = x.std() / len(x) ** 0.5
    assert abs(got["mu"]["mean"] - x.mean()) < 0.5 * error and 0.7 * error < got["mu"]["sd"] < 1.4 * error
    assert abs(got["log_sigma"]["mean"] - np.log(x.std())) < 0.02


def test_natural_breaks_weigh_sizes_by_parts(spark, tmp_path):
    sizes = [1] * 500 + [2] * 500 + [3] * 500 + [4] * 500 + [10, 20, 30, 40, 50]
    spark.createDataFrame(list(enumerate(sizes)), "p_partkey long, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    ends, fit = learning.natural_breaks(sizes, 5)
    got = models.natural_breaks_of_sizes(spark, str(tmp_path)).collect()
    assert [r["upper"] for r in got] == ends != learning.natural_breaks(sorted(set(sizes)), 5)[0]
    assert all(abs(r["fit"] - fit) < 1e-9 for r in got)
