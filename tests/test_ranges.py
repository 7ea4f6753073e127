"""Windows in ranges of all rows: any number of ranges gives what one window gives, and no exchange brings all rows into one partition."""

import datetime

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from fluvial.operators import series
from fluvial.operators.ranges import Ranges
from fluvial.plans import large

D = "/root/testdata/sf0.001"


@pytest.mark.parametrize("n", [1, 3, 40])
@pytest.mark.parametrize("width", [1, 2, 9, 30])
def test_halo_of_any_width(spark, n, width):
    """Ranges that are narrower than the frame take rows from several ranges."""
    df = spark.createDataFrame([(k * 7 % 25, k) for k in range(25)], "t int, v int")
    ranges = Ranges(df, ["t"], n)
    assert ranges.total == 25 and ranges.bounds[-1][2] == 25
    rows = ranges.with_halo(width, width)
    w = ranges.window
    got = rows.withColumns({"back": F.collect_list("v").over(w.rowsBetween(-width, 0)), "ahead": F.collect_list("v").over(w.rowsBetween(0, width))}).where("__own")
    v = [k for _, k in sorted((k * 7 % 25, k) for k in range(25))]
    assert {r["__i"]: (r["back"], r["ahead"]) for r in got.collect()} == {i + 1: (v[max(0, i - width) : i + 1], v[i : i + width + 1]) for i in range(25)}


def test_carries_over_empty_stretches(spark):
    """Sums, and the values around, go over ranges without any value."""
    v = [None, None, 3, None, None, None, None, None, None, 4, None, 6, *[None] * 12, 7, None]
    df = spark.createDataFrame(list(enumerate(v)), "t int, v int")
    ranges = Ranges(df, ["t"], 9)
    total = {r["t"]: r["s"] for r in ranges.running_sum(F.col("v"), "s").collect()}
    known = [(i, x) for i, x in enumerate(v) if x is not None]
    assert total == {i: (sum(x for j, x in known if j <= i) if any(j <= i for j, _ in known) else None) for i in range(len(v))}
    got = {r["t"]: (r["p"], r["o"], r["q"]) for r in ranges.around(F.col("v"), "p", "o", "q").collect()}
    for i in range(len(v)):
        back, ahead = [x for j, x in known if j <= i], [x for j, x in known if j >= i]
        assert got[i] == (back[-1] if back else None, back[-2] if len(back) > 1 else None, ahead[0] if ahead else None), i


def test_series_without_keys_equal_those_of_one_key(spark):
    at = datetime.datetime(2001, 1, 1)
    rows = [(at + datetime.timedelta(hours=k), None if k % 11 in (3, 4) or k > 57 else float((k * k) % 17)) for k in range(60)]
    df = spark.createDataFrame([("a", *r) for r in rows], "k string, ts timestamp_ntz, v double")
    for call in (lambda x, k: series.moving(x, 4, "sum", k, least=2), lambda x, k: series.cumulative(x, k), lambda x, k: series.difference(x, 2, 2, k), lambda x, k: series.interpolate(x, 2, k), lambda x, k: series.resample(x, 7, "avg", k), lambda x, k: series.refine(x, "1hour", "15min", "avg", k), lambda x, k: series.autocovariance(x.where("v is not null"), 3, k)):
        alone, keyed = call(df.drop("k"), ()), call(df, ["k"]).drop("k")
        assert set(alone.columns) == set(keyed.columns)
        a, b = (sorted(map(str, x.select(*[F.round(c, 9).alias(c) if t == "double" else F.col(c) for c, t in keyed.dtypes]).collect())) for x in (alone, keyed))
        assert a == b
        assert call(df.drop("k").limit(0), ()).count() == 0


def test_no_exchange_to_one_partition(spark):
    """Only the one row of a lag zero, or of a table of ranges, is ever broadcast."""
    for name in ("moving_average_of_all_lines", "cumulative_sum_of_all_lines", "second_difference_of_all_lines", "autocorrelation_of_all_lines", "interpolate_all_hours"):
        plan = getattr(large, name)(spark, D)._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple"))
        assert "SinglePartition" not in plan, name
    w = Window.orderBy("o_orderkey")
    alone = spark.read.parquet(f"{D}/orders.parquet").select(F.lag("o_orderkey").over(w))
    assert "SinglePartition" in alone._jdf.queryExecution().toString()
