"""DataFrame operators on small frames with missing values, ties and empty groups."""

import math

import pytest

from fluvial.functions import columns as C
from fluvial.operators import curves, learning, series, stats
from fluvial.sources import stations, tables
from fluvial.streaming import windows
from pyspark.sql import functions as F


def frame(spark, values):
    rows = [("a", f"2024-01-{i + 1:02d} 00:00:00", v) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "k string, s string, v double").select("k", F.col("s").cast("timestamp_ntz").alias("ts"), "v")


def column(df, name):
    return [r[name] for r in df.orderBy("ts").collect()]


def test_series_with_gaps(spark):
    df = frame(spark, [1.0, float("nan"), 3.0, None, None, 9.0])
    assert column(series.interpolate(df, 1, ["k"]), "filled") == [1.0, 2.0, 3.0, None, None, 9.0]
    assert column(series.cumulative(df, ["k"]), "total") == [1.0, 1.0, 4.0, 4.0, 4.0, 13.0]
    assert column(series.moving(df, 2, "sum", ["k"]), "m") == [None] * 5
    assert series.missing(df, ["k"]).first()["n_missing"] == 3
    assert series.block(df, "month", "sum", ["k"]).first()["b"] is None and series.block(df, "month", "max", ["k"]).first()["b"] == 9.0


def test_regular_grid_reaches_end(spark):
    assert series.regular(spark, "2024-01-01", "2024-01-02 12:00:00", "1day").count() == 3
    assert series.regular(spark, "2024-01-01", "2024-01-03", "1day", 1.0).count() == 3


def test_empty_and_constant(spark):
    empty = frame(spark, [])
    assert stats.describe(empty, "v", ["k"]).count() == 0 and stats.l_moments(empty, "v", ["k"]).count() == 0
    assert column(series.normalize(frame(spark, [2.0, 2.0]), ["k"]), "z") == [0.0, 0.0]
    assert stats.histogram(frame(spark, [2.0, 2.0]), "v", 3).collect()[0]["freq"] == 2
    with pytest.raises(ValueError):
        series.arithmetic(empty, "divide", 0.0)


def test_transforms_invert(spark):
    df = spark.createDataFrame([(-2.0,), (0.0,), (3.0,)], "x double")
    for lam in (0.0, 0.5, 2.0):
        assert all(abs(r[0]) < 1e-9 for r in df.select(C.yeo_johnson_inverse(C.yeo_johnson(F.col("x"), lam), lam) - F.col("x")).collect())
    u = spark.createDataFrame([(0.1,), (0.7,)], "u double")
    for name, (link, inverse, _) in C.LINKS.items():
        assert all(abs(r[0]) < 1e-9 for r in u.select(inverse(link(F.col("u"))) - F.col("u")).collect()), name


def test_long_curve_lookup_equals_short(spark):
    curve = spark.range(200).select(F.col("id").cast("double").alias("x"), F.pow(F.col("id"), F.lit(2)).cast("double").alias("y"))
    q = spark.createDataFrame([(-5.0,), (0.0,), (3.5,), (77.25,), (199.0,), (500.0,)], "q double")
    a = {r["q"]: r["value"] for r in curves.lookup(q, "q", curve).collect()}
    b = {r["q"]: r["value"] for r in curves.lookup(q, "q", curve, most_points=10).collect()}
    assert all(math.isclose(a[k], b[k]) for k in a) and a[-5.0] == 0 and a[500.0] == 199**2


def test_glm_recovers_logit(spark):
    rows = [(float(x), float(y)) for x, p in ((0, 1), (1, 3), (2, 6), (3, 9)) for y in [1] * p + [0] * (10 - p)]
    m = learning.glm(spark.createDataFrame(rows, "x double, y double"), "y", ["x"])
    mean = sum(1 / (1 + math.exp(-(m.coefficients[0] + m.coefficients[1] * x))) for x, _ in rows)
    assert math.isclose(mean, sum(y for _, y in rows), rel_tol=1e-6)


def test_sources(spark, tmp_path):
    df = frame(spark, [1.0, 2.5]).select("ts", "v")
    tables.write_series_xml(df, f"{tmp_path}/s.xml")
    assert sorted(map(tuple, tables.read_series_xml(spark, f"{tmp_path}/s.xml").collect())) == sorted(map(tuple, df.collect()))
    (tmp_path / "x.dly").write_text("USC00000001202401PRCP" + "".join(f"{v:5d}   " for v in [10, -9999, 30] + [-9999] * 28) + "\n")
    got = stations.ghcn_daily(spark, f"{tmp_path}/x.dly").orderBy("ts").collect()
    assert len(got) == 3 and [r["v"] for r in got[:3]] == [1.0, None, 3.0]
    (tmp_path / "x.rdb").write_text("# c\nsite_no\tdatetime\tq\n15s\t20d\t14n\n01\t2024-01-01\t5.5\n")
    assert stations.usgs_rdb(spark, f"{tmp_path}/x.rdb", "q").first()["v"] == 5.5
    bad = spark.createDataFrame([([0.1, 0.2],), ([0.2, 0.2],), ([0.5, 1.0],)], "p array<double>")
    assert [r[0] for r in bad.select(tables.probability_list_errors(F.col("p"))).collect()] == [False, True, True]


def test_stream_equals_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(events.schema).parquet(f"{tmp_path}/in")
    q = windows.block_stream(stream, "1 day").writeStream.outputMode("complete").format("memory").queryName("blocks").option("checkpointLocation", f"{tmp_path}/c").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("blocks").agg(F.sum("n")).first()[0] == events.count()


def test_streaming_exceedances(spark, tmp_path):
    rows = [("a", f"2024-01-01 00:{m:02d}:00", v) for m, v in ((0, 5.0), (1, 7.0), (2, 1.0), (30, 6.0), (59, 1.0))]
    spark.createDataFrame(rows, "event_type string, s string, value double").select("event_type", F.to_timestamp("s").alias("ts"), "value").coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("event_type string, ts timestamp, value double").parquet(f"{tmp_path}/in")
    windows.use_rocks(spark)
    q = windows.exceedances(stream, 2.0, 300).writeStream.outputMode("append").format("memory").queryName("peaks").option("checkpointLocation", f"{tmp_path}/c").start()
    q.processAllAvailable()
    q.stop()
    assert (7.0, 2) in [(r["peak"], r["n"]) for r in spark.table("peaks").collect()]
