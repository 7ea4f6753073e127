"""Offline readers of hydrological station files, as (site, ts, v) rows.

The engine makes no network call: files are fetched elsewhere and read from any
store Spark reads. Values come in the file's unit; ``convert`` scales them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Metres of a unit of length; cubic metres a second of a unit of discharge.
LENGTH = {"millimeters": 0.001, "centimeters": 0.01, "meters": 1.0, "inches": 0.0254, "feet": 0.3048}
DISCHARGE = {"cms": 1.0, "cfs": 0.028316846592}


def convert(v: Column, source: str, target: str) -> Column:
    """Between units of length, or of discharge."""
    table = LENGTH if source in LENGTH else DISCHARGE
    return v * (table[source] / table[target])


def daily_calendar(df: DataFrame) -> DataFrame:
    """Every day between a site's first and last one; absent days are null."""
    days = df.groupBy("site").agg(F.min("ts").alias("a"), F.max("ts").alias("b")).select("site", F.explode(F.expr("sequence(a, b, interval 1 day)")).alias("ts"))
    return days.join(df, ["site", "ts"], "left")


def ghcn_daily(spark: SparkSession, path: str, element: str = "PRCP", width: int = 5) -> DataFrame:
    """Fixed-width daily files: station, year, month, element, then 31 values of ``width`` digits and 3 flags; -9999 is missing, tenths of millimetres become millimetres."""
    t = spark.read.text(path).select(F.substring("value", 1, 11).alias("site"), F.substring("value", 12, 4).cast("int").alias("y"), F.substring("value", 16, 2).cast("int").alias("m"), F.substring("value", 18, 4).alias("e"), "value")
    days = F.transform(F.sequence(F.lit(1), F.lit(31)), lambda d: F.struct(d.alias("d"), F.substring("value", 22 + (d - 1) * (width + 3), F.lit(width)).alias("s")))
    rows = t.where(F.col("e") == element).select("site", "y", "m", F.explode(days).alias("x"))
    ts = F.expr("try_make_timestamp_ntz(y, m, x.d, 0, 0, 0)")
    v = F.expr("try_cast(trim(x.s) as double)")
    return daily_calendar(rows.select("site", ts.alias("ts"), F.when(v != -9999, v / 10).alias("v")).where("ts is not null and v is not null"))


def usgs_rdb(spark: SparkSession, path: str, value: str, ts: str = "datetime", site: str = "site_no") -> DataFrame:
    """Tab-separated files with # comments, a header, and a line of column formats."""
    raw = spark.read.csv(path, sep="\t", comment="#", header=True)
    rows = raw.where(~F.col(site).rlike("^[0-9]+s$"))
    return rows.select(F.col(site).alias("site"), F.expr(f"try_cast(`{ts}` as timestamp_ntz)").alias("ts"), F.expr(f"try_cast(`{value}` as double)").alias("v"))


def usgs_measurements(spark: SparkSession, path: str) -> DataFrame:
    """JSON pages of features with monitoring_location_id, time and value."""
    raw = spark.read.schema("features array<struct<properties: struct<monitoring_location_id: string, time: string, value: string>>>").json(path, multiLine=True)
    p = raw.select(F.explode("features.properties").alias("p"))
    return p.select(F.col("p.monitoring_location_id").alias("site"), F.to_timestamp("p.time").cast("timestamp_ntz").alias("ts"), F.expr("try_cast(p.value as double)").alias("v"))


def canadian_csv(spark: SparkSession, path: str, site: str = "STATION_NUMBER", ts: str = "DATE", value: str = "DISCHARGE") -> DataFrame:
    """CSV files with a header."""
    raw = spark.read.csv(path, header=True)
    return raw.select(F.col(site).alias("site"), F.expr(f"try_cast(`{ts}` as timestamp_ntz)").alias("ts"), F.expr(f"try_cast(`{value}` as double)").alias("v"))


def australian_json(spark: SparkSession, path: str) -> DataFrame:
    """JSON lists of series: station_no and data, rows of (stamp, value)."""
    raw = spark.read.schema("station_no string, data array<array<string>>").json(path, multiLine=True)
    rows = raw.select("station_no", F.explode("data").alias("d"))
    return rows.select(F.col("station_no").alias("site"), F.to_timestamp(F.element_at("d", 1)).cast("timestamp_ntz").alias("ts"), F.expr("try_cast(try_element_at(d, 2) as double)").alias("v"))


def australian_series_ids(spark: SparkSession, path: str) -> DataFrame:
    """The first of the two steps: lists of series (a header row, then one row a series) as (site, ts_id, ts_name)."""
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", "array<array<string>>").alias("a"))
    rows = raw.select(F.element_at("a", 1).alias("h"), F.explode(F.slice("a", 2, 1 << 30)).alias("r"))
    at = lambda name: F.try_element_at("r", F.array_position("h", F.lit(name)).cast("int"))
    return rows.select(at("station_no").alias("site"), at("ts_id").alias("ts_id"), at("ts_name").alias("ts_name"))


def canadian_realtime(spark: SparkSession, path: str) -> DataFrame:
    """Five-minute CSV files: identifier, stamp with zone, value and flags, by position below a header; stamps become UTC."""
    raw = spark.read.csv(path, header=False).where(~F.col("_c0").rlike("(?i)^ ?id"))
    ts = F.to_utc_timestamp(F.to_timestamp("_c1"), F.current_timezone()).cast("timestamp_ntz")
    return raw.select(F.col("_c0").alias("site"), ts.alias("ts"), F.expr("try_cast(_c2 as double)").alias("v"))
