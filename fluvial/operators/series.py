"""Time-series operators: one row an ordinate, in columns (keys..., ts, v).

Missing values are NaN or null on input; every operator turns NaN to null
first, so sums, averages and windows skip them. Series are told apart by
``keys``; orders within a series are by ``ts``.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .numbering import numbered
from .ranges import Ranges

#: Steps of regular series, as SQL intervals.
STEPS = {
    "1min": "interval 1 minute", "5min": "interval 5 minutes", "15min": "interval 15 minutes", "30min": "interval 30 minutes", "1hour": "interval 1 hour", "6hour": "interval 6 hours", "12hour": "interval 12 hours",
    "1day": "interval 1 day", "7day": "interval 7 days", "1month": "interval 1 month", "1quarter": "interval 3 months", "1year": "interval 1 year",
}
#: Hours of a step; months and longer have no fixed length.
HOURS = {"1min": 1 / 60, "5min": 1 / 12, "15min": 0.25, "30min": 0.5, "1hour": 1.0, "6hour": 6.0, "12hour": 12.0, "1day": 24.0, "7day": 168.0}


def present(v: str | Column) -> Column:
    """NaN as null."""
    c = F.col(v) if isinstance(v, str) else v
    return F.when(~F.isnan(c), c)


def seconds(ts: str) -> Column:
    """Seconds since 1970 of a stamp without time zone, as a double; independent of the session's zone."""
    return F.unix_date(F.to_date(ts)) * 86400.0 + F.hour(ts) * 3600 + F.minute(ts) * 60 + F.extract(F.lit("SECOND"), F.col(ts)).cast("double")


def _order(ts: str | Sequence[str]) -> list[str]:
    return [ts] if isinstance(ts, str) else list(ts)


def _over(keys: Sequence[str], ts: str | Sequence[str] = "ts"):
    return Window.partitionBy(*keys).orderBy(*_order(ts))


def framed(df: DataFrame, keys: Sequence[str], ts: str | Sequence[str], before: int = 0, after: int = 0):
    """Rows with ``__i`` and ``__own``, and a window that sees ``before`` rows in front of each and ``after`` behind it: by key, or in ranges of all rows."""
    if keys:
        w = _over(keys, ts)
        return df.withColumn("__i", F.row_number().over(w).cast("long")).withColumn("__own", F.lit(True)), w
    ranges = Ranges(df, _order(ts))
    return ranges.with_halo(before, after), ranges.window


def _bare(rows: DataFrame) -> DataFrame:
    return rows.drop("__i", "__own", "__part")


def regular(spark, start: str, end: str, step: str, value: float | None = None) -> DataFrame:
    """A grid from start until it reaches the end; the last stamp may lie behind it."""
    at = f"timestamp_ntz '{start}'"
    grid = spark.sql(f"select explode(sequence({at}, timestamp_ntz '{end}' + {STEPS[step]}, {STEPS[step]})) as ts")
    ahead = F.expr(f"ts - {STEPS[step]}") < F.expr(f"timestamp_ntz '{end}'")
    return grid.where((F.col("ts") == F.expr(at)) | ahead).select("ts", F.lit(value).cast("double").alias("v"))


def arithmetic(df: DataFrame, op: str, c: float, v: str = "v", at: Sequence[int] | None = None, idx: str = "idx") -> DataFrame:
    """add, subtract, multiply, divide, power, abs, log (base c), inverse; ``at`` limits it to positions."""
    if op == "divide" and c == 0:
        raise ValueError("division by zero")
    x = F.col(v)
    done = {"add": lambda: x + c, "subtract": lambda: x - c, "multiply": lambda: x * c, "divide": lambda: x / c, "power": lambda: F.pow(x, F.lit(c)), "abs": lambda: F.abs(x), "log": lambda: F.when(x > 0, F.ln(x) / F.ln(F.lit(float(c)))), "inverse": lambda: F.when(x != 0, F.lit(1.0) / x)}[op]()
    return df.withColumn(v, done if at is None else F.when(F.col(idx).isin(list(at)), done).otherwise(x))


def standardize(df: DataFrame, keys: Sequence[str] = (), v: str = "v", out: str = "z") -> DataFrame:
    """(v - mean) / sd by key: one aggregate joined back, so a hot key is split by the join and not by a window."""
    stats = df.groupBy(*keys).agg(F.avg(present(v)).alias("__m"), F.stddev_samp(present(v)).alias("__s"))
    joined = df.join(stats, list(keys)) if keys else df.join(F.broadcast(stats), F.lit(True))
    return joined.withColumn(out, F.try_divide(F.col(v) - F.col("__m"), F.col("__s"))).drop("__m", "__s")


def normalize(df: DataFrame, keys: Sequence[str] = (), v: str = "v", out: str = "z") -> DataFrame:
    """(v - min) / (max - min); zeros for a constant series."""
    stats = df.groupBy(*keys).agg(F.min(present(v)).alias("__a"), F.max(present(v)).alias("__b"))
    joined = df.join(stats, list(keys)) if keys else df.join(F.broadcast(stats), F.lit(True))
    return joined.withColumn(out, F.coalesce(F.try_divide(F.col(v) - F.col("__a"), F.col("__b") - F.col("__a")), F.lit(0.0))).drop("__a", "__b")


def missing(df: DataFrame, keys: Sequence[str] = (), v: str = "v", ts: str = "ts") -> DataFrame:
    """Rows, missing values, whether there are any, and the first and last stamp."""
    gone = F.col(v).isNull() | F.isnan(v)
    return df.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(gone).alias("n_missing"), F.coalesce(F.bool_or(gone), F.lit(False)).alias("has_missing"), F.min(ts).alias("start"), F.max(ts).alias("end"))


def replace_missing(df: DataFrame, c: float, v: str = "v") -> DataFrame:
    return df.withColumn(v, F.coalesce(present(v), F.lit(float(c))))


def clip(df: DataFrame, start: str, end: str, ts: str = "ts") -> DataFrame:
    """start <= ts <= end."""
    return df.where(F.col(ts).between(F.expr(f"timestamp_ntz '{start}'"), F.expr(f"timestamp_ntz '{end}'")))


def shift(df: DataFrame, n: int, unit: str, ts: str = "ts") -> DataFrame:
    """Moves all stamps by n days, months or years; month ends are clipped."""
    return df.withColumn(ts, F.expr(f"{ts} + interval {n} {unit}"))


def shift_all(df: DataFrame, start: str, step: str | None, keys: Sequence[str] = (), ts: str = "ts") -> DataFrame:
    """Stamps from a new start on in steps, each from the one before (a clipped month end stays clipped); without a step only the first stamp moves."""
    w = _over(keys, ts)
    at = F.expr(f"timestamp_ntz '{start}'")
    i = F.row_number().over(w)
    if step is None:
        return df.withColumn("__i", i).withColumn(ts, F.when(F.col("__i") == 1, at).otherwise(F.col(ts))).drop("__i")
    months = {"1month": 1, "1quarter": 3, "1year": 12}.get(step)
    if months is None:
        return df.withColumn("__i", i - 1).withColumn(ts, at + F.col("__i") * F.expr(STEPS[step])).drop("__i")
    # a chain of month steps keeps the smallest day it has met: from the 31st, two steps reach the 28th or 29th for good
    day, chain = F.dayofmonth(at), F.transform(F.sequence(F.lit(0), F.col("__i")), lambda k: F.dayofmonth(F.last_day(F.add_months(F.trunc(at, "month"), k.cast("int") * months))))
    least = F.least(day, F.array_min(chain))
    month = F.add_months(F.trunc(at, "month"), F.col("__i").cast("int") * months)
    moved = F.expr("timestamp_ntz '1970-01-01'") + F.make_dt_interval(F.unix_date(month) + least - 1, F.hour(at), F.minute(at), F.extract(F.lit("SECOND"), at))
    return df.withColumn("__i", i - 1).withColumn(ts, moved).drop("__i")


def add_step(ts: Column, step: str | None, n: int = 1) -> Column:
    """A stamp n steps on (or back); without a step it stays."""
    if step is None:
        return ts
    return ts + F.expr(STEPS[step]) * n if n > 0 else ts - F.expr(STEPS[step]) * -n


def denormalize(z: Column, lo: Column | float, hi: Column | float) -> Column:
    return z * (F.lit(hi) - F.lit(lo)) + F.lit(lo) if not isinstance(lo, Column) else z * (hi - lo) + lo


def destandardize(z: Column, mean: Column | float, sd: Column | float) -> Column:
    return z * sd + mean


def moving(df: DataFrame, period: int, how: str = "avg", keys: Sequence[str] = (), least: int | None = None, v: str = "v", ts: str | Sequence[str] = "ts", out: str = "m") -> DataFrame:
    """Trailing window of ``period`` rows, from row ``period`` on; null with fewer than ``least`` values (default: all)."""
    rows, w = framed(df, keys, ts, before=period - 1)
    frame = w.rowsBetween(-(period - 1), 0)
    x = present(v)
    value = {"avg": F.avg, "sum": F.sum, "min": F.min, "max": F.max}[how](x).over(frame)
    gated = F.when(F.count(x).over(frame) >= (period if least is None else least), value)
    return _bare(rows.select("*", gated.alias(out)).where((F.col("__i") >= period) & F.col("__own")))


def cumulative(df: DataFrame, keys: Sequence[str] = (), v: str = "v", ts: str | Sequence[str] = "ts", out: str = "total") -> DataFrame:
    """Running sum; missing values carry the total on."""
    x = F.coalesce(present(v), F.lit(0.0))
    if not keys:
        return _bare(Ranges(df, _order(ts)).running_sum(x, out))
    return df.withColumn(out, F.sum(x).over(_over(keys, ts).rowsBetween(Window.unboundedPreceding, 0)))


def difference(df: DataFrame, lag: int = 1, times: int = 1, keys: Sequence[str] = (), v: str = "v", ts: str | Sequence[str] = "ts", out: str = "d") -> DataFrame:
    """Lagged difference, ``times`` over; the first rows, without a partner, are left out."""
    rows, w = framed(df, keys, ts, before=lag * times)
    rows = rows.withColumn(out, F.col(v))
    for _ in range(times):
        rows = rows.withColumn(out, F.col(out) - F.lag(out, lag).over(w))
    return _bare(rows.where((F.col("__i") > lag * times) & F.col("__own")))


def block(df: DataFrame, unit: str = "month", how: str = "sum", keys: Sequence[str] = (), v: str = "v", ts: str = "ts", out: str = "b") -> DataFrame:
    """Blocks of a calendar unit: min, max, sum or avg, with the stamp of the first extreme (last row else); a block with a missing value has no sum or avg."""
    x = present(v)
    whole = F.count(x) == F.count("*")
    value = {"min": F.min(x), "max": F.max(x), "sum": F.when(whole, F.sum(x)), "avg": F.when(whole, F.avg(x))}[how]
    when = {"min": F.min_by(F.col(ts), F.struct(x, F.col(ts))), "max": F.min_by(F.col(ts), F.struct(-x, F.col(ts)))}.get(how, F.max(ts))
    at = F.date_trunc(unit, ts).cast("timestamp_ntz")
    return df.where(x.isNotNull() if how in ("min", "max") else F.lit(True)).groupBy(*keys, at.alias("block")).agg(value.alias(out), when.alias("at"))


def water_year(df: DataFrame, start_month: int = 10, how: str = "max", keys: Sequence[str] = (), v: str = "v", ts: str = "ts", season: tuple[int, int] | None = None) -> DataFrame:
    """Blocks of years that begin with ``start_month`` and are named by their end; ``season`` keeps months from..to, which may wrap. A block with a missing value has no sum or avg."""
    m = F.month(ts)
    if season:
        a, b = season
        df = df.where(m.between(a, b) if a <= b else (m >= a) | (m <= b))
        start_month = a
    year = F.year(ts) + (F.when(m >= start_month, 1).otherwise(0) if start_month > 1 else F.lit(0))
    x = present(v)
    whole = F.count(x) == F.count("*")
    value = {"min": F.min(x), "max": F.max(x), "sum": F.when(whole, F.sum(x)), "avg": F.when(whole, F.avg(x))}[how]
    return df.groupBy(*keys, year.cast("int").alias("water_year")).agg(value.alias("b"), F.count(x).alias("n"))


def fill_dates(df: DataFrame, step: str, value: float = 0.0, keys: Sequence[str] = (), v: str = "v", ts: str = "ts") -> DataFrame:
    """A full calendar from the first to the last stamp of each key; absent stamps get ``value``, others their last value."""
    one = df.groupBy(*keys, ts).agg(F.max(v).alias(v))
    grid = df.groupBy(*keys).agg(F.min(ts).alias("__a"), F.max(ts).alias("__b")).select(*keys, F.explode(F.expr(f"sequence(__a, __b, {STEPS[step]})")).alias(ts))
    return grid.join(one, [*keys, ts], "left").withColumn(v, F.coalesce(present(v), F.lit(value)))


def interpolate(df: DataFrame, most: int, keys: Sequence[str] = (), v: str = "v", ts: str = "ts", out: str = "filled") -> DataFrame:
    """Linear in time between the values around a gap of at most ``most`` rows; wider gaps, and one at the start, stay null.

    A gap at the end of at most ``most + 1`` rows goes on along the line of the
    two rows before it, if those have values or were filled.
    """
    x = present(v)
    known = F.when(x.isNotNull(), F.struct(F.col("__i").alias("i"), F.col("__s").alias("s"), x.alias("v")))
    df = df.withColumn("__s", seconds(ts))
    if keys:
        w = _over(keys, ts)
        back = w.rowsBetween(Window.unboundedPreceding, 0)
        df = df.withColumn("__i", F.row_number().over(w).cast("long")).withColumn("__n", F.count("*").over(Window.partitionBy(*keys))).withColumn("__k", known)
        df = df.withColumns({"__p": F.last("__k", ignorenulls=True).over(back), "__q": F.first("__k", ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))})
        df = df.withColumn("__o", F.when(x.isNotNull(), F.last("__k", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))))
        df = df.withColumn("__o", F.last("__o", ignorenulls=True).over(back)).drop("__k")
    else:
        ranges = Ranges(df, [ts])
        df = ranges.around(known, "__p", "__o", "__q").withColumn("__n", F.lit(ranges.total))
    s = F.col("__s")
    slope = lambda a, b: F.try_divide(F.col(f"{b}.v") - F.col(f"{a}.v"), F.col(f"{b}.s") - F.col(f"{a}.s"))
    inner = F.col("__p.v") + slope("__p", "__q") * (s - F.col("__p.s"))
    outer = F.col("__p.v") + slope("__o", "__p") * (s - F.col("__p.s"))
    whole = F.col("__q.i") - F.col("__p.i") - 1 <= most
    last = F.col("__q.i").isNull() & (F.col("__n") - F.col("__p.i") <= most + 1) & (F.col("__p.i") - F.col("__o.i") - 1 <= most)
    value = F.when(x.isNotNull(), x).when(whole, inner).when(last, outer)
    return _bare(df.withColumn(out, value).drop("__s", "__n", "__p", "__q", "__o"))


def resample(df: DataFrame, rows: int, how: str = "avg", keys: Sequence[str] = (), v: str = "v", ts: str = "ts", out: str = "r") -> DataFrame:
    """Coarser steps: blocks of ``rows`` ordinates by position."""
    x = present(v)
    df = framed(df, keys, ts)[0].withColumn("__b", F.floor((F.col("__i") - 1) / rows))
    return df.groupBy(*keys, "__b").agg(F.min(ts).alias(ts), (F.avg(x) if how == "avg" else F.sum(x)).alias(out)).drop("__b")


def refine(df: DataFrame, old: str, new: str, how: str = "avg", keys: Sequence[str] = (), v: str = "v", ts: str = "ts", out: str = "r") -> DataFrame:
    """Finer steps of a regular series: avg interpolates linearly, sum splits each value over the new steps until the next ordinate."""
    hours = HOURS[old], HOURS[new]
    parts = int(round(hours[0] / hours[1]))
    rows, w = framed(df, keys, ts, after=1)
    rows = rows.withColumn("__v", present(v)).withColumn("__next", F.lead(present(v)).over(w)).withColumn("__last", F.lead(ts).over(w).isNull()).where("__own")
    steps = F.when(F.col("__last"), F.lit(1)).otherwise(F.lit(parts))
    rows = rows.select(*keys, F.col(ts).alias("__ts"), "__v", "__next", F.explode(F.sequence(F.lit(0), steps - 1)).alias("__k"))
    value = F.when(F.col("__k") == 0, F.col("__v")).otherwise(F.col("__v") + (F.col("__next") - F.col("__v")) * F.col("__k") / parts) if how == "avg" else F.col("__v") / parts
    return rows.select(*keys, (F.col("__ts") + F.col("__k") * F.expr(STEPS[new])).alias(ts), value.alias(out))


def monthly_summary(df: DataFrame, keys: Sequence[str] = (), v: str = "v", ts: str = "ts") -> DataFrame:
    """Min, 5, 25, 50, 75, 95 %, max and mean by calendar month."""
    x = present(v)
    cuts = [0.0, 0.05, 0.25, 0.5, 0.75, 0.95, 1.0]
    got = df.groupBy(*keys, F.month(ts).alias("month")).agg(F.count(F.lit(1)).alias("n"), F.percentile(x, F.array(*(F.lit(c) for c in cuts))).alias("__p"), F.avg(x).alias("mean"))
    names = ["min", "p05", "p25", "p50", "p75", "p95", "max"]
    return got.select(*keys, "month", "n", *(F.element_at("__p", i + 1).alias(n) for i, n in enumerate(names)), "mean")


def duration(df: DataFrame, keys: Sequence[str] = (), v: str = "v", tie: str = "ts") -> DataFrame:
    """Values in descending order with the percent of time they are exceeded."""
    n = df.where(present(v).isNotNull()).groupBy(*keys).agg(F.count("*").alias("__n"))
    rows = numbered(df.where(present(v).isNotNull()), [F.desc(v), tie], keys)
    joined = rows.join(n, list(keys)) if keys else rows.join(F.broadcast(n), F.lit(True))
    return joined.withColumn("exceedance", 100.0 * F.col("__i") / (F.col("__n") + 1)).drop("__i", "__n")


def peaks_over(df: DataFrame, threshold: float, steps: int, keys: Sequence[str], v: str = "v", ts: str = "ts") -> DataFrame:
    """Peaks above a threshold: a cluster ends at the first row that is not above it and more than ``steps`` rows behind the highest row so far after the cluster's first (the last of equal ones; before there is one, the second row counts).

    Only exceedances, with their row numbers, leave the window; they are walked
    through by key, so a series has its exceedances in one task.
    """
    schema = ", ".join(f"`{k}` {t}" for k, t in df.select(*keys).dtypes) + f", cluster long, peak double, at {dict(df.dtypes)[ts]}, n long"
    over = df.withColumn("__i", F.row_number().over(_over(keys, ts))).where(present(v) > threshold).select(*keys, ts, F.col(v).cast("double").alias(v), "__i")

    def walk(key, pdf):
        pdf = pdf.sort_values("__i")
        found: list[list] = []
        last = 0
        for i, x, t in zip(pdf["__i"], pdf[v], pdf[ts], strict=True):
            cur = found[-1] if found else None
            if cur is None or (i > last + 1 and i - 1 - cur[5] > steps):
                found.append([len(found) + 1, x, t, 1, -math.inf, i + 1])
            else:
                cur[3] += 1
                if x >= cur[1]:
                    cur[1], cur[2] = x, t
                if x >= cur[4]:
                    cur[4], cur[5] = x, i
            last = i
        return pd.DataFrame([[*key, *f[:4]] for f in found], columns=[*keys, "cluster", "peak", "at", "n"])

    return over.groupBy(*keys).applyInPandas(walk, schema)


def autocovariance(df: DataFrame, lags: int, keys: Sequence[str] = (), v: str = "v", ts: str | Sequence[str] = "ts") -> DataFrame:
    """Lag, autocovariance (divided by n) and autocorrelation."""
    rows, w = framed(df, keys, ts, before=lags)
    if keys:
        rows = rows.join(df.groupBy(*keys).agg(F.avg(v).alias("__m"), F.count(v).alias("__n")), list(keys))
    else:
        parts = rows.where("__own").groupBy("__part").agg(F.sum(v).alias("s"), F.count(v).alias("n")).collect()  # a row for each range
        n = sum(r["n"] for r in parts)
        rows = rows.withColumns({"__m": F.lit(sum(float(r["s"]) for r in parts if r["n"]) / n if n else None).cast("double"), "__n": F.lit(n)})
    dev = rows.withColumn("__d", F.col(v) - F.col("__m"))
    products = F.array(*(F.col("__d") * (F.lag("__d", k).over(w) if k else F.col("__d")) for k in range(lags + 1)))
    pairs = dev.select(*keys, "__n", "__own", products.alias("__x")).where("__own").select(*keys, "__n", F.posexplode("__x").alias("lag", "__x"))
    sums = pairs.groupBy(*keys, "lag").agg(F.first("__n").alias("__n"), F.sum("__x").alias("__s"))
    whole = sums.where("lag = 0").select(*keys, F.col("__s").alias("__s0"))
    both = sums.join(whole, list(keys)) if keys else sums.join(F.broadcast(whole), F.lit(True))  # one row
    return both.select(*keys, "lag", (F.col("__s") / F.col("__n")).alias("acvf"), F.try_divide("__s", "__s0").alias("acf"))
