"""Paired data: curve lookup by bracket join, areas, validation, simplification."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C

#: Axis transforms: forward and back.
TRANSFORMS = {"none": (lambda c: c, lambda c: c), "log": (lambda c: F.log10(F.greatest(c, F.lit(1e-16))), lambda c: F.pow(F.lit(10.0), c)), "normal_z": (C.normal_quantile, C.normal_cdf)}


def lookup(df: DataFrame, q: str, curve: DataFrame, x: str = "x", y: str = "y", out: str = "value", x_transform: str = "none", y_transform: str = "none", most_points: int = 256) -> DataFrame:
    """Linear interpolation of ``curve`` at column ``q``, on transformed axes, clamped at its ends.

    A curve of at most ``most_points`` points is sorted on the driver and becomes
    nested conditions, one for each halving of the points; a longer one is joined
    by brackets.
    """
    fx, fy, back = TRANSFORMS[x_transform][0], TRANSFORMS[y_transform][0], TRANSFORMS[y_transform][1]
    points = curve.select(fx(F.col(x)).cast("double").alias("x"), fy(F.col(y)).cast("double").alias("y"))
    got = sorted((r["x"], r["y"]) for r in points.limit(most_points + 1).collect() if r["x"] is not None)
    if len(got) <= most_points:
        return df.withColumn(out, back(_bracket(fx(F.col(q).cast("double")), got)))
    # the curve's points and the queries in one range-partitioned order would do without a window over everything;
    # brackets are joined by a bucket of x instead, so no task holds the whole curve
    s = points.agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.count("*").alias("n")).first()
    width = max((s["hi"] - s["lo"]) / max(s["n"] // 1000, 1), 1e-300)
    bucket = lambda c: F.floor((c - s["lo"]) / width)
    inside = Window.partitionBy("b").orderBy("x")
    cut = points.withColumn("b", bucket(F.col("x")))
    firsts = cut.groupBy("b").agg(F.min(F.struct("x", "y")).alias("f"))
    heads = Window.orderBy("b")  # one row a thousand points
    nxt = firsts.select("b", F.lead("f").over(heads).alias("nf"), F.lead("b").over(heads).alias("nb"))
    seg = cut.join(nxt, "b").select("b", "x", "y", F.coalesce(F.lead(F.struct("x", "y")).over(inside), F.col("nf")).alias("n"), F.coalesce("nb", F.col("b")).alias("nb"))
    seg = seg.where("n is not null").withColumn("b", F.explode(F.sequence("b", F.when(F.col("n.x") > F.col("x"), bucket(F.col("n.x"))).otherwise(F.col("b")))))
    v = F.greatest(F.least(fx(F.col(q)), F.lit(s["hi"])), F.lit(s["lo"]))
    rows = df.withColumn("__v", v).withColumn("b", bucket(F.col("__v")))
    joined = rows.join(seg, (rows.b == seg.b) & (F.col("__v") >= seg.x) & ((F.col("__v") < F.col("n.x")) | ((F.col("n.x") == s["hi"]) & (F.col("__v") == s["hi"]))), "left")
    value = F.col("y") + (F.col("n.y") - F.col("y")) * F.coalesce(F.try_divide(F.col("__v") - F.col("x"), F.col("n.x") - F.col("x")), F.lit(0.0))
    return joined.select(*df.columns, back(value).alias(out))


def _bracket(v: Column, points: list[tuple[float, float]]) -> Column:
    """Interpolation by a tree of comparisons over sorted points, clamped; null for null and NaN. Of equal x the last point counts."""
    xs = [p[0] for p in points]
    if not points:
        return F.lit(None).cast("double")

    def part(a: int, b: int) -> Column:
        if b - a == 1:
            (x0, y0), (x1, y1) = points[a], points[b]
            return F.lit(y1) if x1 == x0 else F.lit(y0) + (v - x0) * ((y1 - y0) / (x1 - x0))
        m = (a + b) // 2
        return F.when(v < xs[m], part(a, m)).otherwise(part(m, b))

    inner = part(0, len(points) - 1) if len(points) > 1 else F.lit(points[0][1])
    return F.when(v.isNull() | F.isnan(v), None).when(v <= xs[0], points[0][1]).when(v >= xs[-1], points[-1][1]).otherwise(inner)


def area(curve: DataFrame, key: str = "curve_id", x: str = "x", y: str = "y") -> DataFrame:
    """Trapezoid areas along x and along y, by curve."""
    w = Window.partitionBy(key).orderBy(x)
    s = curve.select(key, F.col(x).alias("x"), F.col(y).alias("y"), F.lag(x).over(w).alias("px"), F.lag(y).over(w).alias("py"))
    return s.groupBy(key).agg(F.sum(0.5 * (F.col("x") - F.col("px")) * (F.col("y") + F.col("py"))).alias("area_y"), F.sum(0.5 * (F.col("y") - F.col("py")) * (F.col("x") + F.col("px"))).alias("area_x"))


def invert(curve: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    return curve.select(*(F.col(y if c == x else x if c == y else c).alias(c) for c in curve.columns))


def order_errors(curve: DataFrame, order: str = "idx", key: str = "curve_id", x: str = "x", y: str = "y", rising: bool = True, strict: bool = True) -> DataFrame:
    """Rows that break the order of either axis against the row before."""
    w = Window.partitionBy(key).orderBy(order)

    def bad(c: str) -> Column:
        d = (F.col(c) - F.lag(c).over(w)) * (1 if rising else -1)
        return d <= 0 if strict else d < 0

    return curve.withColumn("bad_x", F.coalesce(bad(x), F.lit(False))).withColumn("bad_y", F.coalesce(bad(y), F.lit(False))).where("bad_x or bad_y")


def _spread(x, y, a, b):
    """Perpendicular distances of points a+1..b-1 from the line through a and b."""
    dx, dy = x[b] - x[a], y[b] - y[a]
    return np.abs(dx * (y[a] - y[a + 1 : b]) - (x[a] - x[a + 1 : b]) * dy) / max(np.hypot(dx, dy), 1e-300)


def peucker(x: np.ndarray, y: np.ndarray, tol: float) -> np.ndarray:
    """Which points a line simplification keeps (farthest point recursion)."""
    keep = np.zeros(len(x), bool)
    keep[[0, -1]] = True
    todo = [(0, len(x) - 1)]
    while todo:
        a, b = todo.pop()
        if b - a > 1:
            far = _spread(x, y, a, b)
            i = int(np.argmax(far))
            if far[i] > tol:
                keep[a + 1 + i] = True
                todo += [(a, a + 1 + i), (a + 1 + i, b)]
    return keep


def visvalingam(x: np.ndarray, y: np.ndarray, points: int) -> np.ndarray:
    """Drops the point of the smallest triangle until ``points`` are left."""
    at = list(range(len(x)))
    while len(at) > max(points, 2):
        i, j, k = np.array(at[:-2]), np.array(at[1:-1]), np.array(at[2:])
        size = np.abs((x[j] - x[i]) * (y[k] - y[i]) - (x[k] - x[i]) * (y[j] - y[i])) / 2
        del at[1 + int(np.argmin(size))]
    keep = np.zeros(len(x), bool)
    keep[at] = True
    return keep


def lang(x: np.ndarray, y: np.ndarray, tol: float, ahead: int = 10) -> np.ndarray:
    """Looks ahead for the farthest point whose chord stays within the tolerance."""
    keep = np.zeros(len(x), bool)
    keep[[0, -1]] = True
    a = 0
    while a < len(x) - 1:
        b = min(a + ahead, len(x) - 1)
        while b - a > 1 and _spread(x, y, a, b).max() > tol:
            b -= 1
        keep[b] = True
        a = b
    return keep


def simplify(curve: DataFrame, method: str, amount: float, key: str = "curve_id", x: str = "x", y: str = "y") -> DataFrame:
    """peucker or lang (tolerance), or visvalingam (points to keep), by curve."""

    def one(pdf):
        pdf = pdf.sort_values(x, kind="stable")
        if len(pdf) < 3:
            return pdf
        a, b = pdf[x].to_numpy(float), pdf[y].to_numpy(float)
        keep = visvalingam(a, b, int(amount)) if method == "visvalingam" else {"peucker": peucker, "lang": lang}[method](a, b, amount)
        return pdf[keep]

    return curve.groupBy(key).applyInPandas(one, curve.schema)


def spline_second(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Second derivatives of the natural cubic spline."""
    n = len(x)
    h = np.diff(x)
    a = np.zeros((n, n))
    r = np.zeros(n)
    a[0, 0] = a[-1, -1] = 1
    for i in range(1, n - 1):
        a[i, i - 1 : i + 2] = h[i - 1], 2 * (h[i - 1] + h[i]), h[i]
        r[i] = 6 * ((y[i + 1] - y[i]) / h[i] - (y[i] - y[i - 1]) / h[i - 1])
    return np.linalg.solve(a, r)


def spline(x: Sequence[float], y: Sequence[float], q) -> np.ndarray:
    x, y, q = (np.asarray(v, float) for v in (x, y, q))
    m = spline_second(x, y)
    i = np.clip(np.searchsorted(x, q, "right") - 1, 0, len(x) - 2)
    h = x[i + 1] - x[i]
    a, b = (x[i + 1] - q) / h, (q - x[i]) / h
    return a * y[i] + b * y[i + 1] + ((a**3 - a) * m[i] + (b**3 - b) * m[i + 1]) * h * h / 6


def neville(x: Sequence[float], y: Sequence[float], q: float, order: int = 3) -> float:
    """Polynomial through the order + 1 points around q."""
    x, y = np.asarray(x, float), np.asarray(y, float)
    start = int(np.clip(np.searchsorted(x, q) - (order + 1) // 2, 0, max(len(x) - order - 1, 0)))
    a, p = x[start : start + order + 1], y[start : start + order + 1].copy()
    for k in range(1, len(a)):
        p = ((q - a[k:]) * p[:-1] - (q - a[:-k]) * p[1:]) / (a[:-k] - a[k:])
    return float(p[0])


def bilinear(xs: Sequence[float], ys: Sequence[float], z, x, y) -> np.ndarray:
    """Table lookup in two directions, clamped at the edges."""
    xs, ys, z = (np.asarray(v, float) for v in (xs, ys, z))
    x, y = np.clip(x, xs[0], xs[-1]), np.clip(y, ys[0], ys[-1])
    i, j = (np.clip(np.searchsorted(a, v, "right") - 1, 0, len(a) - 2) for a, v in ((xs, x), (ys, y)))
    u, v = (x - xs[i]) / (xs[i + 1] - xs[i]), (y - ys[j]) / (ys[j + 1] - ys[j])
    return (1 - u) * (1 - v) * z[i, j] + u * (1 - v) * z[i + 1, j] + (1 - u) * v * z[i, j + 1] + u * v * z[i + 1, j + 1]


def convolve(p: Sequence[tuple[float, float]], q: Sequence[tuple[float, float]], points: int = 1024) -> tuple[np.ndarray, np.ndarray]:
    """Grid and density of the sum of two independent tabulated densities (x, f)."""
    a, b = np.array(sorted(p)), np.array(sorted(q))
    step = ((a[-1, 0] - a[0, 0]) + (b[-1, 0] - b[0, 0])) / (points - 1)
    ga, gb = (np.arange(t[0, 0], t[-1, 0] + step / 2, step) for t in (a, b))
    f = np.convolve(np.interp(ga, *a.T), np.interp(gb, *b.T)) * step
    return a[0, 0] + b[0, 0] + step * np.arange(len(f)), f


def neville_error(x: Sequence[float], y: Sequence[float], q: float, order: int = 3) -> tuple[float, float]:
    """The polynomial's value, and its difference to the one of an order less."""
    value = neville(x, y, q, order)
    return value, value - neville(x, y, q, order - 1) if order > 0 else 0.0


def search_index(q: Column, values: Sequence[float], descending: bool = False) -> Column:
    """Index (from 0) of the last value at or before q; -1 before the first one, N behind the last, N - 1 at it."""
    n = len(values)
    v = F.array(*(F.lit(float(a)) for a in values))
    first, last = F.lit(float(values[0])), F.lit(float(values[-1]))
    passed = F.size(F.filter(v, lambda a: a >= q if descending else a <= q)) - 1
    outside = (q < last) if descending else (q > last)
    return F.when(outside, n).when(q == last, n - 1).otherwise(passed)


def curve_sample(curve: DataFrame, p: float | None = None, x: str = "x", dist: str = "dist", params: str = "params") -> DataFrame:
    """A curve of uncertain ordinates (each a distribution) at a probability; without one, at the means."""
    from ..functions import distributions as D

    if p is not None:
        return curve.select(*(c for c in curve.columns if c not in (dist, params)), D.apply("quantile", F.lit(float(p)), F.col(dist), F.col(params)).alias("y"))

    @F.pandas_udf("double")
    def mean(d: pd.Series, v: pd.Series) -> pd.Series:
        return pd.Series([D.moments(n, list(a))[0] for n, a in zip(d, v, strict=True)])

    return curve.select(*(c for c in curve.columns if c not in (dist, params)), mean(dist, params).alias("y"))


def uncertain_errors(curve: DataFrame, key: str = "curve_id", order: str = "idx", x: str = "x", dist: str = "dist", params: str = "params", at: Sequence[float] = (0.05, 0.5, 0.95)) -> DataFrame:
    """Rows that break the rising order of x, or of the distributions' quantiles at any of some probabilities, or whose parameters are invalid."""
    from ..functions import distributions as D

    @F.pandas_udf("string")
    def problem(d: pd.Series, v: pd.Series) -> pd.Series:
        return pd.Series([D.validate(n, list(a)) for n, a in zip(d, v, strict=True)])

    w = Window.partitionBy(key).orderBy(order)
    rows = curve.withColumn("problem", problem(dist, params)).withColumn("bad_x", F.coalesce(F.col(x) <= F.lag(x).over(w), F.lit(False)))
    q = rows.withColumn("__q", F.when(F.col("problem") == "", F.array(*(D.apply("quantile", F.lit(float(p)), F.col(dist), F.col(params)) for p in at))))
    falls = F.exists(F.zip_with("__q", F.lag("__q").over(w), lambda a, b: a < b), lambda t: t)
    return q.withColumn("bad_y", F.coalesce(falls, F.lit(False))).drop("__q").where("bad_x or bad_y or problem <> ''")


def uncertain_lookup(df: DataFrame, q: str, curve: DataFrame, p: float | None = None, out: str = "value", **options) -> DataFrame:
    """``lookup`` in a curve of uncertain ordinates at a probability."""
    return lookup(df, q, curve_sample(curve, p), out=out, **options)


def without(curve: DataFrame, rows: DataFrame, on: Sequence[str]) -> DataFrame:
    """The curve without some ordinates."""
    return curve.join(rows.select(*on).distinct(), list(on), "left_anti")
