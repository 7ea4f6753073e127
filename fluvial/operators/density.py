"""Kernel density of a column by linear binning: one pass over the rows, then sums over a grid of fixed size."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Kernels by the distance in bandwidths, and how far each reaches.
KERNELS = {
    "gaussian": (lambda u: F.exp(-u * u / 2) / math.sqrt(2 * math.pi), 8.5),
    "epanechnikov": (lambda u: F.greatest(F.lit(0.0), 0.75 * (1 - u * u)), 1.0),
    "triangular": (lambda u: F.greatest(F.lit(0.0), 1 - F.abs(u)), 1.0),
    "uniform": (lambda u: F.when(F.abs(u) <= 1, 0.5).otherwise(0.0), 1.0),
}


def bandwidth(df: DataFrame, v: str, keys: Sequence[str] = (), accuracy: int = 10_000) -> DataFrame:
    """keys, n, lo, hi and h: 0.9 times the smaller of the deviation and the quartile range / 1.34, times n^(-1/5); quartiles are sketches. A constant sample has h of 1."""
    x = F.col(v).cast("double")
    good = df.where(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < math.inf))
    got = good.groupBy(*keys).agg(F.count("*").alias("n"), F.min(x).alias("lo"), F.max(x).alias("hi"), F.stddev_samp(x).alias("s"), F.percentile_approx(x, [0.25, 0.75], accuracy).alias("q"))
    spread = (F.element_at("q", 2) - F.element_at("q", 1)) / 1.34
    least = F.when(spread > 0, F.least("s", spread)).otherwise(F.col("s"))
    return got.where("n > 0").select(*keys, "n", "lo", "hi", F.when(F.coalesce(least, F.lit(0.0)) > 0, 0.9 * least * F.pow("n", F.lit(-0.2))).otherwise(1.0).alias("h"))


def kernel_density(df: DataFrame, v: str, points: int = 512, keys: Sequence[str] = (), kernel: str = "gaussian", h: Column | float | None = None, cut: float = 3.0) -> DataFrame:
    """keys, x and density at ``points`` grid points from ``cut`` bandwidths below the least value to as many above the largest.

    A value's weight is shared by its two grid points in proportion to its
    nearness, which changes the density by at most s^2 max|K''| / (8 h^3), s
    being the grid's step. Nulls, NaN and infinite values are left out.
    """
    shape, reach = KERNELS[kernel]
    size = bandwidth(df, v, keys)
    if h is not None:
        size = size.withColumn("h", F.lit(h) if not isinstance(h, Column) else h)
    size = size.withColumn("a", F.col("lo") - cut * F.col("h")).withColumn("s", (F.col("hi") - F.col("lo") + 2 * cut * F.col("h")) / (points - 1))
    x = F.col(v).cast("double")
    rows = df.where(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < math.inf)).select(*keys, x.alias("__x"))
    rows = rows.join(size, list(keys)) if keys else rows.join(F.broadcast(size), F.lit(True))  # one row
    at = (F.col("__x") - F.col("a")) / F.col("s")
    cell = F.least(F.floor(at), F.lit(points - 2)).cast("int")
    shares = F.explode(F.array(F.struct(cell.alias("g"), (1 - (at - cell)).alias("w")), F.struct((cell + 1).alias("g"), (at - cell).alias("w"))))
    grid = rows.select(*keys, shares.alias("b")).groupBy(*keys, "b.g").agg(F.sum("b.w").alias("w"))  # at most ``points`` rows a key
    grid = grid.join(size, list(keys)) if keys else grid.join(F.broadcast(size), F.lit(True))
    span = F.least(F.ceil(reach * F.col("h") / F.col("s")), F.lit(points)).cast("int")
    near = grid.withColumn("t", F.explode(F.sequence(F.greatest(F.lit(0), F.col("g") - span), F.least(F.lit(points - 1), F.col("g") + span))))
    part = F.col("w") * shape((F.col("t") - F.col("g")) * F.col("s") / F.col("h"))
    got = near.groupBy(*keys, "t").agg(F.first(F.col("a") + F.col("t") * F.col("s")).alias("x"), (F.sum(part) / F.first(F.col("n") * F.col("h"))).alias("density"))
    return got.select(*keys, "x", "density")
