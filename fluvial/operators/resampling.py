"""Bootstrap of the rows of a table: all replicates in one pass.

A replicate weighs each row by a Poisson(1) count, drawn from a hash of the
row's id and the replicate's number, so a replicate is the same whatever the
partitions, and no row is sent anywhere. Statistics that are functions of sums
take one aggregate of all replicates' sums; L-moments, which need order, take
rows in ranges: a count a range and replicate, and the sums behind those counts.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import accumulate
from math import comb, exp, factorial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranges import Ranges

#: Cumulative Poisson(1) probabilities.
POISSON = np.array(list(accumulate(exp(-1) / factorial(k) for k in range(12))))
#: Factors that spread replicate and seed over 64 bits, and those of the finaliser with its shifts.
REPLICATE, SEED = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95
FINALISER, SHIFTS = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB), (30, 27, 31)
#: Weights that are held at once.
HELD = 1 << 20


def bag_weights(row: np.ndarray, tree: int, seed: int) -> np.ndarray:
    """Poisson(1) counts by hashes of row id and replicate (or tree)."""
    with np.errstate(over="ignore"):
        h = row.astype(np.uint64) ^ (np.uint64(tree + 1) * np.uint64(REPLICATE)) ^ (np.uint64(seed) * np.uint64(SEED))
        for shift, factor in zip(SHIFTS, FINALISER, strict=False):
            h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
        h ^= h >> np.uint64(SHIFTS[-1])
    return np.searchsorted(POISSON, (h >> np.uint64(11)).astype(float) / (1 << 53), "right").astype(float)


def _weights(row: np.ndarray, replicates: int, seed: int) -> np.ndarray:
    return np.stack([bag_weights(row, r, seed) for r in range(replicates)])


def weighted_sums(df: DataFrame, row: str, products: dict[str, Column], replicates: int, seed: int = 1, keys: Sequence[str] = ()) -> DataFrame:
    """keys, replicate and the weighted sum of each product (and of 1: ``w``); rows with a null product are left out."""
    names = list(products)
    rows = df.select(*keys, F.col(row).cast("long").alias("__row"), *(c.cast("double").alias(n) for n, c in products.items())).dropna(subset=["__row", *names])
    kinds = "".join(f"`{k}` {t}, " for k, t in rows.select(*keys).dtypes)

    def summed(pdf: pd.DataFrame) -> np.ndarray:
        total = np.zeros((replicates, len(names) + 1))
        x = np.column_stack([np.ones(len(pdf)), pdf[names].to_numpy(float)])
        step = max(1, HELD // replicates)
        for a in range(0, len(pdf), step):
            total += _weights(pdf["__row"].to_numpy()[a : a + step], replicates, seed) @ x[a : a + step]
        return total

    def run(batches):
        held: dict = {}
        for pdf in batches:
            parts = pdf.groupby(list(keys), dropna=False, sort=False) if keys else [((), pdf)]
            for key, part in parts:
                held[key] = held.get(key, 0) + summed(part)
            if len(held) * replicates > HELD:  # many keys: what there is goes on
                yield from sent(held)
                held = {}
        yield from sent(held)

    def sent(held):
        for key, total in held.items():
            out = pd.DataFrame(total, columns=["w", *names])
            for k, v in zip(keys, key, strict=True):
                out[k] = None if pd.isna(v) else v
            yield out.assign(replicate=np.arange(replicates))[[*keys, "replicate", "w", *names]]

    parts = rows.mapInPandas(run, f"{kinds}replicate long, w double" + "".join(f", `{n}` double" for n in names))
    return parts.groupBy(*keys, "replicate").agg(*(F.sum(n).alias(n) for n in ["w", *names]))


def moments(df: DataFrame, row: str, v: str, replicates: int, seed: int = 1, keys: Sequence[str] = ()) -> DataFrame:
    """keys, replicate, n, mean, sd, skewness (population) of each replicate; values are taken from the column's mean, so sums stay exact."""
    x = F.col(v).cast("double")
    centre = df.agg(F.avg(x)).first()[0] or 0.0
    x = x - centre
    s = weighted_sums(df, row, {"s1": x, "s2": x * x, "s3": x * x * x}, replicates, seed, keys)
    w, m = F.col("w"), F.col("s1") / F.col("w")
    var = F.col("s2") / w - m * m
    third = F.col("s3") / w - 3 * m * F.col("s2") / w + 2 * m * m * m
    return s.where("w > 0").select(*keys, "replicate", w.alias("n"), (m + centre).alias("mean"), F.sqrt(F.greatest(var, F.lit(0.0))).alias("sd"), F.try_divide(third, F.pow(F.greatest(var, F.lit(0.0)), F.lit(1.5))).alias("skew"))


def regression(df: DataFrame, row: str, y: str, x: str, replicates: int, seed: int = 1, keys: Sequence[str] = ()) -> DataFrame:
    """keys, replicate, slope and intercept of the line of each replicate."""
    a, b = F.col(x).cast("double"), F.col(y).cast("double")
    centre = df.agg(F.avg(a), F.avg(b)).first()
    a, b = a - (centre[0] or 0.0), b - (centre[1] or 0.0)
    s = weighted_sums(df, row, {"sx": a, "sy": b, "sxx": a * a, "sxy": a * b}, replicates, seed, keys)
    c = F.col
    slope = F.try_divide(c("w") * c("sxy") - c("sx") * c("sy"), c("w") * c("sxx") - c("sx") * c("sx"))
    return s.where("w > 0").withColumn("slope", slope).select(*keys, "replicate", "slope", ((c("sy") - c("slope") * c("sx")) / c("w") + (centre[1] or 0.0) - c("slope") * (centre[0] or 0.0)).alias("intercept"))


def l_moments(df: DataFrame, row: str, v: str, replicates: int, seed: int = 1) -> DataFrame:
    """replicate, n, l1, l2, t3 and t4 of each replicate.

    A row of weight w behind c others in order stands for places c + 1 .. c + w;
    their binomials add up to C(c + w, r + 1) - C(c, r + 1).
    """
    rows = df.select(F.col(row).cast("long").alias("__row"), F.col(v).cast("double").alias("__x")).dropna()
    ranges = Ranges(rows, ["__x", "__row"])
    base = ranges.rows.select("__part", "__i", "__row", "__x")

    def counted(batches):
        held: dict = {}
        for pdf in batches:
            for p, part in pdf.groupby("__part"):
                held[p] = held.get(p, 0) + sum(_weights(part["__row"].to_numpy()[a : a + 1024], replicates, seed).sum(1) for a in range(0, len(part), 1024))
        for p, n in held.items():
            yield pd.DataFrame({"p": p, "replicate": np.arange(replicates), "n": n})

    counts = base.mapInPandas(counted, "p long, replicate long, n double").groupBy("p", "replicate").agg(F.sum("n").alias("n")).toPandas()  # a number for each range and replicate
    table = counts.pivot(index="replicate", columns="p", values="n").fillna(0.0).sort_index(axis=1)
    before = dict(zip(table.columns.tolist(), (table.cumsum(axis=1) - table).to_numpy().T, strict=True))
    total = table.sum(axis=1).to_numpy()

    def inside(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("__i")
        c = before[int(pdf["__part"].iloc[0])].copy()
        b = np.zeros((replicates, 4))
        step = max(1, HELD // replicates)
        for a in range(0, len(pdf), step):
            w = _weights(pdf["__row"].to_numpy()[a : a + step], replicates, seed)
            upto = c[:, None] + np.cumsum(w, axis=1)
            low = upto - w
            for r in range(4):
                # binomials over those of the whole, as products of ratios, so no number is large
                share = lambda m, r=r: np.prod([(m - k) / (total[:, None] - k) for k in range(r + 1)], axis=0)
                b[:, r] += (share(upto) - share(low)) @ pdf["__x"].to_numpy()[a : a + step]
            c = upto[:, -1]
        return pd.DataFrame({"replicate": np.arange(replicates), **{f"b{r}": b[:, r] / (r + 1) for r in range(4)}})

    sums = base.groupBy("__part").applyInPandas(inside, "replicate long, b0 double, b1 double, b2 double, b3 double")
    b = sums.groupBy("replicate").agg(*(F.sum(f"b{r}").alias(f"b{r}") for r in range(4)))
    n = df.sparkSession.createDataFrame([(int(r), float(t)) for r, t in zip(table.index, total, strict=True)], "replicate long, n double")
    c = F.col
    terms = {r: sum((-1) ** (r - k) * comb(r, k) * comb(r + k, k) * c(f"b{k}") for k in range(r + 1)) for r in range(4)}
    return b.join(F.broadcast(n), "replicate").where("n > 3").select("replicate", "n", terms[0].alias("l1"), terms[1].alias("l2"), F.try_divide(terms[2], terms[1]).alias("t3"), F.try_divide(terms[3], terms[1]).alias("t4"))


def limits(replicates: DataFrame, statistic: str, level: float = 0.9, keys: Sequence[str] = ()) -> DataFrame:
    """Percentile limits, median and standard error of a statistic over the replicates."""
    a = (1 - level) / 2
    got = replicates.groupBy(*keys).agg(F.percentile(statistic, F.array(F.lit(a), F.lit(0.5), F.lit(1 - a))).alias("p"), F.stddev_samp(statistic).alias("error"))
    return got.select(*keys, *(F.element_at("p", i + 1).alias(n) for i, n in enumerate(("lower", "median", "upper"))), "error")
