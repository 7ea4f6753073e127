"""Fitting the power of Box-Cox and Yeo-Johnson transforms by profile likelihood, in aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C

TRANSFORMS = {"box_cox": C.box_cox, "yeo_johnson": C.yeo_johnson}


def log_jacobian(kind: str, x: Column, lam: float) -> Column:
    """Logarithm of the transform's derivative."""
    return (lam - 1) * F.ln(x) if kind == "box_cox" else (lam - 1) * F.signum(x) * F.log1p(F.abs(x))


def profile(kind: str, x: Column, lam: float) -> Column:
    """Log-likelihood of a power, with mean and variance at their best, as an aggregate."""
    y = TRANSFORMS[kind](x, lam)
    return -F.count(x) / 2.0 * F.ln(F.var_pop(y)) + F.sum(log_jacobian(kind, x, lam))


def log_likelihoods(df: DataFrame, v: str, powers: Sequence[float], kind: str = "box_cox", keys: Sequence[str] = ()) -> DataFrame:
    """Rows (lambda, loglik) by key, all powers in one pass. Box-Cox skips values that are not positive."""
    x = F.col(v).cast("double")
    x = F.when(x > 0, x) if kind == "box_cox" else x
    wide = df.groupBy(*keys).agg(*(profile(kind, x, float(p)).alias(f"__{i}") for i, p in enumerate(powers)))
    cells = [F.struct(F.lit(float(p)).alias("lambda"), F.col(f"__{i}").alias("loglik")) for i, p in enumerate(powers)]
    return wide.select(*keys, F.explode(F.array(*cells)).alias("c")).select(*keys, "c.lambda", "c.loglik")


def fit_power(df: DataFrame, v: str, kind: str = "box_cox", lo: float = -5.0, hi: float = 5.0, tol: float = 1e-6, cuts: int = 20) -> float | None:
    """The most likely power of all rows between two limits: passes of ``cuts`` powers each, around the best one of the pass before. None without values, or where nothing is defined."""
    while True:
        step = (hi - lo) / cuts
        rows = log_likelihoods(df, v, [lo + step * i for i in range(cuts + 1)], kind).where("loglik is not null and not isnan(loglik)").collect()  # one row a power
        if not rows:
            return None
        best = max(rows, key=lambda r: r["loglik"])["lambda"]
        if step <= tol:
            return float(best)
        lo, hi = max(lo, best - step), min(hi, best + step)
