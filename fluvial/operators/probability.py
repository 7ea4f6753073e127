"""Probabilities of several events: unions, joints, exclusive combinations."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import special as S


def unions(df: DataFrame, p: str, keys: Sequence[str] = ()) -> DataFrame:
    """Union and joint probability of the events of each group, by kind of dependence, and adjustment factors."""
    x = F.col(p)
    none = 1 - F.product(1 - x)
    total = F.sum(x)
    return df.groupBy(*keys).agg(
        none.alias("independent"), F.max(x).alias("positive"), F.least(F.lit(1.0), total).alias("negative"), F.product(x).alias("joint"), F.min(x).alias("joint_positive"),
        F.try_divide(none, total).alias("common_cause"), F.when(total > 1, 1 / total).otherwise(1.0).alias("exclusive"),
    )


def pair(a: Column, b: Column, rho: float = 0.0) -> dict[str, Column]:
    """A and B, A or B, A not B, and A given B, for independent (0) or fully dependent (+-1) events."""
    both = a * b if rho == 0 else F.least(a, b) if rho >= 1 else F.greatest(a + b - 1, F.lit(0.0))
    return {"and": both, "or": a + b - both, "a_not_b": a - both, "b_not_a": b - both, "a_given_b": F.try_divide(both, b), "b_given_a": F.try_divide(both, a)}


def all_subsets(n: int) -> list[tuple[int, ...]]:
    """All non-empty subsets of n events by size."""
    return [c for k in range(1, n + 1) for c in combinations(range(n), k)]


def bivariate_normal(h: float, k: float, rho: float) -> float:
    """P(X <= h, Y <= k) by Plackett's integral over the correlation."""
    x, w = np.polynomial.legendre.leggauss(60)
    t = np.arcsin(rho) * (x + 1) / 2
    with np.errstate(divide="ignore"):
        f = np.exp(-(h * h + k * k - 2 * h * k * np.sin(t)) / (2 * np.cos(t) ** 2))
    return float(S.normal_cdf(h) * S.normal_cdf(k) + np.arcsin(rho) / 2 * (w * f).sum() / (2 * np.pi))


def multivariate_normal_cdf(z: Sequence[float], corr: np.ndarray, n: int = 20_000, seed: int = 1) -> float:
    """P(all Z <= z) by sequential conditioning on quasi-random points."""
    z, c = np.asarray(z, float), np.linalg.cholesky(np.asarray(corr, float) + 1e-12 * np.eye(len(z)))
    d = len(z)
    if d == 2:
        return bivariate_normal(z[0], z[1], float(corr[0][1]))
    rng = np.random.default_rng(seed)
    roots = np.sqrt(np.array([p for p in range(2, 400) if all(p % q for q in range(2, int(p**0.5) + 1))][: d - 1], float))
    u = np.abs(2 * ((np.arange(1, n + 1)[:, None] * roots + rng.random(d - 1)) % 1) - 1)
    e = np.full(n, S.normal_cdf(z[0] / c[0, 0]))
    f, y = e.copy(), np.zeros((n, d))
    for i in range(1, d):
        y[:, i - 1] = S.normal_quantile(np.clip(u[:, i - 1] * e, 1e-15, 1 - 1e-15))
        e = S.normal_cdf((z[i] - y[:, :i] @ c[i, :i]) / c[i, i])
        f *= e
    return float(f.mean())


def joint_pcm(p: Sequence[float], corr: np.ndarray) -> float:
    """Joint probability by the product of conditional marginals."""
    z = S.normal_quantile(np.asarray(p, float))
    r = np.array(corr, float)
    out = 1.0
    for i in range(len(z)):
        q = float(S.normal_cdf(z[i]))
        out *= q
        if q <= 0:
            return 0.0
        a = float(S.normal_pdf(z[i])) / q
        b = a * (z[i] + a)
        for j in range(i + 1, len(z)):
            z[j] = (z[j] + r[i, j] * a) / np.sqrt(max(1 - r[i, j] ** 2 * b, 1e-12))
        rest = r.copy()
        for j in range(i + 1, len(z)):
            for k in range(j + 1, len(z)):
                rest[j, k] = rest[k, j] = (r[j, k] - r[i, j] * r[i, k] * b) / np.sqrt(max((1 - r[i, j] ** 2 * b) * (1 - r[i, k] ** 2 * b), 1e-12))
        r = rest
    return out


def union_by_inclusion(p: Sequence[float], corr: np.ndarray, joint=joint_pcm, tol: float = 1e-9) -> float:
    """Inclusion and exclusion over subsets, stopped when a size adds less than ``tol``."""
    p, total = np.asarray(p, float), 0.0
    for k in range(1, len(p) + 1):
        part = sum(joint(p[list(c)], np.asarray(corr)[np.ix_(c, c)]) if k > 1 else p[c[0]] for c in combinations(range(len(p)), k))
        total += part if k % 2 else -part
        if abs(part) < tol:
            break
    return float(min(max(total, 0.0), 1.0))


def exclusive(p: Sequence[float], corr: np.ndarray | None = None, joint=joint_pcm) -> dict[tuple[int, ...], float]:
    """Probability that exactly the events of each non-empty subset happen."""
    p = np.asarray(p, float)
    n = len(p)
    if corr is None:
        return {c: float(np.prod([p[i] if i in c else 1 - p[i] for i in range(n)])) for c in all_subsets(n)}
    all_of = {c: joint(p[list(c)], np.asarray(corr)[np.ix_(c, c)]) if len(c) > 1 else float(p[c[0]]) for c in all_subsets(n)}
    return {c: max(0.0, sum((-1) ** (len(s) - len(c)) * v for s, v in all_of.items() if set(c) <= set(s))) for c in all_of}
