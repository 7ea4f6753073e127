"""Regression, classification and clustering.

Fits that need every row are sums over rows, made by aggregates or by one pass
of partial sums in Arrow batches; only their results, bounded by the number of
features, reach the driver.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import special as S


@dataclass
class Linear:
    names: list[str]
    coefficients: np.ndarray
    errors: np.ndarray
    t: np.ndarray
    p: np.ndarray
    r2: float
    adjusted: float
    sigma: float
    n: int
    covariance: np.ndarray | None = None
    link: str = "identity"

    def predict(self, df: DataFrame, out: str = "predicted") -> DataFrame:
        """The model's mean as one expression."""
        return df.withColumn(out, self._inverse(self._line()))

    def intervals(self, df: DataFrame, level: float = 0.9, row: bool = True) -> DataFrame:
        """Adds predicted, lower and upper: of a new row (linear models, by Student's t), or else of the mean (generalised ones: limits of the linear predictor, by the normal distribution, turned back)."""
        b = [F.lit(1.0), *(F.col(x).cast("double") for x in self.names[1:])]
        k = len(b)
        lever = sum((float(self.covariance[i, j]) * b[i] * b[j] for i in range(k) for j in range(k)), F.lit(0.0))
        linear = not math.isnan(self.r2)
        q = float(S.t_quantile(np.array((1 + level) / 2), float(self.n - k)) if linear else S.normal_quantile((1 + level) / 2))
        half = q * F.sqrt(lever + (self.sigma**2 if linear and row else 0.0))
        e = self._line()
        return df.withColumn("predicted", self._inverse(e)).withColumn("lower", self._inverse(e - half)).withColumn("upper", self._inverse(e + half))

    def summary(self) -> list[tuple[str, float, float, float, float]]:
        """(term, coefficient, error, t, p) of each term."""
        return [(n, *map(float, v)) for n, v in zip(self.names, zip(self.coefficients, self.errors, self.t, self.p, strict=True), strict=True)]

    def _line(self):
        return sum((float(c) * F.col(x).cast("double") for x, c in zip(self.names[1:], self.coefficients[1:], strict=True)), F.lit(float(self.coefficients[0])))

    def _inverse(self, e):
        from ..functions.columns import LINKS

        return LINKS[self.link][1](e)


def linear(df: DataFrame, y: str, xs: Sequence[str]) -> Linear:
    """Least squares from sums of products: one aggregate, however many rows."""
    cols = [F.lit(1.0), *(F.col(x).cast("double") for x in xs), F.col(y).cast("double")]
    k = len(cols)
    rows = df.where(" and ".join(f"`{c}` is not null" for c in [*xs, y]))
    s = rows.agg(*(F.sum(cols[i] * cols[j]).alias(f"s{i}_{j}") for i in range(k) for j in range(i, k))).first()
    m = np.array([[s[f"s{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)], float)
    xtx, xty, yy, n = m[:-1, :-1], m[:-1, -1], m[-1, -1], int(m[0, 0])
    scale = np.sqrt(np.diag(xtx))  # equilibrated, as columns differ in size
    inv = np.linalg.inv(xtx / np.outer(scale, scale)) / np.outer(scale, scale)
    b = inv @ xty
    sse = max(yy - b @ xty, 0.0)
    sst = yy - m[0, -1] ** 2 / n
    df_e = n - len(b)
    sigma = math.sqrt(sse / df_e)
    se = sigma * np.sqrt(np.diag(inv))
    t = b / se
    return Linear(["(intercept)", *xs], b, se, t, S.t_two_sided(t, np.full(len(t), float(df_e))), 1 - sse / sst, 1 - sse / df_e / (sst / (n - 1)), sigma, n, sigma**2 * inv)


#: Inverse links with derivative, and variance functions, of generalised linear models.
_INVERSE = {
    "identity": (lambda e: e, lambda e: np.ones_like(e)), "log": (np.exp, np.exp), "logit": (lambda e: 1 / (1 + np.exp(-e)), lambda e: np.exp(-np.abs(e)) / (1 + np.exp(-np.abs(e))) ** 2),
    "probit": (S.normal_cdf, S.normal_pdf), "cloglog": (lambda e: -np.expm1(-np.exp(e)), lambda e: np.exp(e - np.exp(e))),
}
_VARIANCE = {"gaussian": lambda m: np.ones_like(m), "poisson": lambda m: m, "binomial": lambda m: m * (1 - m)}
_DEFAULT = {"gaussian": "identity", "poisson": "log", "binomial": "logit"}


def glm(df: DataFrame, y: str, xs: Sequence[str], family: str = "binomial", link: str | None = None, rounds: int = 50, tol: float = 1e-10) -> Linear:
    """Maximum likelihood by reweighted least squares: each round is one pass of partial sums."""
    link_name = link or _DEFAULT[family]
    inverse, slope = _INVERSE[link_name]
    variance = _VARIANCE[family]
    k = len(xs) + 1
    data = df.select(*(F.col(x).cast("double").alias(f"x{i}") for i, x in enumerate(xs)), F.col(y).cast("double").alias("y")).dropna()
    b = np.zeros(k)
    mean = float(data.agg(F.avg("y")).first()[0])
    if (link or _DEFAULT[family]) == "identity":
        b[0] = mean
    elif family == "poisson":
        b[0] = math.log(max(mean, 1e-6))
    sums = np.zeros((k, k))
    n = 0
    for _ in range(rounds):
        def part(batches, b=b):
            total, count, dev = np.zeros((k, k + 1)), 0, 0.0
            for pdf in batches:
                x = np.column_stack([np.ones(len(pdf)), pdf.drop(columns="y").to_numpy()])
                e = x @ b if link_name == "identity" else np.clip(x @ b, -30, 30)  # far out all other means are at their limits
                mu, d = inverse(e), np.maximum(slope(e), 1e-12)
                v = np.maximum(variance(mu), 1e-12)
                w = d * d / v
                z = e + (pdf.y.to_numpy() - mu) / d
                total += np.column_stack([x.T @ (w[:, None] * x), x.T @ (w * z)])
                count += len(pdf)
                dev += float(((pdf.y.to_numpy() - mu) ** 2 / v).sum())
            yield pd.DataFrame({"s": [total.ravel().tolist()], "n": [count], "dev": [dev]})

        got = data.mapInPandas(part, "s array<double>, n long, dev double").groupBy().agg(F.array(*(F.sum(F.element_at("s", i + 1)) for i in range(k * (k + 1)))).alias("s"), F.sum("n").alias("n"), F.sum("dev").alias("dev")).first()
        total, n = np.array(got["s"]).reshape(k, k + 1), int(got["n"])
        new = np.linalg.solve(total[:, :k], total[:, k])
        done = np.abs(new - b).max() <= tol * (1 + np.abs(b).max())
        b, sums = new, total[:, :k]
        if done:
            break
    phi = got["dev"] / (n - k) if family == "gaussian" else 1.0
    cov = np.linalg.inv(sums) * phi
    se = np.sqrt(np.diag(cov))
    z = b / se
    return Linear(["(intercept)", *xs], b, se, z, 2 * (1 - S.normal_cdf(np.abs(z))), math.nan, math.nan, math.sqrt(phi), n, cov, link_name)


def naive_bayes(df: DataFrame, label: str, xs: Sequence[str]) -> dict:
    """Class shares, means and sample deviations."""
    rows = df.groupBy(label).agg(F.count("*").alias("n"), *(F.avg(x).alias(f"m_{x}") for x in xs), *(F.stddev_samp(x).alias(f"s_{x}") for x in xs)).collect()  # one row a class
    total = sum(r["n"] for r in rows)
    return {r[label]: (r["n"] / total, [r[f"m_{x}"] for x in xs], [max(r[f"s_{x}"] or 0.0, 1e-9) for x in xs]) for r in rows}


def naive_bayes_predict(df: DataFrame, model: dict, xs: Sequence[str], out: str = "predicted") -> DataFrame:
    """The class of the largest log posterior, as one expression."""
    scores = [F.struct(F.lit(math.log(p)) + sum((-0.5 * F.pow((F.col(x) - m) / s, F.lit(2)) - math.log(s) for x, m, s in zip(xs, ms, ss, strict=True)), F.lit(0.0)), F.lit(c).alias("c")) for c, (p, ms, ss) in sorted(model.items())]
    return df.withColumn(out, F.array_max(F.array(*scores))["c"])


def kmeans_arrays(x: np.ndarray, k: int, seed: int = 1, rounds: int = 1000) -> tuple[np.ndarray, np.ndarray]:
    """Lloyd's algorithm from spread starts."""
    rng = np.random.default_rng(seed)
    centres = x[[rng.integers(len(x))]]
    while len(centres) < k:
        d = ((x[:, None] - centres) ** 2).sum(2).min(1)
        centres = np.vstack([centres, x[rng.choice(len(x), p=d / d.sum())]]) if d.sum() > 0 else np.vstack([centres, x[rng.integers(len(x))]])
    for _ in range(rounds):
        own = ((x[:, None] - centres) ** 2).sum(2).argmin(1)
        new = np.array([x[own == j].mean(0) if (own == j).any() else centres[j] for j in range(k)])
        if np.allclose(new, centres):
            break
        centres = new
    return centres, own


def kmeans(df: DataFrame, vector: str, k: int, seed: int = 1, rounds: int = 20, sample: int = 5000) -> np.ndarray:
    """Centres: starts from a bounded sample of rows, then passes of partial sums over all rows."""
    n = df.count()
    some = df.select(vector).sample(fraction=min(1.0, 2 * sample / max(n, 1)), seed=seed).limit(sample).toPandas()[vector] if n > sample else df.select(vector).toPandas()[vector]
    centres, _ = kmeans_arrays(np.stack(some.to_list()).astype(float), k, seed, 50)
    d = centres.shape[1]
    for _ in range(rounds):
        def part(batches, c=centres):
            total = np.zeros((k, d + 1))
            for pdf in batches:
                x = np.stack(pdf[vector].to_list()).astype(float)
                own = ((x**2).sum(1)[:, None] - 2 * x @ c.T + (c**2).sum(1)).argmin(1)
                np.add.at(total, own, np.column_stack([np.ones(len(x)), x]))
            yield pd.DataFrame({"k": range(k), "s": total.tolist()})

        sums = np.zeros((k, d + 1))
        # k rows a partition are added up by Spark; k rows reach the driver
        for r in df.select(vector).mapInPandas(part, "k int, s array<double>").groupBy("k").agg(F.array(*(F.sum(F.element_at("s", i + 1)) for i in range(d + 1))).alias("s")).collect():
            sums[r["k"]] = r["s"]
        new = np.where(sums[:, :1] > 0, sums[:, 1:] / np.maximum(sums[:, :1], 1), centres)
        if np.allclose(new, centres, rtol=1e-10, atol=1e-12):
            break
        centres = new
    return centres


def gaussian_mixture(x: np.ndarray, k: int, seed: int = 1, rounds: int = 1000, tol: float = 1e-8) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Weights, means, covariances, and log-likelihood by expectation and maximisation."""
    x = np.asarray(x, float).reshape(len(x), -1)
    means, own = kmeans_arrays(x, k, seed)
    d = x.shape[1]
    w = np.bincount(own, minlength=k) / len(x)
    cov = np.array([np.cov(x[own == j].T, ddof=0).reshape(d, d) + 1e-6 * np.eye(d) if (own == j).sum() > 1 else np.eye(d) for j in range(k)])
    last = -math.inf
    for _ in range(rounds):
        logs = []
        for j in range(k):
            c = np.linalg.cholesky(cov[j])
            z = np.linalg.solve(c, (x - means[j]).T)
            logs.append(math.log(max(w[j], 1e-300)) - 0.5 * (z**2).sum(0) - np.log(np.diag(c)).sum() - d / 2 * math.log(2 * math.pi))
        logs = np.array(logs)
        top = logs.max(0)
        norm = top + np.log(np.exp(logs - top).sum(0))
        r = np.exp(logs - norm)
        ll = float(norm.sum())
        n = r.sum(1)
        w, means = n / len(x), (r @ x) / n[:, None]
        cov = np.array([((r[j][:, None] * (x - means[j])).T @ (x - means[j])) / n[j] + 1e-6 * np.eye(d) for j in range(k)])
        if abs(ll - last) <= tol * (1 + abs(ll)):
            break
        last = ll
    return w, means, cov, ll


def natural_breaks(x: Sequence[float], k: int, counts: Sequence[int] | None = None) -> tuple[list[float], float]:
    """Upper limits of k classes of least inner variance, and the goodness of variance fit: exact, on distinct values with counts (given, or one for each of x)."""
    v, at = np.unique(np.asarray(x, float), return_inverse=True)
    c = np.bincount(at, counts, minlength=len(v))
    k = min(k, len(v))
    w, s, q = (np.concatenate([[0], np.cumsum(t)]) for t in (c, c * v, c * v * v))

    def cost(i, j):  # values i .. j-1
        return (q[j] - q[i]) - (s[j] - s[i]) ** 2 / np.maximum(w[j] - w[i], 1)

    n = len(v)
    best, back = np.array([cost(0, j) for j in range(n + 1)]), []
    best[0] = 0
    for m in range(1, k):
        new, at = np.full(n + 1, np.inf), np.zeros(n + 1, int)
        for j in range(m + 1, n + 1):
            i = np.arange(m, j)
            t = best[i] + cost(i, j)
            b = int(np.argmin(t))
            new[j], at[j] = t[b], i[b]
        best, back = new, [*back, at]
    ends, j = [n], n
    for at in reversed(back):
        j = at[j]
        ends.append(j)
    return [float(v[e - 1]) for e in sorted(ends)], float(1 - best[n] / max(cost(0, n), 1e-300))


@dataclass
class Tree:
    feature: int = -1
    cut: float = 0.0
    value: float = 0.0
    left: Tree | None = None
    right: Tree | None = None

    def predict(self, x: np.ndarray) -> np.ndarray:
        if self.feature < 0:
            return np.full(len(x), self.value)
        go = x[:, self.feature] <= self.cut
        out = np.empty(len(x))
        out[go], out[~go] = self.left.predict(x[go]), self.right.predict(x[~go])
        return out


def grow_tree(x: np.ndarray, y: np.ndarray, rng, depth: int = 100, least: int = 2, features: int | None = None, classify: bool = False) -> Tree:
    """Splits by the largest drop of variance, or of entropy."""
    value = float(np.bincount(y.astype(int)).argmax()) if classify else float(y.mean())
    if depth == 0 or len(y) < least or (y == y[0]).all():
        return Tree(value=value)
    some = rng.choice(x.shape[1], min(features or x.shape[1], x.shape[1]), replace=False)
    best = None
    hot = np.eye(int(y.max()) + 1)[y.astype(int)] if classify else None
    for f in some:
        order = np.argsort(x[:, f], kind="stable")
        xs, n = x[order, f], np.arange(1, len(y))
        if classify:
            a = np.cumsum(hot[order], 0)
            parts = (a[:-1], a[-1] - a[:-1])
            loss = sum(-(p * np.log(np.maximum(p / np.maximum(p.sum(1, keepdims=True), 1), 1e-300))).sum(1) for p in parts)
        else:
            s, q = np.cumsum(y[order]), np.cumsum(y[order] ** 2)
            loss = (q[:-1] - s[:-1] ** 2 / n) + (q[-1] - q[:-1] - (s[-1] - s[:-1]) ** 2 / (len(y) - n))
        loss = np.where(xs[1:] > xs[:-1], loss, np.inf)
        i = int(np.argmin(loss))
        if np.isfinite(loss[i]) and (best is None or loss[i] < best[0]):
            best = (loss[i], int(f), (xs[i] + xs[i + 1]) / 2)
    if best is None:
        return Tree(value=value)
    go = x[:, best[1]] <= best[2]
    sides = [grow_tree(x[m], y[m], rng, depth - 1, least, features, classify) for m in (go, ~go)]
    return Tree(best[1], float(best[2]), value, *sides)


def knn_predict(x: np.ndarray, y: np.ndarray, test: np.ndarray, k: int, classify: bool = False) -> np.ndarray:
    """Weighted by 1 / d**2, or the most frequent class."""
    d = np.sqrt(((test[:, None] - x) ** 2).sum(2))
    at = np.argsort(d, 1, kind="stable")[:, :k]
    if classify:
        return np.array([np.bincount(y[i].astype(int)).argmax() for i in at], float)
    w = np.take_along_axis(d, at, 1)
    w = np.where(w == 0, 1.0, 1 / np.maximum(w, 1e-300) ** 2)
    return (w * y[at]).sum(1) / w.sum(1)


def knn_intervals(x: np.ndarray, y: np.ndarray, test: np.ndarray, k: int, replicates: int = 1000, level: float = 0.9, seed: int = 1) -> np.ndarray:
    """Rows (lower, median, upper, mean) of predictions from resampled training rows."""
    rng = np.random.default_rng(seed)
    got = np.array([knn_predict(x[at], y[at], test, k) for at in (rng.integers(0, len(x), len(x)) for _ in range(replicates))])
    a = (1 - level) / 2
    return np.column_stack([*np.quantile(got, [a, 0.5, 1 - a], 0), got.mean(0)])


def break_clusters(df: DataFrame, v: str, ends: Sequence[float]) -> DataFrame:
    """Count, sum, min, max and squared deviations of each class of natural breaks (upper limits included)."""
    x = F.col(v).cast("double")
    cluster = sum(((x > float(e)).cast("int") for e in ends[:-1]), F.lit(0))
    return df.where(x.isNotNull()).groupBy(cluster.alias("cluster")).agg(F.count("*").alias("n"), F.sum(x).alias("total"), F.min(x).alias("lo"), F.max(x).alias("hi"), (F.var_pop(x) * F.count("*")).alias("ssd"))
