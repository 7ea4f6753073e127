"""Small dense linear algebra on the driver or within a group (numpy), and sums over rows in Spark."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def gram(df: DataFrame, xs: Sequence[str]) -> np.ndarray:
    """X'X of the columns, as one aggregate."""
    k = len(xs)
    c = [F.col(x).cast("double") for x in xs]
    s = df.agg(*(F.sum(c[i] * c[j]).alias(f"s{i}_{j}") for i in range(k) for j in range(i, k))).first()
    return np.array([[s[f"s{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)], float)


def multiply(a: DataFrame, b: DataFrame) -> DataFrame:
    """Product of two matrices as (i, j, v) rows."""
    r = b.select(F.col("i").alias("k"), F.col("j").alias("j2"), F.col("v").alias("w"))
    return a.join(r, a.j == r.k).groupBy("i", F.col("j2").alias("j")).agg(F.sum(F.col("v") * F.col("w")).alias("v"))


def cholesky_solve(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    c = np.linalg.cholesky(a)
    return np.linalg.solve(c.T, np.linalg.solve(c, b))


def log_determinant(a: np.ndarray) -> float:
    return float(2 * np.log(np.diag(np.linalg.cholesky(a))).sum())


def lu(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row order, unit lower and upper factor, with partial pivoting."""
    u = np.array(a, float)
    n = len(u)
    order, low = np.arange(n), np.eye(n)
    for k in range(n):
        p = k + int(np.argmax(np.abs(u[k:, k])))
        u[[k, p]], order[[k, p]] = u[[p, k]], order[[p, k]]
        low[[k, p], :k] = low[[p, k], :k]
        if u[k, k] != 0:
            low[k + 1 :, k] = u[k + 1 :, k] / u[k, k]
            u[k + 1 :] -= np.outer(low[k + 1 :, k], u[k])
    return order, low, u


def rank(a: np.ndarray, tol: float = 1e-12) -> int:
    s = np.linalg.svd(a, compute_uv=False)
    return int((s > tol * s.max()).sum()) if s.size and s.max() > 0 else 0


def null_space(a: np.ndarray, tol: float = 1e-12) -> np.ndarray:
    _, s, v = np.linalg.svd(a)
    return v[(s > tol * s.max()).sum() :].T


def log_pseudo_determinant(a: np.ndarray, tol: float = 1e-12) -> float:
    s = np.linalg.svd(a, compute_uv=False)
    return float(np.log(s[s > tol * s.max()]).sum())


def make_positive_definite(a: np.ndarray, ridge: float = 1e-10) -> np.ndarray:
    """Symmetric, with a growing ridge until Cholesky's factor exists."""
    a = (a + a.T) / 2
    while True:
        try:
            np.linalg.cholesky(a)
            return a
        except np.linalg.LinAlgError:
            a = a + ridge * np.trace(np.abs(a)) / len(a) * np.eye(len(a))
            ridge *= 10


def regularise(a: np.ndarray, eps: float = 1e-8, cap: float = 50.0) -> np.ndarray:
    """Eigenvalues floored at a share of the mean and capped at a multiple of the median."""
    w, v = np.linalg.eigh((a + a.T) / 2)
    floor = eps * max(np.trace(a), 1e-300) / len(a)
    w = np.clip(w, floor, max(cap * np.median(w), floor))
    return v @ np.diag(w) @ v.T


def qr(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Orthonormal and upper factor by Householder reflections; the diagonal of the upper one is not negative."""
    r = np.array(a, float)
    m, n = r.shape
    q = np.eye(m)
    for k in range(min(m - 1, n)):
        x = r[k:, k]
        u = x.copy()
        u[0] += np.copysign(np.linalg.norm(x), x[0])
        size = u @ u
        if size > 0:
            r[k:] -= np.outer(u, 2 / size * (u @ r[k:]))
            q[:, k:] -= np.outer(q[:, k:] @ u, 2 / size * u)
    sign = np.where(np.diag(r) < 0, -1.0, 1.0)
    k = len(sign)
    r[:k] *= sign[:, None]
    q[:, :k] *= sign
    return q[:, : max(n, 1)] if m >= n else q, r[: min(m, n)] if m >= n else r


def qr_solve(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least squares by the factors."""
    q, r = qr(a)
    y = q.T @ np.asarray(b, float)
    x = np.zeros(r.shape[1])
    for i in reversed(range(r.shape[1])):
        x[i] = (y[i] - r[i, i + 1 :] @ x[i + 1 :]) / r[i, i]
    return x


def lu_solve(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Forward and back substitution through the triangular factors."""
    order, low, up = lu(a)
    y = np.asarray(b, float)[order].copy()
    for i in range(len(y)):
        y[i] -= low[i, :i] @ y[:i]
    for i in reversed(range(len(y))):
        y[i] = (y[i] - up[i, i + 1 :] @ y[i + 1 :]) / up[i, i]
    return y


def determinant(a: np.ndarray) -> float:
    order, _, up = lu(a)
    swaps, seen = 0, list(order)
    for i in range(len(seen)):
        while seen[i] != i:
            j = seen[i]
            seen[i], seen[j] = seen[j], seen[i]
            swaps += 1
    return float(np.prod(np.diag(up))) * (-1) ** swaps


def gauss_jordan(a: np.ndarray, b: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Inverse, and solution for b (the inverse again without one), by elimination with row pivots."""
    n = len(a)
    rest = np.eye(n) if b is None else np.column_stack([np.eye(n), np.asarray(b, float).reshape(n, -1)])
    w = np.column_stack([np.array(a, float), rest])
    for k in range(n):
        p = k + int(np.argmax(np.abs(w[k:, k])))
        if w[p, k] == 0:
            raise ValueError("the matrix is singular")
        w[[k, p]] = w[[p, k]]
        w[k] /= w[k, k]
        other = np.arange(n) != k
        w[other] -= np.outer(w[other, k], w[k])
    return w[:, n : 2 * n], w[:, 2 * n :] if b is not None else w[:, n : 2 * n]


def eigen(a: np.ndarray, sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Values, largest first, and vectors of a symmetric matrix by Jacobi's rotations."""
    d = np.array(a, float)
    n = len(d)
    v = np.eye(n)
    for _ in range(sweeps):
        if np.abs(d - np.diag(np.diag(d))).max(initial=0) <= 1e-14 * max(np.abs(d).max(initial=0), 1e-300):
            break
        for p in range(n - 1):
            for q in range(p + 1, n):
                if d[p, q] == 0:
                    continue
                t = (d[q, q] - d[p, p]) / (2 * d[p, q])
                t = (1.0 if t >= 0 else -1.0) / (abs(t) + np.sqrt(t * t + 1))
                c = 1 / np.sqrt(t * t + 1)
                turn = np.array([[c, t * c], [-t * c, c]])
                d[:, [p, q]] = d[:, [p, q]] @ turn
                d[[p, q]] = turn.T @ d[[p, q]]
                v[:, [p, q]] = v[:, [p, q]] @ turn
    order = np.argsort(-np.diag(d), kind="stable")
    return np.diag(d)[order], v[:, order]


def effective_dimensions(a: np.ndarray) -> float:
    """(sum of eigenvalues)**2 over the sum of their squares."""
    w, _ = eigen(a)
    return float(w.sum() ** 2 / (w**2).sum())


def svd_solve(a: np.ndarray, b: np.ndarray, tol: float = 1e-12) -> np.ndarray:
    """Least squares of least norm."""
    u, s, v = np.linalg.svd(np.asarray(a, float), full_matrices=False)
    keep = s > tol * s.max(initial=0)
    return v[keep].T @ ((u.T @ np.asarray(b, float))[keep] / s[keep])


def column_space(a: np.ndarray, tol: float = 1e-12) -> np.ndarray:
    u, s, _ = np.linalg.svd(np.asarray(a, float))
    return u[:, : int((s > tol * s.max(initial=0)).sum())]


def add(a: DataFrame, b: DataFrame, factor: float = 1.0) -> DataFrame:
    """Sum of two matrices as (i, j, v) rows; absent cells are 0."""
    return a.select("i", "j", "v").unionByName(b.select("i", "j", (F.col("v") * factor).alias("v"))).groupBy("i", "j").agg(F.sum("v").alias("v"))


def transpose(a: DataFrame) -> DataFrame:
    return a.select(F.col("j").alias("i"), F.col("i").alias("j"), "v")


def triangle(a: DataFrame, upper: bool = True) -> DataFrame:
    """The cells on one side of the diagonal, and the diagonal."""
    return a.where("i <= j" if upper else "i >= j")


def trace(a: DataFrame) -> DataFrame:
    return a.where("i = j").agg(F.sum("v").alias("trace"))


def covariance_matrix(df: DataFrame, xs: Sequence[str], keys: Sequence[str] = (), population: bool = False, correlation: bool = False) -> DataFrame:
    """(i, j, v) rows of the covariances or correlations of columns, from one aggregate."""
    f = F.corr if correlation else F.covar_pop if population else F.covar_samp
    pairs = [(i, j) for i in range(len(xs)) for j in range(i, len(xs))]
    s = df.groupBy(*keys).agg(*(f(F.col(xs[i]).cast("double"), F.col(xs[j]).cast("double")).alias(f"c{i}_{j}") for i, j in pairs))
    cells = [F.struct(F.lit(xs[i]).alias("i"), F.lit(xs[j]).alias("j"), F.col(f"c{min(i, j)}_{max(i, j)}").alias("v")) for i in range(len(xs)) for j in range(len(xs))]
    return s.select(*keys, F.explode(F.array(*cells)).alias("c")).select(*keys, "c.i", "c.j", "c.v")
