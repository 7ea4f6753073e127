"""Factors of matrices with many rows: QR by partition and a tree, singular values, and mixtures by partial sums.

A row of the table is a row of the matrix, an array of d components; d x d
matrices fit the driver and a task, rows are never gathered.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _rows(df: DataFrame, vector: str) -> DataFrame:
    """The vectors that are there and have no null, NaN or infinite component."""
    good = F.expr(f"`{vector}` is not null and forall(cast(`{vector}` as array<double>), x -> x is not null and not isnan(x) and abs(x) < double('infinity'))")
    return df.where(good).select(F.col(vector).cast("array<double>").alias("v"))


def _matrix(col: pa.Array) -> np.ndarray:
    return col.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(col), -1)


def upper(a: np.ndarray) -> np.ndarray:
    """The triangular factor with a diagonal that is not negative."""
    r = np.linalg.qr(a, mode="r")
    return r * np.where(np.diag(r) < 0, -1.0, 1.0)[:, None]


def tall_r(df: DataFrame, vector: str) -> np.ndarray:
    """R of the QR decomposition of all rows: each batch is folded into its partition's factor, and factors are folded in a tree. An empty table has a matrix of no rows."""

    def run(batches):
        r = None
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column("v"))
                a = x if r is None else np.vstack([r, x])
                r = upper(a) if len(a) >= a.shape[1] else a
        if r is not None:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(r)], pa.binary())], names=["r"])

    def fold(a, b):
        if a is None or b is None:
            return a if b is None else b
        both = np.vstack([a, b])
        return upper(both) if len(both) >= both.shape[1] else both

    parts = _rows(df, vector).mapInArrow(run, "r binary").rdd.map(lambda x: pickle.loads(x["r"]))
    r = parts.treeAggregate(None, fold, fold)
    if r is None:
        return np.zeros((0, 0))
    return upper(r) if len(r) < r.shape[1] else r


def tall_q(df: DataFrame, vector: str, r: np.ndarray, keep: Sequence[str]) -> DataFrame:
    """``keep`` and q: each row of the orthogonal factor, by a second pass (R of full rank)."""
    good = df.where(F.col(vector).isNotNull()).select(*keep, F.col(vector).cast("array<double>").alias("__v"))
    kinds = ", ".join(f"`{c}` {t}" for c, t in df.select(*keep).dtypes)

    def run(batches):
        for batch in batches:
            q = np.linalg.solve(r.T, _matrix(batch.column("__v")).T).T
            flat = pa.ListArray.from_arrays(pa.array(np.arange(0, q.size + 1, max(1, q.shape[1])), pa.int32()), pa.array(q.ravel()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), flat], names=[*keep, "q"])

    return good.mapInArrow(run, f"{kinds}, q array<double>")


def singular_values(df: DataFrame, vector: str) -> tuple[np.ndarray, np.ndarray]:
    """Singular values, the largest first, and the right singular vectors as columns: those of R."""
    r = tall_r(df, vector)
    if not r.size:
        return np.zeros(0), np.zeros((0, 0))
    _, s, vt = np.linalg.svd(r)
    return s, vt.T


@dataclass
class Mixture:
    """Weights, means, covariances, and the log-likelihood before each round's step."""

    weights: np.ndarray
    means: np.ndarray
    covariances: np.ndarray
    loglik: list[float]

    def logs(self, x: np.ndarray) -> np.ndarray:
        """Log of weight times density: a row for each component."""
        out = []
        for w, m, c in zip(self.weights, self.means, self.covariances, strict=True):
            low = np.linalg.cholesky(c)
            z = np.linalg.solve(low, (x - m).T)
            out.append(math.log(max(w, 1e-300)) - 0.5 * (z**2).sum(0) - np.log(np.diag(low)).sum() - len(m) / 2 * math.log(2 * math.pi))
        return np.array(out)


def fit_mixture(df: DataFrame, vector: str, means: np.ndarray, weights: np.ndarray | None = None, covariances: np.ndarray | None = None, rounds: int = 200, tol: float = 1e-9, ridge: float = 1e-6) -> Mixture:
    """A normal mixture of all rows by expectation and maximisation: a round is one aggregate of counts, first and second moments by responsibility and of the log-likelihood.

    Moments are taken about the current means, so they stay exact. A round
    never lowers the log-likelihood (but for ``ridge`` on the diagonals); it
    stops at a relative gain below ``tol``.
    """
    rows = _rows(df, vector)
    means = np.atleast_2d(np.asarray(means, float))
    k, d = means.shape
    eye = np.eye(d)
    now = Mixture(np.full(k, 1 / k) if weights is None else np.asarray(weights, float), means, np.array([eye] * k) if covariances is None else np.asarray(covariances, float).reshape(k, d, d), [])
    width = 1 + d + d * d

    def totals(held: Mixture) -> np.ndarray:
        def run(batches):
            total = np.zeros((k, width + 2))
            for batch in batches:
                x = _matrix(batch.column("v")).reshape(-1, d)
                logs = held.logs(x)
                top = logs.max(0, initial=-np.inf)
                norm = top + np.log(np.exp(logs - top).sum(0))
                for j, r in enumerate(np.exp(logs - norm)):
                    off = x - held.means[j]
                    total[j] += np.concatenate([[r.sum()], r @ off, ((r[:, None] * off).T @ off).ravel(), [norm.sum(), len(x)]])
            yield pa.RecordBatch.from_arrays([pa.array([total.ravel().tolist()], pa.list_(pa.float64()))], names=["t"])

        parts = rows.mapInArrow(run, "t array<double>").select(F.posexplode("t").alias("i", "t")).groupBy("i").agg(F.sum("t").alias("t")).collect()  # k (d^2 + d + 3) sums
        out = np.zeros(k * (width + 2))
        for r in parts:
            out[r["i"]] = r["t"]
        return out.reshape(k, width + 2)

    for _ in range(rounds):
        t = totals(now)
        n, all_rows, ll = t[:, 0], t[0, -1], float(t[0, -2])
        if all_rows == 0:
            break
        gain = ll - now.loglik[-1] if now.loglik else math.inf
        safe = np.maximum(n, 1e-300)[:, None]
        shift = t[:, 1 : d + 1] / safe
        cov = t[:, d + 1 : width].reshape(k, d, d) / safe[:, :, None] - shift[:, :, None] * shift[:, None, :] + ridge * eye
        now = Mixture(n / all_rows, now.means + shift, cov, [*now.loglik, ll])
        if abs(gain) <= tol * (1 + abs(ll)):
            break
    return now


def assigned(df: DataFrame, vector: str, mixture: Mixture, keep: Sequence[str]) -> DataFrame:
    """``keep``, the likeliest component of each row and its probability."""
    kinds = ", ".join(f"`{c}` {t}" for c, t in df.select(*keep).dtypes)

    def run(batches):
        for pdf in batches:
            x = np.array(pdf["__v"].to_list(), float).reshape(len(pdf), -1)
            logs = mixture.logs(x)
            p = np.exp(logs - logs.max(0))
            p /= p.sum(0)
            yield pd.concat([pdf[list(keep)], pd.DataFrame({"component": p.argmax(0), "probability": p.max(0)}, index=pdf.index)], axis=1)

    return df.where(F.col(vector).isNotNull()).select(*keep, F.col(vector).cast("array<double>").alias("__v")).mapInPandas(run, f"{kinds}, component long, probability double")
