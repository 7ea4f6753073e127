"""Vectors as integers: reading them from Arrow, and exact products and distances by float64 BLAS where bounds allow it."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Integers below this are exact in float64, and so is every partial sum of a product that stays below it.
EXACT = 1 << 53
#: Reported whole numbers end here.
LONGEST = (1 << 63) - 1
#: Rows that are multiplied at once.
BLOCK = 4096


def usable(vector: str) -> Column:
    """The vector is there, and none of its components is null, infinite or no number."""
    return F.expr(f"`{vector}` is not null and forall(cast(`{vector}` as array<double>), x -> x is not null and not isnan(x) and abs(x) < double('infinity'))")


def matrix(col: pa.Array, width: int) -> np.ndarray:
    """A column of lists of ``width`` doubles as rows."""
    return col.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(col), width)


def floors(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) as float64, exact as ``scale`` is a power of two; infinite beyond float64."""
    with np.errstate(over="ignore"):
        return np.floor(x * float(scale))


def integers(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) as Python integers, however large."""
    return np.array([[int(v) * scale if abs(v) >= EXACT else int(np.floor(v * scale)) for v in row] for row in x.tolist()], object).reshape(x.shape)


def largest(a: np.ndarray) -> np.ndarray:
    """The largest magnitude of each row."""
    return np.abs(a).max(axis=1, initial=0)


def bounded(values) -> np.ndarray:
    """Whole numbers as 64-bit ones; those beyond them become the last one that fits."""
    return np.array([max(-LONGEST, min(LONGEST, int(v))) for v in values], np.int64)


def nearest(x: np.ndarray, scale: int, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each row of floor(scale * x) the nearest centre (integers; ties: the first) and the squared distance as a whole number.

    |x|^2 - 2 x.c + |c|^2 by float64 BLAS for rows whose components, with
    those of the centres, keep every partial sum below 2^53; by 64-bit
    integers below 2^63; by Python integers beyond.
    """
    y, width = floors(x, scale), x.shape[1]
    k = int(max((abs(v) for v in centres.ravel().tolist()), default=0))
    m = largest(y)
    with np.errstate(over="ignore"):
        bound = width * (m + float(min(k, 1 << 1000))) ** 2 * (1 + 1e-12)
    label, dist = np.zeros(len(x), np.int32), np.zeros(len(x), object)
    fast = bound < EXACT
    if fast.any():
        c = centres.astype(np.float64)
        own = np.einsum("ij,ij->i", c, c)
        for rows in np.array_split(np.flatnonzero(fast), -(-int(fast.sum()) // BLOCK)):
            b = y[rows]
            d = np.einsum("ij,ij->i", b, b)[:, None] - 2.0 * (b @ c.T) + own
            label[rows] = d.argmin(1)
            dist[rows] = d.min(1).astype(np.int64)
    middle = ~fast & (bound < float(1 << 62))
    for i in np.flatnonzero(middle).tolist():
        d = ((y[i].astype(np.int64) - centres.astype(np.int64)) ** 2).sum(1)
        label[i], dist[i] = d.argmin(), int(d.min())  # sums of numpy's integers would end at 64 bits
    for i in np.flatnonzero(~fast & ~middle).tolist():
        d = ((integers(x[i : i + 1], scale) - centres) ** 2).sum(1).tolist()
        label[i] = min(range(len(d)), key=lambda j: (d[j], j))
        dist[i] = d[label[i]]
    return label, dist


def sums(x: np.ndarray, scale: int, label: np.ndarray, n: int) -> np.ndarray:
    """Componentwise sums of floor(scale * x) by label, as Python integers."""
    y = floors(x, scale)
    total = np.zeros((n, x.shape[1]), object)
    fast = largest(y) * BLOCK < EXACT
    for rows in np.array_split(np.flatnonzero(fast), max(1, -(-int(fast.sum()) // BLOCK))):
        one = np.zeros((len(rows), n))
        one[np.arange(len(rows)), label[rows]] = 1.0
        total += (one.T @ y[rows]).astype(np.int64).astype(object)
    for i in np.flatnonzero(~fast).tolist():
        total[label[i]] += integers(x[i : i + 1], scale)[0]
    return total


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of the rows of two matrices of integers (int64), exact; beyond 64 bits the last value that fits."""
    m, k = (int(np.abs(v).max(initial=0)) for v in (a, b))
    bound = a.shape[1] * m * k
    if bound < EXACT:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    if bound <= LONGEST:
        return a @ b.T
    exact = a.astype(object) @ b.astype(object).T
    return bounded(exact.ravel().tolist()).reshape(exact.shape)
