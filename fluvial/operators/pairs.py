"""Counts over all pairs of rows of a key, without a task that holds the key.

Inversions (pairs in order of x whose y are not) are counted by two cuts, like
two levels of a wavelet tree. Rows are sorted by x into ranges, and again by y
into ranges; ties in y are ordered by place in x, so equal values split and
count none. A pair in one x range is counted there; a pair in one y range and
two x ranges there; all others by the numbers of rows in each x and y range.
Only keys that lie in several x ranges (fewer than there are ranges) need the
second cut.
"""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranges import Ranges

_COUNT = "decimal(38, 0)"


def inversions(y: np.ndarray) -> int:
    """Pairs i < j with y[i] > y[j]: by bits of the ranks, from the highest: each zero counts the ones before it among the ranks that agree above."""
    _, rank = np.unique(y, return_inverse=True)
    total, order = 0, np.arange(len(rank))
    for bit in reversed(range(int(rank.max(initial=0)).bit_length())):
        r = rank[order]
        one, above = (r >> bit) & 1, r >> (bit + 1)
        ones = np.cumsum(one)
        start = np.flatnonzero(np.concatenate([[True], above[1:] != above[:-1]])) if len(r) else np.empty(0, np.int64)
        before = (ones - one)[start]
        total += int((ones - np.repeat(before, np.diff(np.append(start, len(r)))))[one == 0].sum())
        order = order[np.lexsort((one, above))]
    return total


def _between(counts: pd.DataFrame) -> int:
    """Pairs of rows in an earlier x range and a later y range."""
    p, b = (np.unique(counts[c], return_inverse=True)[1] for c in ("p", "b"))
    table = np.zeros((p.max() + 1, b.max() + 1), object)
    np.add.at(table, (p, b), counts["n"].to_numpy(object))
    earlier = np.cumsum(table, 0) - table
    beyond = np.cumsum(earlier[:, ::-1], 1)[:, ::-1] - earlier
    return int((table * beyond).sum())


def swapped(df: DataFrame, x: Sequence[str | Column], y: str, keys: Sequence[str]) -> DataFrame:
    """keys and swapped: pairs of rows in order of x, ties in x by y, with y strictly in reverse order."""
    keys = list(keys) or ["__all"]
    rows = df if keys != ["__all"] else df.withColumn("__all", F.lit(0))
    rows = rows.withColumn("__y", F.col(y).cast("double")).withColumn("__t", F.monotonically_increasing_id())
    ranges = Ranges(rows, [*keys, *x, "__y", "__t"])
    base = ranges.rows.select(*keys, "__y", F.col("__part").alias("p"), F.col("__i").alias("i"))
    kinds = ", ".join(f"`{k}` {t}" for k, t in base.select(*keys).dtypes)

    def inside(key, pdf):
        pdf = pdf.sort_values("i", kind="stable")
        return pd.DataFrame([[*key[1:], Decimal(inversions(pdf["__y"].to_numpy()))]], columns=[*keys, "swapped"])

    parts = base.groupBy("p", *keys).applyInPandas(inside, f"{kinds}, swapped {_COUNT}")
    wide = base.groupBy(*keys).agg(F.min("p").alias("lo"), F.max("p").alias("hi")).where("lo < hi").select(*keys)
    names = wide.collect()  # fewer than there are ranges
    if names:
        small = F.broadcast(df.sparkSession.createDataFrame(names, wide.schema).select(*(F.col(k).alias(f"__w{i}") for i, k in enumerate(keys))))
        same = F.lit(True)
        for i, k in enumerate(keys):
            same = same & F.col(k).eqNullSafe(F.col(f"__w{i}"))
        by_y = Ranges(base.join(small, same, "left_semi"), [*keys, "__y", "i"])
        cut = by_y.rows.select(*keys, "p", "i", "__y", F.col("__part").alias("b"))

        def across(key, pdf):
            pdf = pdf.sort_values("i", kind="stable")
            v, p = pdf["__y"].to_numpy(), pdf["p"].to_numpy()
            edges = [0, *(np.flatnonzero(p[1:] != p[:-1]) + 1).tolist(), len(p)]
            own = sum(inversions(v[a:b]) for a, b in zip(edges[:-1], edges[1:], strict=True))
            return pd.DataFrame([[*key[1:], Decimal(inversions(v) - own)]], columns=[*keys, "swapped"])

        counts = cut.groupBy(*keys, "p", "b").agg(F.count("*").alias("n")).toPandas()  # a row for each two ranges that share rows
        rest = [(*(k if isinstance(k, tuple) else (k,)), Decimal(_between(part))) for k, part in counts.groupby(keys, dropna=False, sort=False)]
        rest = [tuple(None if isinstance(v, float) and np.isnan(v) else v.item() if hasattr(v, "item") else v for v in r) for r in rest]
        parts = parts.unionByName(cut.groupBy("b", *keys).applyInPandas(across, f"{kinds}, swapped {_COUNT}"))
        parts = parts.unionByName(df.sparkSession.createDataFrame(rest, parts.schema))
    return parts.groupBy(*keys).agg(F.sum("swapped").cast(_COUNT).alias("swapped"))


def tied(df: DataFrame, columns: Sequence[str], keys: Sequence[str], out: str) -> DataFrame:
    """keys and out: pairs of rows that agree in the columns."""
    n = F.col("__n").cast("decimal(19, 0)")
    return df.groupBy(*keys, *columns).agg(F.count("*").alias("__n")).groupBy(*keys).agg(F.sum((n * (n - 1) / 2).cast(_COUNT)).cast(_COUNT).alias(out))
