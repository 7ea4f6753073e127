"""Regression trees and forests that learn from a table, level by level.

Features are cut into bins by thresholds (all midpoints where values are few,
quantiles else). One pass a level adds up weight, sum and square of the target
for each bin of each feature in each open node of all trees; the best split of
a node is found on these aggregates by running sums over its bins. Trees of a
forest weigh rows by Poisson counts from a hash of row id and tree, so a bag is
the same whatever the partitions. The driver holds thresholds and trees (at
most 2^depth leaves each), never rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import discard, materialise
from .resampling import bag_weights

#: Bytes of the sums that a task holds; more trees than fit take more passes a level.
HELD = 1 << 26


@dataclass
class Forest:
    """Trees as arrays by heap position (children of i: 2i + 1, 2i + 2): feature (-1: leaf), threshold and mean."""

    features: list[str]
    cuts: list[np.ndarray]
    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray
    levels: list[int] = field(default_factory=list)

    def predict(self, x: np.ndarray) -> np.ndarray:
        """One column of predictions a tree."""
        out = np.empty((len(x), len(self.feature)))
        for t in range(len(self.feature)):
            at = np.zeros(len(x), np.int64)
            while True:
                f = self.feature[t, at]
                inner = np.flatnonzero(f >= 0)
                if not len(inner):
                    break
                right = x[inner, f[inner]] > self.threshold[t, at[inner]]
                at[inner] = 2 * at[inner] + 1 + right
            out[:, t] = self.value[t, at]
        return out

    def expression(self, tree: int = 0, at: int = 0) -> Column:
        """One tree as nested conditions; null where a feature is null."""
        if self.feature[tree, at] < 0:
            return F.lit(float(self.value[tree, at]))
        below, above = self.expression(tree, 2 * at + 1), self.expression(tree, 2 * at + 2)
        x = F.col(self.features[self.feature[tree, at]])
        return F.when(x <= float(self.threshold[tree, at]), below).when(x.isNotNull(), above)


def thresholds(df: DataFrame, features: Sequence[str], bins: int) -> list[np.ndarray]:
    """Between all different values of a feature if there are at most ``bins`` of them, else between approximate quantiles."""
    few = df.agg(*(F.approx_count_distinct(f, 0.05).alias(f) for f in features)).first()
    out = []
    for f in features:
        values = None
        if few[f] <= 1.3 * bins:
            values = [r[0] for r in df.select(F.col(f).cast("double").alias("v")).where("v is not null and not isnan(v)").distinct().limit(bins + 1).collect()]
        if values is None or len(values) > bins:
            shares = [k / bins for k in range(bins + 1)]
            values = df.agg(F.percentile_approx(F.col(f).cast("double"), shares, 100 * bins)).first()[0] or []
        v = np.unique(np.array(values, float))
        out.append((v[1:] + v[:-1]) / 2)
    return out


def binned(df: DataFrame, target: str, features: Sequence[str], cuts: list[np.ndarray], key: Sequence[str]) -> DataFrame:
    """row (hash of the key), y, and the bin of each feature in one array; rows with a null or NaN are left out."""
    good = F.lit(True)
    for c in (target, *features):
        good = good & F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))
    rows = df.where(good).select(F.xxhash64(*key).alias("row"), F.col(target).cast("double").alias("y"), *(F.col(f).cast("double").alias(f"__f{i}") for i, f in enumerate(features)))

    def run(batches):
        for pdf in batches:
            bins = np.stack([np.searchsorted(c, pdf[f"__f{i}"].to_numpy(), "left") for i, c in enumerate(cuts)], 1)
            yield pd.DataFrame({"row": pdf["row"], "y": pdf["y"], "bins": list(bins.astype(np.int16))})

    return materialise(rows.mapInPandas(run, "row long, y double, bins array<smallint>"))


def _histograms(rows: DataFrame, trees: list[int], level: int, feature: np.ndarray, cut: np.ndarray, sizes: list[int], bag: int | None) -> DataFrame:
    """tree, node, feature, bin: w, s, q of the rows that reach the open nodes of a level."""
    first, nodes = 2**level - 1, 2**level
    start = np.concatenate([[0], np.cumsum([s + 1 for s in sizes])])

    def run(batches):
        total = np.zeros((len(trees), nodes, start[-1], 3))
        for pdf in batches:
            y, bins = pdf["y"].to_numpy(), np.stack(pdf["bins"].to_list()) if len(pdf) else np.zeros((0, len(sizes)), np.int16)
            for k, t in enumerate(trees):
                w = np.ones(len(y)) if bag is None else bag_weights(pdf["row"].to_numpy(), t, bag)
                at = np.zeros(len(y), np.int64)
                live = w > 0
                for _ in range(level):
                    f = feature[t, at]
                    live &= f >= 0
                    at = np.where(live, 2 * at + 1 + (bins[np.arange(len(y)), np.maximum(f, 0)] > cut[t, at]), at)
                rows_ = np.flatnonzero(live)
                own = (at[rows_] - first) * start[-1]
                for i in range(len(sizes)):
                    place = own + start[i] + bins[rows_, i]
                    for m, weight in enumerate((w[rows_], w[rows_] * y[rows_], w[rows_] * y[rows_] ** 2)):
                        total[k, :, :, m] += np.bincount(place, weight, minlength=nodes * start[-1]).reshape(nodes, start[-1])
        k, node, place = np.nonzero(total[..., 0])
        f = np.searchsorted(start, place, "right") - 1
        got = total[k, node, place]
        yield pd.DataFrame({"tree": np.array(trees, np.int64)[k], "node": node + first, "feature": f, "bin": place - start[f], "w": got[:, 0], "s": got[:, 1], "q": got[:, 2]})

    parts = rows.mapInPandas(run, "tree long, node long, feature long, bin long, w double, s double, q double")
    return parts.groupBy("tree", "node", "feature", "bin").agg(*(F.sum(c).alias(c) for c in "wsq"))


def best_splits(hist: DataFrame, n_features: int, tried: int, seed: int) -> DataFrame:
    """Of each node its sums, and the split that leaves least squares: feature, bin, sums below; features tried are drawn by a hash."""
    w = Window.partitionBy("tree", "node", "feature")
    upto = w.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    rows = hist.withColumns({f"c{c}": F.sum(c).over(upto) for c in "wsq"} | {f"t{c}": F.sum(c).over(w) for c in "wsq"})
    gain = F.when(F.col("cw") < F.col("tw"), F.col("cs") ** 2 / F.col("cw") + (F.col("ts") - F.col("cs")) ** 2 / (F.col("tw") - F.col("cw")) - F.col("ts") ** 2 / F.col("tw"))
    if tried < n_features:
        gain = F.when(F.expr(f"size(filter(sequence(0, {n_features - 1}), g -> xxhash64(tree, node, cast(g as bigint), {seed}L) < xxhash64(tree, node, feature, {seed}L))) < {tried}"), gain)
    rows = rows.withColumn("gain", gain)
    best = F.min_by(F.struct("feature", "bin", "gain", "cw", "cs", "cq"), F.struct(-F.coalesce("gain", F.lit(-1.0)), F.col("feature"), F.col("bin")))
    return rows.groupBy("tree", "node").agg(F.first("tw").alias("w"), F.first("ts").alias("s"), F.first("tq").alias("q"), best.alias("b"))


def grow(df: DataFrame, target: str, features: Sequence[str], key: Sequence[str], depth: int = 6, least: float = 2, bins: int = 256, trees: int = 1, tried: int | None = None, bag: int | None = None) -> Forest:
    """Trees of at most ``depth`` levels; a node of less than ``least`` weight, or that no split improves, is a leaf.

    ``bag`` is the seed of Poisson bags (none: each row once); ``tried`` features are drawn for each node (default all).
    """
    cuts = thresholds(df, features, bins)
    sizes = [len(c) for c in cuts]
    rows = binned(df, target, features, cuts, key)
    heap = 2 ** (depth + 1) - 1
    feature, cut = np.full((trees, heap), -1, np.int64), np.zeros((trees, heap), np.int64)
    threshold, value = np.full((trees, heap), np.nan), np.full((trees, heap), np.nan)
    open_ = list(range(trees))
    for level in range(depth):
        each = 2**level * (sum(sizes) + len(sizes)) * 24
        step = max(1, HELD // each)
        left = set()
        for k in range(0, len(open_), step):
            hist = _histograms(rows, open_[k : k + step], level, feature, cut, sizes, bag)
            for r in best_splits(hist, len(features), tried or len(features), bag or 0).collect():  # a row for each open node
                t, i, b = r["tree"], r["node"], r["b"]
                value[t, i] = r["s"] / r["w"]
                if r["w"] < least or b["gain"] is None or b["gain"] <= 1e-12 * max(r["q"], 1e-300):
                    continue
                feature[t, i], cut[t, i], threshold[t, i] = b["feature"], b["bin"], cuts[b["feature"]][b["bin"]]
                value[t, 2 * i + 1], value[t, 2 * i + 2] = b["cs"] / b["cw"], (r["s"] - b["cs"]) / (r["w"] - b["cw"])
                left.add(t)
        open_ = sorted(left)
        if not open_:
            break
    discard(rows)
    return Forest(list(features), cuts, feature, threshold, value)


def forest_intervals(df: DataFrame, forest: Forest, keep: Sequence[str], level: float = 0.9) -> DataFrame:
    """``keep`` and lower, median, upper and mean of the trees' predictions for each row; null where a feature is null."""
    held = df.sparkSession.sparkContext.broadcast((forest.feature, forest.threshold, forest.value))  # trees of bounded depth
    names, kinds = list(forest.features), ", ".join(f"`{c}` {t}" for c, t in df.select(*keep).dtypes)
    a = (1 - level) / 2

    def run(batches):
        trees = Forest(names, [], *held.value)
        for pdf in batches:
            x = pdf[[f"__f{i}" for i in range(len(names))]].to_numpy(float)
            got = np.full((len(x), 4), np.nan)
            good = np.flatnonzero(~np.isnan(x).any(1))
            different, back = np.unique(x[good], axis=0, return_inverse=True)  # rows of equal features share a prediction
            for k in range(0, len(different), 1024):
                p = trees.predict(different[k : k + 1024])
                rows = good[(back >= k) & (back < k + 1024)]
                found = np.column_stack([np.quantile(p, [a, 0.5, 1 - a], axis=1).T, p.mean(1)])
                got[rows] = found[back[(back >= k) & (back < k + 1024)] - k]
            out = pdf[list(keep)].copy()
            for c, column in zip(("lower", "median", "upper", "mean"), got.T, strict=True):
                out[c] = pd.Series(column, index=out.index).astype(object).where(~np.isnan(column), None)
            yield out

    rows = df.select(*keep, *(F.col(f).cast("double").alias(f"__f{i}") for i, f in enumerate(names)))
    return rows.mapInPandas(run, f"{kinds}, lower double, median double, upper double, mean double")
