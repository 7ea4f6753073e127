"""Joins that a statistics library needs: nearest neighbours and shortest paths."""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def nearest(queries: DataFrame, base: DataFrame, key: str, vector: str, k: int, most_queries: int = 50_000) -> DataFrame:
    """q, n, distance, rank of the k nearest base rows of each query by Euclidean distance, itself left out; ties go to the smaller key.

    Queries in blocks of about ``most_queries`` are sent to all base rows, where
    each batch keeps its k best, so the shuffle has k rows a query and batch.
    Any number of rows are queries; beyond one block each block's result is
    written before the next one is sent.
    """
    from ..sources.tables import materialise

    blocks = -(-queries.count() // most_queries)
    if blocks > 1:
        found = None
        for b in range(blocks):
            part = queries.where(F.pmod(F.xxhash64(key), F.lit(blocks)) == b)
            got = materialise(_nearest_block(part, base, key, vector, k))
            found = got if found is None else found.unionByName(got)
        return found
    return _nearest_block(queries, base, key, vector, k)


def _nearest_block(queries: DataFrame, base: DataFrame, key: str, vector: str, k: int) -> DataFrame:
    """The k nearest base rows of each query of one block, which the driver collects."""
    some = [(r[key], r[vector]) for r in queries.select(key, vector).collect()]
    ids = np.array([s[0] for s in some], np.int64)
    q = np.array([s[1] for s in some], np.float64).reshape(len(some), -1)
    held = queries.sparkSession.sparkContext.broadcast((ids, q))

    def run(batches):
        ids, q = held.value
        for batch in batches:
            if not batch.num_rows or not len(ids):
                continue
            b = batch.column(1)
            x = b.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(b), -1)
            n = batch.column(0).to_numpy()
            size = (x**2).sum(1)
            step = max(1, 4_000_000 // len(x))  # a matrix product of bounded size picks candidates
            some = min(len(x), 2 * k + 16)
            for s in range(0, len(ids), step):
                block, own = q[s : s + step], ids[s : s + step]
                d = size - 2 * block @ x.T
                d[n[None, :] == own[:, None]] = np.inf
                near = np.argpartition(d, some - 1, axis=1)[:, :some]
                # their distances are computed anew, by differences, so that a pair has one distance in every batch
                exact = np.empty((len(block), some))
                for i in range(0, len(block), 256):
                    part = slice(i, i + 256)
                    exact[part] = np.sqrt(((block[part, None, :] - x[near[part]]) ** 2).sum(2))
                exact[n[near] == own[:, None]] = np.inf
                order = np.lexsort((n[near], exact), axis=1)[:, :k]
                limit = np.take_along_axis(d, near, 1).max(1)
                kth = np.partition(d, min(k, len(x)) - 1, axis=1)[:, min(k, len(x)) - 1]
                for i in np.flatnonzero((limit <= kth + 1e-9 * (1 + np.abs(kth))) & (some < len(x))):  # more rows are as near as the last one
                    tied = np.flatnonzero(d[i] <= kth[i] + 1e-9 * (1 + abs(kth[i])))
                    far = np.where(n[tied] == own[i], np.inf, np.sqrt(((block[i] - x[tied]) ** 2).sum(1)))
                    best = np.lexsort((n[tied], far))[:some]
                    near[i, : len(best)], exact[i, : len(best)] = tied[best], far[best]
                    order[i] = np.arange(order.shape[1])
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(own, order.shape[1])), pa.array(np.take_along_axis(n[near], order, 1).ravel()), pa.array(np.take_along_axis(exact, order, 1).ravel())], names=["q", "n", "distance"])

    found = base.select(F.col(key).cast("long"), vector).mapInArrow(run, "q long, n long, distance double").where("distance < double('infinity')")
    w = Window.partitionBy("q").orderBy("distance", "n")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def shortest_paths(edges: DataFrame, target: int, rounds: int = 1000) -> DataFrame:
    """Distance of every vertex to ``target`` over edges (src, dst, w >= 0): relaxations of the last round's changes until there are none.

    There are as many rounds as the longest of the shortest paths has edges; more than ``rounds`` is an error.
    """
    from ..sources.tables import discard, materialise

    edges = edges.select("src", "dst", F.col("w").cast("double").alias("w"))
    best = edges.sparkSession.createDataFrame([(target, 0.0)], "v int, distance double")
    changed, old = best, None
    for _ in range(rounds):
        step = edges.join(changed, edges.dst == changed.v).groupBy(edges.src.alias("v")).agg(F.min(F.col("w") + F.col("distance")).alias("d"))
        both = materialise(best.join(step, "v", "full").select("v", F.least("distance", "d").alias("distance"), F.coalesce((F.col("d") < F.col("distance")) | F.col("distance").isNull(), F.lit(False)).alias("new")))
        discard(old)
        old, best, changed = both, both.select("v", "distance"), both.where("new").select("v", "distance")
        if changed.isEmpty():
            return best
    raise ValueError(f"distances have not settled in {rounds} rounds")


def next_vertices(edges: DataFrame, distances: DataFrame, target: int) -> DataFrame:
    """v, next: the neighbour on a shortest path to the target; of several the smallest. The target's is itself."""
    ahead = distances.select(F.col("v").alias("dst"), F.col("distance").alias("rest"))
    own = distances.select(F.col("v").alias("src"), F.col("distance").alias("whole"))
    good = edges.select("src", "dst", F.col("w").cast("double").alias("w")).join(ahead, "dst").join(own, "src").where((F.abs(F.col("w") + F.col("rest") - F.col("whole")) <= 1e-12 * (1 + F.abs("whole"))) & (F.col("src") != target))
    steps = good.groupBy(F.col("src").alias("v")).agg(F.min("dst").alias("next"))
    return steps.unionByName(distances.where(F.col("v") == target).select("v", F.col("v").alias("next")))


def extract_paths(steps: DataFrame, target: int) -> DataFrame:
    """v, path ("v>...>target") of all vertices, by doubling: each round joins a path to that of its end."""
    from ..sources.tables import discard, materialise

    paths = steps.select("v", F.col("next").alias("end"), F.when(F.col("v") == target, F.array("v")).otherwise(F.array("v", "next")).alias("p"))
    old = None
    while not paths.where(F.col("end") != target).isEmpty():
        ahead = paths.select(F.col("v").alias("e"), F.col("end").alias("end2"), F.col("p").alias("p2"))
        longer = F.when(F.col("end") == target, F.col("p")).otherwise(F.concat("p", F.expr("slice(p2, 2, size(p2))")))
        paths = materialise(paths.join(ahead, F.col("end") == F.col("e")).select("v", F.col("end2").alias("end"), longer.alias("p")))
        discard(old)
        old = paths
    return paths.select("v", F.array_join(F.transform("p", lambda x: x.cast("string")), ">").alias("path"))


def without_edges(edges: DataFrame, gone: DataFrame) -> DataFrame:
    """The network without some edges (src, dst)."""
    return edges.join(gone.select("src", "dst").distinct(), ["src", "dst"], "left_anti")


def dijkstra(edges: list[tuple[int, int, float]], target: int) -> dict[int, tuple[float, int]]:
    """Distance to the target and next vertex, for a graph that fits the driver."""
    into: dict[int, list[tuple[int, float]]] = {}
    for a, b, w in edges:
        into.setdefault(b, []).append((a, w))
    best, heap = {target: (0.0, target)}, [(0.0, target)]
    while heap:
        d, v = heapq.heappop(heap)
        if d > best[v][0]:
            continue
        for a, w in into.get(v, []):
            if a not in best or d + w < best[a][0]:
                best[a] = (d + w, v)
                heapq.heappush(heap, (d + w, a))
    return best
