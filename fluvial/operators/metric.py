"""A metric index for exact nearest neighbours, and prediction by them.

Rows are assigned to the nearest of some pivots; the index keeps each row's
distance to its pivot, sorted by cell, and the driver the radius and size of
each cell. A query is compared with the rows of its nearest cell first; its
k-th distance then bounds the search: a cell whose pivot is farther than that
and the cell's radius together cannot hold a nearer row and is not visited, and
of a visited cell only rows whose pivot distance differs from the query's by no
more are compared. Queries are sent to cells, and rows stay where they are.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import materialise

#: Most rows of a slice of a cell, queries that one task holds, and distances that are held at once.
SLICE, QUERIES, HELD = 1 << 18, 2048, 1 << 20
#: Distances from matrix products are trusted to this share of the largest norm.
SLACK = 1e-6


def _matrix(col: pa.Array) -> np.ndarray:
    return col.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(col), -1)


def _distances(x: np.ndarray, p: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((x**2).sum(1)[:, None] - 2 * (x @ p.T) + (p**2).sum(1), 0))


class _Best:
    """The k nearest rows of some queries, from batches of rows."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, far: np.ndarray, limit: np.ndarray, k: int):
        self.ids, self.x, self.far, self.limit, self.k = ids, x, far, limit.copy(), k
        self.q, self.d, self.n = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)
        self.pairs = 0

    def add(self, ids: np.ndarray, x: np.ndarray, far: np.ndarray) -> None:
        step = max(64, HELD // max(1, len(self.ids)))
        for a in range(0, len(ids), step):
            n, y, f = ids[a : a + step], x[a : a + step], far[a : a + step]
            slack = SLACK * (1 + float(np.sqrt(max((y**2).sum(1).max(initial=0), (self.x**2).sum(1).max(initial=0)))))
            fit = (np.abs(self.far[:, None] - f) <= self.limit[:, None] + slack) & (self.ids[:, None] != n)
            self.pairs += int(fit.sum())
            some = np.flatnonzero(fit.any(0))
            if not len(some):
                continue
            fit, y, n = fit[:, some], y[some], n[some]
            d = np.where(fit, _distances(self.x, y), np.inf)
            bound = self.limit
            if d.shape[1] > self.k:
                bound = np.minimum(bound, np.partition(d, self.k - 1, axis=1)[:, self.k - 1])
            i, j = np.nonzero(fit & (d <= bound[:, None] + slack))
            for s in range(0, len(i), 65_536):  # a pair's distance is taken by differences, so it is one wherever the pair meets
                part = slice(s, s + 65_536)
                self.q, self.n = np.append(self.q, i[part]), np.append(self.n, n[j[part]])
                self.d = np.append(self.d, np.sqrt(((self.x[i[part]] - y[j[part]]) ** 2).sum(1)))
            self.keep()

    def keep(self) -> None:
        order = np.lexsort((self.n, self.d, self.q))
        q = self.q[order]
        start = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]])) if len(q) else np.empty(0, np.int64)
        rank = np.arange(len(q)) - np.repeat(start, np.diff(np.append(start, len(q))))
        kept = order[rank < self.k]
        last = order[rank == self.k - 1]
        self.limit[self.q[last]] = np.minimum(self.limit[self.q[last]], self.d[last])
        self.q, self.d, self.n = self.q[kept], self.d[kept], self.n[kept]

    def batch(self) -> pa.RecordBatch:
        q = [*self.ids[self.q].tolist(), None]
        return pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array([*self.n.tolist(), 0], pa.int64()), pa.array([*self.d.tolist(), 0.0]), pa.array([*[0] * len(self.q), self.pairs], pa.int64())], names=["q", "n", "distance", "pairs"])


@dataclass
class MetricIndex:
    """Rows by cell, the pivots, and of each cell its largest pivot distance and number of rows."""

    rows: DataFrame
    pivots: np.ndarray
    radius: np.ndarray
    count: np.ndarray

    @classmethod
    def build(cls, base: DataFrame, key: str, vector: str, pivots: int | None = None) -> MetricIndex:
        """An index of all rows with a key and a vector (vectors of one length, without nulls)."""
        good = base.where(F.col(key).isNotNull() & F.col(vector).isNotNull()).select(F.col(key).cast("long").alias("n"), F.col(vector).cast("array<double>").alias("v"))
        wanted = pivots or max(4, min(1024, math.isqrt(good.count())))
        chosen = good.orderBy(F.xxhash64("n"), "n").limit(wanted).collect()  # at most 1,024 rows
        p = np.array([r["v"] for r in chosen], np.float64)
        if not len(p):
            return cls(good.withColumns({"cell": F.lit(0).cast("long"), "far": F.lit(0.0)}), np.zeros((0, 0)), np.zeros(0), np.zeros(0, np.int64))

        def place(batches):
            for batch in batches:
                d = _distances(_matrix(batch.column("v")), p)
                cell = d.argmin(1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(d[np.arange(len(d)), cell])], names=["n", "v", "cell", "far"])

        rows = materialise(good.mapInArrow(place, "n long, v array<double>, cell long, far double"))
        found = rows.groupBy("cell").agg(F.max("far").alias("far"), F.count("*").alias("count")).collect()  # a row for each pivot
        radius, count = np.full(len(p), -np.inf), np.zeros(len(p), np.int64)
        for r in found:
            radius[r["cell"]], count[r["cell"]] = r["far"], r["count"]
        return cls(rows, p, radius, count)

    def _visits(self, queries: DataFrame, first: bool) -> DataFrame:
        """Each query once for each cell that it visits: its nearest one, or all others that may hold nearer rows than ``limit``."""
        p, radius = self.pivots, self.radius

        def run(batches):
            for batch in batches:
                x = _matrix(batch.column("v"))
                d = _distances(x, p)
                own = np.where(radius >= 0, d, np.inf).argmin(1)
                limit = batch.column("limit").to_numpy()
                slack = SLACK * (1 + float(np.sqrt(max((x**2).sum(1).max(initial=0), (p**2).sum(1).max(initial=0)))))
                visit = np.arange(len(p)) == own[:, None]
                if not first:
                    visit = ~visit & (radius >= 0) & (d - radius <= limit[:, None] + slack)
                for a in range(0, len(x), 256):
                    i, c = np.nonzero(visit[a : a + 256])
                    i += a
                    yield pa.RecordBatch.from_arrays([*batch.select(["q", "v", "limit"]).take(pa.array(i)).columns, pa.array(c), pa.array(d[i, c])], names=["q", "v", "limit", "cell", "far"])

        return queries.mapInArrow(run, "q long, v array<double>, limit double, cell long, far double")

    def _compared(self, visits: DataFrame, k: int) -> DataFrame:
        """The k nearest rows of each visit (q, n, distance), and rows without q that count the pairs compared."""
        spark = visits.sparkSession
        slices = {c: int(-(-n // SLICE)) for c, n in enumerate(self.count.tolist()) if n}
        sizes = spark.createDataFrame([(c, s) for c, s in slices.items()], "cell long, slices int")
        groups = visits.groupBy("cell").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("groups"))  # a row for each pivot
        both = F.broadcast(sizes.join(groups, "cell"))
        every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        left = visits.join(both, "cell").withColumn("group", F.pmod(F.xxhash64("q"), F.col("groups")).cast("int")).withColumn("slice", every("slices"))
        left = left.select("cell", "group", "slice", F.lit(0).alias("side"), F.col("q").alias("id"), "v", "limit", "far")
        right = self.rows.join(both, "cell").withColumn("slice", F.pmod(F.xxhash64("n"), F.col("slices")).cast("int")).withColumn("group", every("groups"))
        right = right.select("cell", "group", "slice", F.lit(1).alias("side"), F.col("n").alias("id"), "v", F.lit(0.0).alias("limit"), "far")
        place = ["cell", "group", "slice"]
        n = int(spark.conf.get("spark.sql.shuffle.partitions"))
        rows = left.unionByName(right).repartition(n, *place).sortWithinPartitions(*place, "side")

        def run(batches):
            at, waiting, best = None, [], None
            for batch in batches:
                where = np.stack([batch.column(c).to_numpy() for c in (*place, "side")])
                cut = (np.flatnonzero((where[:, 1:] != where[:, :-1]).any(0)) + 1).tolist()
                for a, b in zip([0, *cut], [*cut, batch.num_rows], strict=True):
                    if a == b:
                        continue
                    part = batch.slice(a, b - a)
                    if tuple(where[:3, a]) != at:
                        if best is not None:
                            yield best.batch()
                        at, waiting, best = tuple(where[:3, a]), [], None
                    if where[3, a] == 0:
                        waiting.append(part)
                        continue
                    if best is None and waiting:
                        t = pa.Table.from_batches(waiting).combine_chunks()
                        best = _Best(t.column("id").to_numpy(), _matrix(t.column("v").chunk(0)), t.column("far").to_numpy(), t.column("limit").to_numpy(), k)
                    if best is not None:
                        best.add(part.column("id").to_numpy(), _matrix(part.column("v")), part.column("far").to_numpy())
            if best is not None:
                yield best.batch()

        return rows.mapInArrow(run, "q long, n long, distance double, pairs long")

    def search(self, queries: DataFrame, key: str, vector: str, k: int) -> tuple[DataFrame, DataFrame]:
        """q, n, distance and rank of the k nearest rows of each query, a row of the query's own key left out (ties: smaller key); and a table of the pairs compared."""
        q = queries.where(F.col(key).isNotNull() & F.col(vector).isNotNull()).select(F.col(key).cast("long").alias("q"), F.col(vector).cast("array<double>").alias("v"), F.lit(math.inf).alias("limit"))
        if not len(self.pivots):
            return q.select("q", F.col("q").alias("n"), F.lit(0.0).alias("distance"), F.lit(1).alias("rank")).limit(0), q.agg(F.sum(F.lit(0)).alias("pairs"))
        q = materialise(q.dropDuplicates(["q"]))
        first = materialise(self._compared(self._visits(q, True), k))
        reached = first.where("q is not null").groupBy("q").agg(F.count("*").alias("c"), F.max("distance").alias("d")).where(F.col("c") >= k).select("q", "d")
        bounded = q.join(reached, "q", "left").select("q", "v", F.coalesce("d", "limit").alias("limit"))
        second = materialise(self._compared(self._visits(bounded, False), k))
        found = first.unionByName(second)
        rank = F.row_number().over(Window.partitionBy("q").orderBy("distance", "n"))
        best = found.where("q is not null").select("q", "n", "distance", rank.alias("rank")).where(F.col("rank") <= k)
        return best, found.where("q is null").agg(F.sum("pairs").alias("pairs"))


def predicted(neighbours: DataFrame, base: DataFrame, key: str, target: str, classify: bool = False) -> DataFrame:
    """q and predicted: the target's mean weighted by 1 / distance^2 (weight 1 at distance 0), or its most frequent class (ties: the smallest)."""
    y = base.select(F.col(key).cast("long").alias("n"), F.col(target).alias("__y")).where("__y is not null")
    rows = neighbours.join(y, "n")
    if classify:
        votes = rows.groupBy("q", "__y").agg(F.count("*").alias("__c"))
        return votes.groupBy("q").agg(F.min_by("__y", F.struct(-F.col("__c"), F.col("__y"))).alias("predicted"))
    w = F.when(F.col("distance") == 0, 1.0).otherwise(1 / (F.col("distance") * F.col("distance")))
    return rows.groupBy("q").agg((F.sum(w * F.col("__y")) / F.sum(w)).alias("predicted"))
