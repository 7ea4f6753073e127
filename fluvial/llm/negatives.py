"""Hard negatives for contrastive training, by a Voronoi-partitioned k-nearest join that is exact.

Each component x becomes floor(scale * x); a row's score is its inner product
with an anchor. An anchor's positives are its best ``positives`` other rows of
the same label; for each of them the best ``negatives`` rows of other labels
whose score lies between ``low`` and ``high`` percent of the positive's are
returned.

Both searches are one join (``best_in_bands``): of each anchor's bands of
scores the k best rows. Rows get one more component, sqrt(M^2 - |x|^2) with M the
largest norm, and anchors and pivots zero there, so that a larger score is a
smaller distance. Anchors and rows are assigned to the nearest of some pivots
(vectors of the table); the anchors of a cell make groups of about ``GROUP``.
A group knows from the bands and pivot distances of its anchors how near and
how far from its pivot a useful row can lie, and what score it can have there. Rows meet the groups of their own cell first; what is found there
narrows the bounds, and then rows are sent to the groups of other cells that
they might serve. A group meets its rows in slices by hash, as many as the
table needs, so neither a dense cell nor a group that all rows might serve is
one task; the local join reads a slice in batches and holds its anchors and
their k best. Where the bounds cut nothing (vectors without any clusters) this
is a join of the anchors with all rows in blocks.

Edge cases: rows with a null id, a null label, a null vector or a component
that is null, infinite or no number take no part. Rows of different length
never meet. An anchor's other rows are those of another id; of rows that repeat
an id each list has the best one once, and the anchor itself is the one of the
smallest label and vector. Ties go to the smaller id. Components and scores
beyond 64 bits count as the last number that fits. Anchors with no positive, or
none whose band has a row, have no row; an empty table gives none. Other
columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, partitions
from .vectors import LONGEST, floors, matrix, products, usable

#: Most anchors of a group, most rows of a slice, scores of a group that are held at once.
GROUP, SLICE, HELD = 4096, 1 << 20, 1 << 20
#: Distances are trusted to this share of the largest norm.
SLACK = 1e-6


def packed(y: np.ndarray) -> list[bytes]:
    """Rows of integers as bytes of the narrowest type that holds them all."""
    top = int(np.abs(y).max(initial=0))
    kind = next(t for t in ("<i2", "<i4", "<i8") if top <= np.iinfo(t).max)
    return [row.tobytes() for row in y.astype(kind)]


def unpacked(col: pa.Array, width: int) -> np.ndarray:
    cells = [v.as_buffer() for v in col]
    out, size = np.zeros((len(cells), width), np.int64), np.array([v.size for v in cells])
    for one in np.unique(size[size > 0]).tolist() if width else []:
        at = np.flatnonzero(size == one)
        out[at] = np.frombuffer(b"".join(cells[i] for i in at.tolist()), f"<i{one // width}").reshape(-1, width)
    return out


def prepared(rows: DataFrame, vector: str, key: str, label: str, scale: int) -> DataFrame:
    """key, label, width, vec (integers, packed) and squared norm of the rows that take part."""
    kind = rows.schema[label].dataType.simpleString()
    good = rows.where(F.col(key).isNotNull() & F.col(label).isNotNull() & usable(vector))
    good = good.select(F.col(key).cast("long").alias("key"), F.col(label).alias("label"), F.col(vector).cast("array<double>").alias("v"), F.size(vector).alias("width"))

    def run(batches):
        for batch in batches:
            width = batch.column("width").to_numpy()
            for w in np.unique(width).tolist():
                part = batch.filter(pa.array(width == w))
                y = np.clip(floors(matrix(part.column("v"), w), scale), -float(1 << 62), float(1 << 62)).astype(np.int64)
                norm = (y.astype(np.float64) ** 2).sum(1)
                yield pa.RecordBatch.from_arrays([part.column("key"), part.column("label"), part.column("width"), pa.array(packed(y), pa.binary()), pa.array(norm)], names=["key", "label", "width", "vec", "norm"])

    return good.mapInArrow(run, f"key long, label {kind}, width int, vec binary, norm double")


class Cells:
    """Pivots, which like anchors have zero as their additional component, and distances to them."""

    def __init__(self, pivots: np.ndarray, top: float):
        self.p, self.top = pivots.astype(np.float64), top
        self.norm = (self.p**2).sum(1)

    def of_anchors(self, y: np.ndarray) -> np.ndarray:
        """The distance of each anchor to each pivot."""
        x = y.astype(np.float64)
        return np.sqrt(np.maximum((x**2).sum(1)[:, None] - 2 * (x @ self.p.T) + self.norm, 0))

    def of_rows(self, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of rows with sqrt(M^2 - |x|^2) added: distances and inner products with each pivot, and the norms of the rows."""
        x = y.astype(np.float64)
        dot = x @ self.p.T
        return np.sqrt(np.maximum(self.top + self.norm - 2 * dot, 0)), dot, np.sqrt((x**2).sum(1))


def grouped(anchors: DataFrame, cells: Cells, width: int) -> DataFrame:
    """The anchors with cell, u (distance to its pivot) and group."""

    def run(batches):
        for batch in batches:
            d = cells.of_anchors(unpacked(batch.column("vec"), width))
            cell = d.argmin(1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(d[np.arange(len(d)), cell])], names=[*batch.schema.names, "cell", "u"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in anchors.schema.fields)
    placed = materialise(anchors.mapInArrow(run, f"{kinds}, cell long, u double"), "anchors")
    counts = placed.groupBy("cell").agg(F.ceil(F.count("*") / GROUP).alias("blocks"))  # a row for each pivot
    return placed.join(F.broadcast(counts), "cell").withColumn("group", F.col("cell") * (1 << 32) + F.pmod(F.xxhash64("key"), F.col("blocks"))).drop("blocks")


def bounds(anchors: DataFrame, top: float) -> dict[str, np.ndarray]:
    """Of each group its cell, how near to and far from the pivot rows can lie that any of its bands has room for, the least and most score, and the largest distance of an anchor."""
    valid = "filter(arrays_zip(lo, hi), b -> b.lo <= b.hi)"
    rows = anchors.where(F.expr(f"size({valid}) > 0"))
    rows = rows.withColumns({"least": F.expr(f"cast(array_min({valid}.lo) as double)"), "most": F.expr(f"cast(array_max({valid}.hi) as double)")})
    reach = lambda score: F.sqrt(F.greatest(F.lit(0.0), F.lit(top) + F.col("norm") - 2 * F.col(score)))
    found = rows.groupBy("group").agg(F.first("cell").alias("cell"), F.min(reach("most") - F.col("u")).alias("near"), F.max(reach("least") + F.col("u")).alias("far"), F.min("least").alias("least"), F.max("most").alias("most"), F.max("u").alias("u"))
    return {c: v.to_numpy() for c, v in found.toPandas().items()}  # a row for each group


def spread(rows: DataFrame, cells: Cells, groups: dict[str, np.ndarray], width: int, slices: int, home: bool) -> DataFrame:
    """Each row once for each group that it might serve, of its own cell or of all others.

    Two bounds hold for a row x that serves an anchor a near pivot p: its
    distance to p is its distance to a give or take |a - p|, and x.a is x.p
    give or take |x| |a - p|.
    """
    slack, more = SLACK * math.sqrt(cells.top) + 1e-9, SLACK * cells.top + 1e-9
    kind = rows.schema["label"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            d, dot, norm = cells.of_rows(unpacked(batch.column("vec"), width))
            own = d.argmin(1)
            part = batch.select(["key", "label", "vec", "slice"])
            step = max(1, 100_000 // max(1, len(groups["group"])))
            for x in range(0, len(own), step):
                some = slice(x, x + step)
                here, there, room = d[some][:, groups["cell"]], dot[some][:, groups["cell"]], norm[some, None] * groups["u"]
                out = (here > groups["far"] + slack) | (here < groups["near"] - slack) | (there + room < groups["least"] - more) | (there - room > groups["most"] + more)
                i, g = np.nonzero(((own[some, None] == groups["cell"]) == home) & ~out)
                yield pa.RecordBatch.from_arrays([pa.array(groups["group"][g]), *part.take(pa.array(i + x)).columns], names=["group", "key", "label", "vec", "slice"])

    sliced = rows.select("key", "label", "vec", F.pmod(F.xxhash64("key", F.lit(7)), F.lit(slices)).alias("slice"))
    return sliced.mapInArrow(run, f"group long, key long, label {kind}, vec binary, slice long")


class Best:
    """The k best rows of each band of some anchors, from batches of rows."""

    def __init__(self, table: pa.Table, width: int, same: bool, k: int):
        self.key, self.label = table.column("key").to_numpy(), table.column("label").to_numpy(zero_copy_only=False)
        self.vec, self.same, self.k = unpacked(table.column("vec"), width), same, k
        lo, hi = table.column("lo").to_pylist(), table.column("hi").to_pylist()
        bands = max(map(len, lo))
        self.lo, self.hi = np.ones((len(lo), bands), np.int64), np.zeros((len(lo), bands), np.int64)  # no room
        for i, (a, b) in enumerate(zip(lo, hi, strict=True)):
            self.lo[i, : len(a)], self.hi[i, : len(b)] = a, b
        self.found = np.zeros((0, 4), np.int64)  # anchor, band, minus score, id

    def add(self, key: np.ndarray, label: np.ndarray, vec: np.ndarray) -> None:
        step = max(64, HELD // max(1, len(self.key)))
        for x in range(0, len(key), step):
            score = products(self.vec, vec[x : x + step])
            fit = ((self.label[:, None] == label[x : x + step]) == self.same) & (self.key[:, None] != key[x : x + step])
            new = [self.found]
            for b in range(self.lo.shape[1]):
                i, j = np.nonzero(fit & (score >= self.lo[:, b : b + 1]) & (score <= self.hi[:, b : b + 1]))
                new.append(np.stack([i, np.full(len(i), b), -score[i, j], key[x + j]], 1))
            if sum(map(len, new)) > len(self.found):
                self.keep(np.concatenate(new))

    def keep(self, all_: np.ndarray) -> None:
        """The best k of each band, an id once; bands that are full rise to their last score."""
        all_ = all_[np.lexsort((all_[:, 2], all_[:, 3], all_[:, 1], all_[:, 0]))]
        first = np.ones(len(all_), bool)
        first[1:] = (all_[1:, [0, 1, 3]] != all_[:-1, [0, 1, 3]]).any(1)
        all_ = all_[first]
        all_ = all_[np.lexsort((all_[:, 3], all_[:, 2], all_[:, 1], all_[:, 0]))]
        start = np.ones(len(all_), bool)
        start[1:] = (all_[1:, :2] != all_[:-1, :2]).any(1)
        at = np.flatnonzero(start)
        rank = np.arange(len(all_)) - np.repeat(at, np.diff(np.append(at, len(all_))))
        self.found = all_[rank < self.k]
        full = all_[rank == self.k - 1]
        self.lo[full[:, 0], full[:, 1]] = -full[:, 2]

    def batch(self) -> pa.RecordBatch:
        anchor, band, less, key = self.found.T
        return pa.RecordBatch.from_arrays([pa.array(self.key[anchor]), pa.array(band), pa.array(-less), pa.array(key)], names=["anchor", "band", "score", "id"])


def local_join(anchors: DataFrame, rows: DataFrame, width: int, slices: int, same: bool, k: int) -> DataFrame:
    """anchor, band, score and id of the best k rows of each slice."""
    spark = rows.sparkSession
    left = anchors.select("group", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(slices - 1).cast("long"))).alias("slice"), F.lit(0).alias("side"), "key", "label", "vec", "lo", "hi")
    right = rows.select("group", "slice", F.lit(1).alias("side"), "key", "label", "vec", F.lit(None).cast("array<long>").alias("lo"), F.lit(None).cast("array<long>").alias("hi"))
    both = left.unionByName(right).repartition(partitions(spark), "group", "slice").sortWithinPartitions("group", "slice", "side")

    def run(batches):
        place, waiting, best = None, [], None

        for batch in batches:
            group, slice_, side = (batch.column(c).to_numpy() for c in ("group", "slice", "side"))
            cut = np.flatnonzero((group[1:] != group[:-1]) | (slice_[1:] != slice_[:-1]) | (side[1:] != side[:-1])) + 1
            for a, b in zip([0, *cut.tolist()], [*cut.tolist(), len(group)], strict=True):
                if a == b:
                    continue
                part = batch.slice(a, b - a)
                if (group[a], slice_[a]) != place:
                    if best is not None:
                        yield best.batch()
                    place, waiting, best = (group[a], slice_[a]), [], None
                if side[a] == 0:
                    waiting.append(part)
                    continue
                if best is None and waiting:
                    best = Best(pa.Table.from_batches(waiting).combine_chunks(), width, same, k)
                if best is not None:
                    best.add(part.column("key").to_numpy(), part.column("label").to_numpy(zero_copy_only=False), unpacked(part.column("vec"), width))
        if best is not None:
            yield best.batch()

    return both.mapInArrow(run, "anchor long, band long, score long, id long")


def top(found: DataFrame, k: int) -> DataFrame:
    """anchor, band and ``best``: the k best (less: minus the score, id), an id once, in order."""
    once = found.groupBy("anchor", "band", "id").agg(F.min(-F.col("score")).alias("less"))
    place = F.row_number().over(Window.partitionBy("anchor", "band").orderBy("less", "id"))
    few = once.withColumn("place", place).where(F.col("place") <= k)
    return few.groupBy("anchor", "band").agg(F.sort_array(F.collect_list(F.struct("less", "id"))).alias("best"))


def best_in_bands(anchors: DataFrame, rows: DataFrame, cells: Cells, width: int, slices: int, same: bool, k: int) -> DataFrame:
    """Of each band (lo, hi) of each anchor the k best rows of the same label, or of others: anchor, band, best."""
    near = spread(rows, cells, bounds(anchors, cells.top), width, slices, home=True)
    first = materialise(local_join(anchors, near, width, slices, same, k), "first")
    reached = top(first, k).where(F.size("best") == k).select("anchor", F.struct("band", (-F.element_at("best", -1)["less"]).alias("score")).alias("b"))
    reached = reached.groupBy("anchor").agg(F.collect_list("b").alias("reached"))
    raised = anchors.join(reached, anchors.key == reached.anchor, "left").drop("anchor")
    raised = raised.withColumn("lo", F.expr("transform(lo, (x, i) -> greatest(x, aggregate(coalesce(reached, array()), x, (a, r) -> if(r.band = i, r.score, a))))")).drop("reached")
    raised = materialise(raised, "raised")
    away = spread(rows, cells, bounds(raised, cells.top), width, slices, home=False)
    return top(first.unionByName(local_join(raised, away, width, slices, same, k)), k)


def mine(rows: DataFrame, anchors: Column, vector: str = "embedding", key: str = "vec_id", label: str = "label", positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, scale: int = 256) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score; ``anchors`` says which rows are anchors."""
    spark = rows.sparkSession
    kept = materialise(prepared(rows, vector, key, label, scale), "vectors")
    sizes = kept.groupBy("width").agg(F.count("*").alias("n"), F.max("norm").alias("top")).collect()  # a row for each length
    wanted = materialise(rows.where(anchors).select(F.col(key).cast("long").alias("key")).distinct(), "wanted")
    out = None
    for width, n, largest in ((r["width"], r["n"], r["top"]) for r in sizes):
        here = kept.where(F.col("width") == width)
        some = here.join(wanted, "key", "left_semi")
        some = some.groupBy("key").agg(F.min(F.struct("label", "vec", "norm")).alias("s")).select("key", "s.*")
        part = _mined(here, some, width, n, largest, positives, negatives, low, high)
        out = part if out is None else out.unionByName(part)
    if out is None:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    return out


def _mined(rows: DataFrame, anchors: DataFrame, width: int, n: int, largest: float, positives: int, negatives: int, low: int, high: int) -> DataFrame:
    pivots = max(16, min(1024, math.isqrt(n) // 8))
    chosen = rows.select("key", "vec").orderBy(F.xxhash64("key"), "key", "vec").limit(pivots).collect()
    cells = Cells(unpacked(pa.array([bytes(r["vec"]) for r in chosen], pa.binary()), width), largest)
    slices = max(-(-n // SLICE), min(16, -(-n // 1024)))
    placed = materialise(grouped(anchors, cells, width).withColumns({"lo": F.array(F.lit(-LONGEST)), "hi": F.array(F.lit(LONGEST))}), "grouped")
    alike = best_in_bands(placed, rows, cells, width, slices, True, positives)
    alike = materialise(alike.select(F.col("anchor").alias("a"), F.transform("best", lambda b: F.struct(b["id"].alias("id"), (-b["less"]).alias("score"))).alias("positives")), "positives")
    edge = lambda sign, percent: f"transform(positives, p -> {sign}(({sign}(cast(p.score as decimal(20, 0)) * {percent}) - pmod({sign}(cast(p.score as decimal(20, 0)) * {percent}), 100)) div 100))"
    banded = placed.drop("lo", "hi").join(alike, placed.key == alike.a).drop("a")
    banded = banded.withColumns({"lo": F.expr(edge("-", low)), "hi": F.expr(edge("", high))})
    banded = materialise(banded.where(F.expr("exists(arrays_zip(lo, hi), b -> b.lo <= b.hi)")), "banded")
    others = best_in_bands(banded.drop("positives"), rows, cells, width, slices, False, negatives)
    listed = others.join(banded.select(F.col("key").alias("k"), "positives"), F.col("anchor") == F.col("k"))
    listed = listed.select("anchor", F.element_at("positives", (F.col("band") + 1).cast("int")).alias("p"), F.posexplode("best").alias("at", "b"))
    return listed.select(F.col("anchor").alias("anchor_id"), F.col("p.id").alias("positive_id"), (F.col("at") + 1).cast("int").alias("rank"), F.col("b.id").alias("negative_id"), F.col("p.score").alias("positive_score"), (-F.col("b.less")).alias("negative_score"))


ORACLE_SQL = """
with v as materialized (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end l, list_transform(embedding, lambda x: floor(256 * cast(x as double))) x from embeddings
 where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = len(embedding)),
s as materialized (select a.vec_id a, v.vec_id i, a.l = v.l same, cast(list_inner_product(a.x, v.x) as bigint) s from v a join v on a.vec_id <> v.vec_id where a.vec_id % 100 = 0),
p as (select a, i, s from s where same qualify row_number() over (partition by a order by s desc, i) <= 5),
n as (select p.a, p.i p, s.i, p.s ps, s.s, row_number() over (partition by p.a, p.i order by s.s desc, s.i) r from p join s on p.a = s.a where not same and 30 * p.s <= 100 * s.s and 100 * s.s <= 90 * p.s)
select a anchor_id, p positive_id, cast(r as int) "rank", i negative_id, ps positive_score, s negative_score from n where r <= 10
"""
