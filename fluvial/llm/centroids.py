"""Clustering of vectors around centroids, exact in whole numbers.

Each component x becomes floor(scale * x). Distances come from the expansion
|x|^2 - 2 x.c + |c|^2 by float64 BLAS in blocks, for rows whose magnitudes keep
every partial sum below 2^53, and by integers beyond (``vectors.nearest``). A
pass over the table makes one partial sum a batch (counts, componentwise sums
and distances by cluster), which ``treeAggregate`` combines in a tree, so the
driver holds k centroids and nothing that grows with the rows. Passes read the
table anew; no row is shuffled.

Edge cases: vectors that are null, of another length, or with a component that
is null, infinite or no number take no part and have no row. With fewer than k
vectors there are as many centroids as vectors; an empty table gives no rows.
Repeated rows count as often as they are there; of two rows with one id the
smaller vector is chosen first as a centroid. Rows with a null id are
clustered, and come last when centroids are chosen. Ties go to the smaller
centroid. Distances and sums of them beyond 64 bits are reported as 2^63 - 1.
Other columns are not read.
"""

from __future__ import annotations

import hashlib
import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .vectors import LONGEST, bounded, integers, matrix, nearest, sums, usable


def first_centroids(rows: DataFrame, k: int, scale: int, seed: int) -> np.ndarray:
    """The vectors of the k smallest hashes of ``seed:id``, as integers."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("key").cast("string")), 256)
    found = rows.select(key.alias("h"), "v").orderBy(F.asc_nulls_last("h"), "v").limit(k).collect()  # k rows
    return integers(np.array([r["v"] for r in found], np.float64), scale) if found else np.zeros((0, 0), object)


def partial_sums(rows: DataFrame, centres: np.ndarray, scale: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, componentwise sums and summed distances of each cluster, as Python integers."""
    n, width = centres.shape

    def run(batches):
        for batch in batches:
            x = matrix(batch.column("v"), width)
            label, dist = nearest(x, scale, centres)
            far = np.zeros(n, object)
            np.add.at(far, label, dist)
            part = np.bincount(label, minlength=n).astype(object), sums(x, scale, label, n), far
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(part)], pa.binary())], names=["part"])

    zero = np.zeros(n, object), np.zeros((n, width), object), np.zeros(n, object)
    add = lambda a, b: tuple(x + y for x, y in zip(a, b, strict=True))
    parts = rows.select("v").mapInArrow(run, "part binary").rdd.map(lambda r: pickle.loads(r["part"]))
    return parts.treeAggregate(zero, add, add)


def cluster(rows: DataFrame, vector: str = "embedding", key: str = "vec_id", components: int = 64, k: int = 16, scale: int = 64, rounds: int = 3, seed: int = 1) -> DataFrame:
    """One row a vector: ``key``, ``cluster``, ``distance`` (squared), ``cluster_inertia``, ``inertia`` and ``centroid_sha256``."""
    kind = rows.schema[key].dataType.simpleString()
    good = rows.where((F.size(vector) == components) & usable(vector)).select(F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("v"))
    centres = first_centroids(good, k, scale, seed)
    if not len(centres):
        return good.select(F.col("key").alias(key), *(F.lit(None).cast(t).alias(c) for c, t in (("cluster", "int"), ("distance", "long"), ("cluster_inertia", "long"), ("inertia", "long"), ("centroid_sha256", "string"))))
    for _ in range(rounds):
        counts, total, _ = partial_sums(good, centres, scale)
        for j in np.flatnonzero(counts).tolist():
            centres[j] = [s // counts[j] for s in total[j].tolist()]
    far = partial_sums(good, centres, scale)[2].tolist()
    own, all_of_them = bounded(far), min(LONGEST, sum(far))
    names = np.array([hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres.tolist()])

    def run(batches):
        for batch in batches:
            label, dist = nearest(matrix(batch.column("v"), components), scale, centres)
            columns = [batch.column("key"), pa.array(label), pa.array(bounded(dist)), pa.array(own[label]), pa.array(np.full(len(label), all_of_them, np.int64)), pa.array(names[label])]
            yield pa.RecordBatch.from_arrays(columns, names=[key, "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"])

    return good.mapInArrow(run, f"`{key}` {kind}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")


def _sql(rounds: int = 3) -> str:
    """The contract's figures over ``embeddings`` as SQL, a round after the other."""
    steps = [
        "v as materialized (select vec_id, list_transform(embedding, lambda x: cast(floor(64 * cast(x as double)) as bigint)) x from embeddings where len(embedding) = 64 and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = 64)",
        "c0 as materialized (select row_number() over (order by h, x) - 1 c, x from (select sha256('1:' || vec_id) h, x from v order by h, x limit 16))",
    ]
    for r in range(rounds + 1):
        steps.append(f"d{r} as materialized (select vec_id, any_value(v.x) x, arg_min(c, (d, c)) c, min(d) d from (select vec_id, v.x, c, list_sum(list_transform(list_zip(v.x, k.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) d from v, c{r} k) v group by vec_id)")
        if r < rounds:
            steps.append(f"m{r} as (select c, list(cast((s - ((s % n) + n) % n) // n as bigint) order by i) x from (select c, i, cast(sum(x[i]) as bigint) s, count(*) n from d{r}, range(1, 65) t(i) group by c, i) group by c)")
            steps.append(f"c{r + 1} as materialized (select a.c, coalesce(b.x, a.x) x from c{r} a left join m{r} b using (c))")
    last = f"select vec_id, cast(c as int) \"cluster\", cast(d as bigint) distance, cast(sum(d) over (partition by c) as bigint) cluster_inertia, cast(sum(d) over () as bigint) inertia, sha256(array_to_string(c{rounds}.x, ',')) centroid_sha256 from d{rounds} join c{rounds} using (c)"
    return "with " + ",\n".join(steps) + "\n" + last


ORACLE_SQL = _sql()
