"""Near-duplicate documents by a chosen-path set similarity join.

A document is the set of its distinct word shingles; documents whose sets have
a Jaccard similarity of at least ``percent`` / 100 are linked, and groups are
the connected components of links.

Documents with equal sets form one class, and one of each class goes on. In
each of ``TREES`` independent trees a class goes down from the root: at each
level it chooses ``CHOSEN`` minwise tokens of its set and enters the child of
each, so a pair of similarity s stays together with a chance of 1 - (1 - s)^2
a level. A node is branched on while it has more than ``SMALL`` classes and
keeps shrinking; boilerplate that many documents share thins out this way. All
classes of a small node are compared by sketches. A node that no longer shrinks
(``STAYS``) holds near copies: it is cut into blocks of ``BLOCK`` classes, each
compared inside itself and with ``HEADS`` representatives of the node, which
joins what is alike at a cost that grows with its size and not with its
square. Pairs that may be similar enough are confirmed on full sets: first a
spanning forest of each node or block; then, with the groups found so far,
pairs that still join two groups of a node: the best of each class, and at last
all. In those rounds the classes of a node's largest group are compared with
the others only, and nodes of one group not at all. The last round compares by
the ``HELD`` least hashes of both sets, which decide for sets of up to so many
shingles and leave few pairs of larger ones to be confirmed, so that classes
that are much alike, and not enough, make no rows.

Ids are whole numbers. Edge cases: null, empty and wordless texts have an empty set and are linked
with nothing; a text of fewer words than a shingle is one shingle; rows with a
null id are linked with nothing, have no component and are kept. Repeated rows
with one id share its component; different texts under one id count as one
document with the links of its smallest set class. Ties go to the smaller id.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, flat_utf8, materialise, mixed, partitions, slices, trimmed, word_hashes

#: Trees, levels of each, and tokens that a class chooses at each level. A pair at 0.80 that goes down all levels is together at the end of one of the trees with a chance of 1 - (1 - 0.96^8)^5 = 0.998, one that stops after three with 0.99998.
TREES, LEVELS, CHOSEN = 5, 8, 2
#: Minwise values of a sketch, in order of tree, level and choice.
VALUES = TREES * LEVELS * CHOSEN
#: Classes of a node that is not branched on, the share of its parent from which on a node no longer shrinks, the classes of one block, and the representatives of a node of several.
SMALL, STAYS, BLOCK, HEADS = 64, 0.7, 1024, 64
#: Pairs of each class and node that are confirmed before all others are.
SOME = 3
#: Hashes of a set that are sent to its nodes in the last round.
HELD = 512
#: Sketches whose share of equal values is so many standard deviations under the threshold are left.
DEVIATIONS = 5

_rng = np.random.default_rng(20)
SEEDS = _rng.integers(0, 1 << 63, VALUES, dtype=np.uint64)
MULTIPLIERS = _rng.integers(0, 1 << 63, VALUES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(col: pa.Array, size: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct shingles of each text, sorted, and the offset where each row starts."""
    data, off = flat_utf8(col)
    rows = len(off) - 1
    if not len(data):
        return np.empty(0, np.uint64), np.zeros(rows + 1, np.int64)
    lower = np.arange(256, dtype=np.uint8)
    lower[65:91] += 32
    data = lower[data]
    gap = (data == 32) | ((data >= 9) & (data <= 13))
    edge = np.zeros(len(data) + 1, bool)
    edge[off] = True
    word = ~gap
    begin = np.flatnonzero(word & (edge[:-1] | np.concatenate([[True], gap[:-1]])))
    end = np.flatnonzero(word & (edge[1:] | np.concatenate([gap[1:], [True]]))) + 1
    row = np.searchsorted(off, begin, "right") - 1
    h = word_hashes(data, begin, end)
    counts = np.bincount(row, minlength=rows)
    start = np.concatenate([[0], np.cumsum(counts)])
    n = np.maximum(counts - size + 1, counts > 0)  # shingles of each row
    total = np.concatenate([[0], np.cumsum(n)])
    owner = np.repeat(np.arange(rows), n)
    first = start[owner] + np.arange(total[-1]) - total[owner]
    got = np.zeros(total[-1], np.uint64)
    for k in range(size):
        at = first + k
        inside = at < start[owner + 1]
        part = np.where(inside, h[np.minimum(at, max(len(h) - 1, 0))], np.uint64(k + 1))
        got = mixed(got * np.uint64(0x9FB21C651E98DF25) + part)
    order = np.lexsort((got, owner))
    got, owner = got[order], owner[order]
    new = np.concatenate([[True], (got[1:] != got[:-1]) | (owner[1:] != owner[:-1])]) if len(got) else np.empty(0, bool)
    got = got[new]
    return got, np.concatenate([[0], np.cumsum(np.bincount(owner[new], minlength=rows))])


def signatures(docs: DataFrame, text: str = "text", key: str = "doc_id", size: int = 3) -> DataFrame:
    """key, n_shingles, two hashes of the set, and the minwise token of each level of each tree."""

    def run(batches):
        for batch in batches:
            col = batch.column("__text")
            for x, y in slices(col):
                s, off = shingles(col.slice(x, y - x), size)
                n = np.diff(off)
                full = np.flatnonzero(n)
                at = off[:-1][full]
                sums = np.zeros((2, y - x), np.uint64)
                sig = np.zeros((y - x, VALUES), ">u4")
                if len(full):
                    sums[0, full] = np.add.reduceat(s, at)
                    sums[1, full] = np.add.reduceat(mixed(s), at)
                    for f in range(VALUES):
                        sig[full, f] = np.minimum.reduceat(((s ^ SEEDS[f]) * MULTIPLIERS[f] >> np.uint64(32)).astype(np.uint32), at)
                yield pa.RecordBatch.from_arrays([batch.column("key").slice(x, y - x), pa.array(n), pa.array(sums[0].view(np.int64)), pa.array(sums[1].view(np.int64)), pa.array([v.tobytes() for v in sig], pa.binary())], names=["key", "n", "s1", "s2", "sig"])

    return docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("__text")).mapInArrow(trimmed(run), "key long, n long, s1 long, s2 long, sig binary")


def full_sets(docs: DataFrame, wanted: DataFrame, text: str, key: str, size: int, broadcast_ids: int = 5_000_000) -> DataFrame:
    """The sorted set of each wanted id (bytes of 64-bit hashes)."""
    ids = F.broadcast(wanted) if wanted.count() <= broadcast_ids else wanted
    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("__text")).join(ids, "key", "left_semi")

    def run(batches):
        for batch in batches:
            col = batch.column("__text")
            for x, y in slices(col):
                s, off = shingles(col.slice(x, y - x), size)
                yield pa.RecordBatch.from_arrays([batch.column("key").slice(x, y - x), pa.array([s[a:b].tobytes() for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)], pa.binary())], names=["key", "items"])

    return rows.mapInArrow(trimmed(run), "key long, items binary")


def least_share(percent: int, deviations: float | None) -> float:
    """The share of equal sketch values below which a pair is left; 0 without deviations."""
    p = percent / 100
    return p - deviations * (p * (1 - p) / VALUES) ** 0.5 if deviations is not None else 0.0


def alike(sketch: np.ndarray) -> np.ndarray:
    """How many values each two sketches share."""
    n = len(sketch)
    if n <= 32:
        return (sketch[:, None, :] == sketch[None, :, :]).sum(2, dtype=np.int16)
    same, columns = np.zeros((n, n), np.uint8), np.ascontiguousarray(sketch.T)
    for x in range(0, n, 64):
        for c in columns:
            same[x : x + 64] += c[x : x + 64, None] == c
    return same.astype(np.int16)


def node_pairs(ids: np.ndarray, sizes: np.ndarray, sketch: np.ndarray, block: np.ndarray, group: np.ndarray | None, percent: int, most: int | None = None, deviations: float | None = DEVIATIONS) -> np.ndarray:
    """Pairs of one node, or of two of its blocks, that may be similar enough: a spanning forest, or with groups the ``most`` best of each row (or all) between different ones."""
    same = alike(sketch)
    small, large = np.minimum(sizes[:, None], sizes[None, :]), np.maximum(sizes[:, None], sizes[None, :])
    fit = (same >= least_share(percent, deviations) * sketch.shape[1]) & (100 * small >= percent * large) & (ids[:, None] != ids[None, :])
    if block[0] != block[-1]:
        fit &= block[:, None] != block[None, :]  # pairs inside a block have their own place
    if group is not None:
        fit &= group[:, None] != group[None, :]
    if not fit.any():
        return np.empty((0, 2), np.int64)
    if group is not None:
        if most is not None and most < len(ids):
            score = np.where(fit, same, -1)
            best = np.argpartition(-score, most - 1, axis=1)[:, :most]
            few = np.zeros_like(fit)
            np.put_along_axis(few, best, True, axis=1)
            fit &= few | few.T
        i, j = np.nonzero(np.triu(fit, 1))
    else:  # Prim's maximum spanning forest
        score = np.where(fit, same, -1)
        near, link, out = np.full(len(ids), -1, np.int16), np.zeros(len(ids), np.int64), []
        left = fit.any(1)
        while left.any():
            v = int(np.argmax(np.where(left, near, -2)))
            if near[v] >= 0:
                out.append((link[v], v))
            left[v] = False
            better = score[v] > near
            near[better], link[better] = score[v][better], v
        i, j = np.array(out, np.int64).reshape(-1, 2).T
    return np.stack([np.minimum(ids[i], ids[j]), np.maximum(ids[i], ids[j])], 1)


def node_links(ids: np.ndarray, sizes: np.ndarray, sketch: np.ndarray, block: np.ndarray, group: np.ndarray, held: list[bytes], percent: int, deviations: float | None = DEVIATIONS) -> np.ndarray:
    """(a, b, sure) of pairs between different groups: links that the held hashes prove, one of each two groups, and pairs that they leave open."""
    pairs = node_pairs(ids, sizes, sketch, block, group, percent, len(ids), deviations)
    if not len(pairs):
        return np.empty((0, 3), np.int64)
    lists = [np.frombuffer(h, np.uint64) for h in held]
    off = np.concatenate([[0], np.cumsum([len(x) for x in lists])])
    flat = np.unique(np.concatenate(lists), return_inverse=True)[1]
    place = np.argsort(ids, kind="stable")
    a, b = (place[np.searchsorted(ids[place], pairs[:, k])] for k in (0, 1))
    out, joined = [], set()
    mark = np.zeros(int(flat.max(initial=0)) + 1, np.int64)
    order = np.argsort(a, kind="stable")
    cuts = np.flatnonzero(np.diff(a[order])) + 1
    for some in np.split(order, cuts):
        i = int(a[some[0]])
        own = flat[off[i] : off[i + 1]]
        mark[own] = 1
        common = np.add.reduceat(mark[flat], off[:-1])  # no list is empty
        mark[own] = 0
        for k in some.tolist():
            j = int(b[k])
            if sizes[i] <= len(lists[i]) and sizes[j] <= len(lists[j]):
                two = (min(group[i], group[j]), max(group[i], group[j]))
                if two not in joined and 100 * common[j] >= percent * (sizes[i] + sizes[j] - common[j]):
                    joined.add(two)
                    out.append((ids[i], ids[j], 1))
                continue
            # below the smaller of the last hashes both lists are whole: a sample of the union
            top = min((x[-1] for x, n in ((lists[i], sizes[i]), (lists[j], sizes[j])) if n > len(x)))
            x, y = lists[i][lists[i] <= top], lists[j][lists[j] <= top]
            both = len(np.intersect1d(x, y, assume_unique=True))
            seen = len(x) + len(y) - both
            p = percent / 100
            if deviations is None or both >= (p - deviations * (p * (1 - p) / seen) ** 0.5) * seen:
                out.append((ids[i], ids[j], 0))
    return np.array(out, np.int64).reshape(-1, 3)


def nodes(classes: DataFrame) -> DataFrame:
    """key and node: the nodes of all trees where each class is compared; classes alone in a node are left out."""
    token = lambda c: f"substring(path, {4 * c + 1}, 4)"
    width = 4 * LEVELS * CHOSEN
    rows = classes.select("key", F.explode(F.expr(f"transform(sequence(0, {TREES - 1}), t -> struct(cast(t as bigint) as node, substring(sig, t * {width} + 1, {width}) as path, {1 << 62}L as parent))")).alias("p")).select("key", "p.*")
    done, last = None, None
    for level in range(LEVELS):
        children = F.explode(F.expr("array(" + ", ".join(f"xxhash64(node, {c}, {token(c)})" for c in range(CHOSEN)) + ")"))
        rows = rows.select("key", children.alias("node"), F.expr(f"substring(path, {4 * CHOSEN + 1})").alias("path"), "parent")
        counts = materialise(rows.groupBy("node").agg(F.count("*").alias("size")).where("size > 1").withColumnRenamed("node", "__node"), "counts")
        rows = materialise(rows.join(counts, rows.node == counts["__node"]).drop("__node"), "level")
        ends = (F.col("size") <= SMALL) | (F.col("size") >= STAYS * F.col("parent")) if level < LEVELS - 1 else F.lit(True)
        found = rows.where(ends).select("key", "node")
        done = found if done is None else done.unionByName(found)
        discard(counts)
        rows = rows.where(~ends).select("key", "node", "path", F.col("size").alias("parent"))
        if not rows.limit(1).count():
            break
    return done


def placed(classes: DataFrame, members: DataFrame) -> DataFrame:
    """The members of nodes with the places (node, x, y) where they are compared, and ``own``, their block.

    Without groups a node of several blocks has a place for each, with the
    node's representatives. With groups (grp) a node's largest group has blocks
    of its own, which meet those of the others only.
    """
    grouped = "grp" in classes.columns
    if not grouped:
        sizes = members.groupBy("node").agg(F.count("*").alias("count"))
        large = materialise(sizes.where(F.col("count") > BLOCK).select(F.col("node").alias("__node"), F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks"), "count"), "large")
        rows = members.join(F.broadcast(large) if large.count() <= 1_000_000 else large, F.col("node") == F.col("__node"), "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
        own = F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int")
        head = F.pmod(F.xxhash64("key", F.lit(1)), F.coalesce("count", F.lit(1))) < HEADS
        at = F.when((F.col("blocks") > 1) & head, F.expr("sequence(0, blocks - 1)")).otherwise(F.array("own"))
        return rows.withColumn("own", own).withColumn("own", F.explode(at)).select("key", "node", "own", F.col("own").alias("x"), F.col("own").alias("y"))
    rows = members.join(classes.select("key", "grp"), "key")
    parts = rows.groupBy("node", "grp").agg(F.count("*").alias("n"))
    sizes = parts.groupBy("node").agg(F.max(F.struct("n", "grp")).alias("top"), F.sum("n").alias("count"), F.count("*").alias("groups")).where("groups > 1")  # nodes of one group have nothing to join
    mixed = materialise(sizes.select(F.col("node").alias("__node"), F.col("top.grp").alias("first"), F.when(F.col("count") <= BLOCK, 0).otherwise(F.ceil(F.col("top.n") / BLOCK)).cast("int").alias("wide"), F.greatest(F.lit(1), F.when(F.col("count") <= BLOCK, 1).otherwise(F.ceil((F.col("count") - F.col("top.n")) / BLOCK))).cast("int").alias("rest")), "mixed")
    rows = rows.join(F.broadcast(mixed) if mixed.count() <= 1_000_000 else mixed, F.col("node") == F.col("__node"))
    chief = (F.col("wide") > 0) & (F.col("grp") == F.col("first"))
    rows = rows.withColumn("own", F.when(chief, F.pmod(F.xxhash64("key"), F.greatest("wide", F.lit(1)))).otherwise(F.col("wide") + F.pmod(F.xxhash64("key"), F.col("rest"))).cast("int"))
    rows = rows.withColumn("other", F.explode(F.when(chief, F.expr("sequence(wide, wide + rest - 1)")).otherwise(F.expr("sequence(0, wide + rest - 1)"))))
    return rows.select("key", "node", "own", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"))


def candidates(classes: DataFrame, members: DataFrame, percent: int, most: int | None = None, deviations: float | None = DEVIATIONS) -> DataFrame:
    """Pairs a < b of classes (key, n, sig, optionally grp, held) that meet in a place of a node. With ``held`` there is a third column, ``sure``."""
    spark = classes.sparkSession
    grouped, final = "grp" in classes.columns, "held" in classes.columns
    names = ["key", "n", *(["grp"] if grouped else []), *(["held"] if final else []), "sketch"]
    low = F.expr(f"unhex(array_join(transform(sequence(0, {VALUES - 1}), i -> hex(substring(sig, 4 * i + 4, 1))), ''))")
    own = classes.withColumn("sketch", low).select(*names)
    rows = placed(classes, members).join(own, "key").select(*names, "node", "own", "x", "y")
    rows = rows.repartition(partitions(spark), "node", "x", "y").sortWithinPartitions("node", "x", "y", "own", "key")

    def run(batches):
        def pairs(table: pa.Table, bounds: list[int]):
            column = {c: table.column(c).to_numpy() for c in table.column_names if c not in ("sketch", "held")}
            held = table.column("held").to_pylist() if final else []
            sketch = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint8).reshape(-1, VALUES)
            found = []
            for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                if b - a > 1 and final:
                    found.append(node_links(column["key"][a:b], column["n"][a:b], sketch[a:b], column["own"][a:b], column["grp"][a:b], held[a:b], percent, deviations))
                elif b - a > 1:
                    found.append(node_pairs(column["key"][a:b], column["n"][a:b], sketch[a:b], column["own"][a:b], column["grp"][a:b] if grouped else None, percent, most, deviations))
                if found and (b == bounds[-1] or sum(map(len, found)) > 100_000):
                    got = np.concatenate(found)
                    found = []
                    low, high = np.minimum(got[:, 0], got[:, 1]), np.maximum(got[:, 0], got[:, 1])
                    yield pa.RecordBatch.from_arrays([pa.array(low), pa.array(high), *([pa.array(got[:, 2])] if final else [])], names=["a", "b", *(["sure"] if final else [])])

        waiting: list[pa.RecordBatch] = []
        for batch in batches:
            waiting.append(batch)
            table = pa.Table.from_batches(waiting).combine_chunks()
            place = np.stack([table.column(c).to_numpy() for c in ("node", "x", "y")])
            cut = (np.flatnonzero((place[:, 1:] != place[:, :-1]).any(0)) + 1).tolist()
            if cut:  # rows of the last place wait for more
                yield from pairs(table.slice(0, cut[-1]), [0, *cut])
                waiting = table.slice(cut[-1]).to_batches()
        if waiting:
            table = pa.Table.from_batches(waiting).combine_chunks()
            yield from pairs(table, [0, table.num_rows])

    return rows.mapInArrow(trimmed(run), "a long, b long, sure long" if final else "a long, b long").distinct()


def confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full sets are similar enough."""
    left = pairs.join(sets.select(F.col("key").alias("a"), F.col("items").alias("x")), "a")
    both = left.join(sets.select(F.col("key").alias("b"), F.col("items").alias("y")), "b").select("a", "b", "x", "y")

    def run(batches):
        for batch in batches:
            good = np.zeros(batch.num_rows, bool)
            for k, (x, y) in enumerate(zip(batch.column("x"), batch.column("y"), strict=True)):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                if len(x) and len(y):
                    common = int((x[np.minimum(np.searchsorted(x, y), len(x) - 1)] == y).sum())
                    good[k] = 100 * common >= percent * (len(x) + len(y) - common)
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(pa.array(good)), batch.column("b").filter(pa.array(good))], names=["a", "b"])

    return both.mapInArrow(trimmed(run), "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """v, root of every vertex of the edges (a, b): contraction towards smaller ids until no edge is left."""
    edges = materialise(edges.where("a <> b").distinct(), "edges")
    found = None
    while edges.count():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        step = materialise(both.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("p")).select("v", F.least("v", "p").alias("p")), "step")
        for _ in range(2):  # follow the chosen neighbours
            ahead = step.select(F.col("v").alias("w"), F.col("p").alias("q"))
            step = materialise(step.join(ahead, step.p == ahead.w, "left").select("v", F.coalesce("q", "p").alias("p")), "step")
        if found is None:
            found = step.select("v", F.col("p").alias("root"))
        else:
            ahead = step.select(F.col("v").alias("w"), "p")
            found = found.join(ahead, found.root == ahead.w, "left").select("v", F.coalesce("p", "root").alias("root"))
            found = materialise(found, "found")
        to_a, to_b = step.select(F.col("v").alias("a"), F.col("p").alias("pa")), step.select(F.col("v").alias("b"), F.col("p").alias("pb"))
        edges = edges.join(to_a, "a").join(to_b, "b").select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b"))
        edges = materialise(edges.where("a <> b").distinct(), "edges")
    if found is None:
        return edges.select(F.col("a").alias("v"), F.col("b").alias("root"))
    return found


def merged(groups: DataFrame, links: DataFrame) -> DataFrame:
    """Groups (v, root), joined where a link (a, b) leads from one to another."""
    to_a, to_b = groups.select(F.col("v").alias("a"), F.col("root").alias("ra")), groups.select(F.col("v").alias("b"), F.col("root").alias("rb"))
    joined = links.join(to_a, "a", "left").join(to_b, "b", "left").select(F.coalesce("ra", "a").alias("x"), F.coalesce("rb", "b").alias("y"))
    higher = components(joined.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")))
    higher = higher.select(F.col("v").alias("g"), F.col("root").alias("top"))
    all_v = groups.select("v", "root").unionByName(joined.select(F.col("x").alias("v"), F.col("x").alias("root"))).unionByName(joined.select(F.col("y").alias("v"), F.col("y").alias("root"))).distinct()
    all_v = all_v.groupBy("v").agg(F.min("root").alias("root"))
    return all_v.join(higher, all_v.root == higher.g, "left").select("v", F.coalesce("top", "root").alias("root"))


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", size: int = 5, percent: int = 80, deviations: float | None = DEVIATIONS) -> DataFrame:
    """One row a document: ``key``, ``n_shingles``, ``component_id`` and ``kept`` (it is its component's smallest id). Without ``deviations`` sketches leave no pair of a node out."""
    sig = materialise(signatures(docs, text, key, size), "signatures")
    classes = sig.where("n > 0 and key is not null").groupBy("s1", "s2", "n").agg(F.min("key").alias("key"), F.first("sig").alias("sig"))
    classes = materialise(classes, "classes")  # one row for each different set
    one = classes.groupBy("key").agg(F.min(F.struct("n", "s1", "s2", "sig")).alias("c")).select("key", "c.n", "c.sig")
    one = materialise(one, "one")
    members = materialise(nodes(one), "nodes")
    tried = materialise(candidates(one, members, percent, None, deviations), "first")
    wide = members.groupBy("node").agg(F.count("*").alias("size")).where(F.col("size") > BLOCK).select("node")  # not all of their pairs have met
    involved = tried.select(F.col("a").alias("key")).unionByName(tried.select(F.col("b").alias("key"))).unionByName(members.join(wide, "node", "left_semi").select("key"))
    involved = materialise(involved.distinct(), "involved")
    sets = full_sets(docs, involved, text, key, size)
    sets = materialise(sets.groupBy("key").agg(F.min(F.struct(F.length("items").alias("n"), "items")).alias("s")).select("key", "s.items"), "sets")
    groups = components(materialise(confirm(tried, sets, percent), "links"))
    for most in (SOME, None):
        again = one.join(involved, "key", "left_semi").join(groups.withColumnRenamed("v", "key"), "key", "left")
        again = again.select("key", "n", "sig", F.coalesce("root", "key").alias("grp"))
        if most is None:
            again = again.join(sets.select("key", F.substring("items", 1, 8 * HELD).alias("held")), "key")
        found = materialise(candidates(again, members.join(again.select("key"), "key", "left_semi"), percent, most, deviations), "found")
        proved = found.where("sure = 1").select("a", "b") if most is None else None
        new = (found.where("sure = 0").select("a", "b") if most is None else found).join(tried, ["a", "b"], "left_anti")
        more = confirm(new, sets, percent)
        more = materialise(more if proved is None else more.unionByName(proved), "more")
        if more.count():
            groups = materialise(merged(groups, more), "groups")
        tried = tried.unionByName(found.select("a", "b"))
    named = classes.join(groups, classes.key == groups.v, "left").select("s1", "s2", F.col("n").alias("cn"), F.coalesce("root", classes.key).alias("root"))
    rows = sig.select("key", "n", F.col("s1").alias("t1"), F.col("s2").alias("t2"))
    out = rows.join(named, (F.col("t1") == F.col("s1")) & (F.col("t2") == F.col("s2")) & (F.col("n") == F.col("cn")) & F.col("key").isNotNull(), "left")
    component = F.when(F.col("n") > 0, F.coalesce("root", "key")).otherwise(F.col("key"))
    return out.select(F.col("key").alias(key), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("key") == component, F.lit(True)).alias("kept"))


ORACLE_SQL = r"""
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') w from documents),
s as (select distinct doc_id, h from (select doc_id, unnest(case when len(w) >= 3 then list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')) when len(w) > 0 then [array_to_string(w, ' ')] else [] end) h from w)),
n as (select doc_id, count(*) n from s group by doc_id),
common as (select a.doc_id x, b.doc_id y, count(*) c from s a join s b on a.h = b.h and a.doc_id < b.doc_id group by 1, 2),
link as (select x, y from common join n a on a.doc_id = x join n b on b.doc_id = y where 100 * c >= 85 * (a.n + b.n - c)),
twoway as (select x, y from link union all select y, x from link),
reach(v, r) as (select doc_id, doc_id from documents union select reach.v, twoway.y from reach join twoway on twoway.x = reach.r)
select d.doc_id, coalesce(n.n, 0) n_shingles, m.c component_id, d.doc_id = m.c kept from documents d left join n using (doc_id) join (select v, min(r) c from reach group by v) m on m.v = d.doc_id
"""
