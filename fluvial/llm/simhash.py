"""Near-duplicate documents by SimHash fingerprints and a Gray-order hierarchical index.

A bit of a document's 64-bit fingerprint is 1 if it is set in over half of the
XXH64 hashes (seed 42) of its word shingles, repeats included. Documents whose
fingerprints differ in at most ``most`` bits are linked; groups are the
connected components.

Each different fingerprint goes on once. Fingerprints are sorted by Gray rank,
where neighbours differ in few bits, and cut into blocks of adjacent ranks. The
index of a block (``Index``) has leaves of ``LEAF`` adjacent fingerprints and
nodes of ``FAN`` nodes above them; a node keeps the pattern of the bits that
all below it share, and their mask. Two blocks are joined by going down both
indexes at once: a pair of nodes adds the differences in the bits that both
have come to share to those counted above, and goes, with all below it, once
they are over ``most``; it is accepted whole once what is not shared could not
bring them over it. Blocks whose own patterns differ too much never meet.
There are about as many pairs of blocks as shuffle partitions, and more once a
block would be over ``LARGEST`` fingerprints. A pair of blocks returns a
spanning forest of its links, never all pairs.

Edge cases: null, empty and wordless texts have fingerprint zero and are linked
like any other; texts of fewer words than a shingle are one shingle. Very long
texts are hashed whole, a part of their shingles at a time. Repeated rows and
rows with a null id are linked like any other; a component's id is its smallest
id, null only if it has none. Ties in a bit (exactly half) give 0. An empty
table gives no rows; other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import flat_utf8, materialise, partitions, slices
from .neardup import components

#: Fingerprints of a leaf, nodes below a node, pairs of nodes that are handled at once, and the most fingerprints of a block.
LEAF, FAN, PAIRS, LARGEST = 8, 4, 1 << 14, 1 << 21
#: Shingles whose bits are counted at once.
SOME = 1 << 15


def simhash(col: pa.Array, size: int = 4, seed: int = 42) -> np.ndarray:
    """The fingerprint of each text (uint64)."""
    data, off = flat_utf8(col)
    rows = len(off) - 1
    if not len(data):
        return np.zeros(rows, np.uint64)
    lower = np.arange(256, dtype=np.uint8)
    lower[65:91] += 32
    data = lower[data]
    gap = (data == 32) | ((data >= 9) & (data <= 13))
    edge = np.zeros(len(data) + 1, bool)
    edge[off] = True
    after_gap = np.concatenate([[True], gap[:-1]])
    begin = np.flatnonzero(~gap & (edge[:-1] | after_gap))
    end = np.flatnonzero(~gap & (edge[1:] | np.concatenate([gap[1:], [True]]))) + 1
    stays = ~gap | ~after_gap  # of each run of spaces one
    at = np.concatenate([[0], np.cumsum(stays)])
    flat = memoryview(np.where(gap, np.uint8(32), data)[stays].tobytes())
    begin, end, row = at[begin], at[end - 1] + 1, np.searchsorted(off, begin, "right") - 1
    words = np.bincount(row, minlength=rows)
    n = np.maximum(words - size + 1, words > 0)  # shingles of each text
    total = np.concatenate([[0], np.cumsum(n)])
    owner = np.repeat(np.arange(rows), n)
    first = (np.cumsum(words) - words)[owner] + np.arange(total[-1]) - total[owner]
    last = np.minimum(first + size, np.cumsum(words)[owner]) - 1
    ones = np.zeros((rows, 64), np.int64)
    for x in range(0, int(total[-1]), SOME):
        part = slice(x, x + SOME)
        h = np.fromiter((xxhash.xxh64_intdigest(flat[a:b], seed) for a, b in zip(begin[first[part]].tolist(), end[last[part]].tolist(), strict=True)), np.uint64)
        bits = np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        cut = np.concatenate([[0], np.flatnonzero(np.diff(owner[part])) + 1])
        ones[owner[part][cut]] += np.add.reduceat(bits, cut, axis=0, dtype=np.int64)
    return np.packbits(2 * ones > n[:, None], axis=1).view(">u8").astype(np.uint64).ravel()


def fingerprints(docs: DataFrame, text: str = "text", key: str = "doc_id", size: int = 4) -> DataFrame:
    """key and code: the fingerprint of each text, as a signed long."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        for batch in batches:
            col = batch.column("__text")
            for x, y in slices(col):
                code = simhash(col.slice(x, y - x), size).view(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column("key").slice(x, y - x), pa.array(code)], names=["key", "code"])

    return docs.select(F.col(key).alias("key"), F.col(text).alias("__text")).mapInArrow(run, f"key {kind}, code long")


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """Each code's place in the Gray sequence: the prefix parities of its bits."""
    rank = codes.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


class Index:
    """Levels of patterns over codes sorted by Gray rank: ``levels[0]`` has the leaves, the last one the root."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        both = any_ = codes
        self.levels, fan = [], LEAF
        while not self.levels or len(both) > 1:
            cut = np.arange(0, len(both), fan)
            both, any_ = np.bitwise_and.reduceat(both, cut), np.bitwise_or.reduceat(any_, cut)
            self.levels.append((both, ~(both ^ any_)))  # the bits that are set, and those that all share
            fan = FAN

    def width(self, level: int) -> int:
        return LEAF * FAN**level

    def groups(self, most: int) -> np.ndarray:
        """For each code the place of the first one of the highest node whose codes are all linked; its own place where there is none."""
        label = np.arange(len(self.codes))
        for level, (_, mask) in enumerate(self.levels):
            close = np.flatnonzero(64 - np.bitwise_count(mask).astype(np.int64) <= most)
            at = (close[:, None] * self.width(level) + np.arange(self.width(level))).ravel()
            at = at[at < len(label)]
            label[at] = at // self.width(level) * self.width(level)
        return label


    def whole(self, label: np.ndarray, none: int) -> list[np.ndarray]:
        """For each level the label of each node whose codes all have it, and ``none`` for the others."""
        low = high = label
        out, fan = [], LEAF
        for _ in self.levels:
            cut = np.arange(0, len(low), fan)
            low, high = np.minimum.reduceat(low, cut), np.maximum.reduceat(high, cut)
            out.append(np.where(low == high, low, none))
            fan = FAN
        return out


def merged(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels (each the smallest place of its group), joined where a and b are linked."""
    while len(a):
        a, b = label[a], label[b]
        a, b = np.minimum(a, b), np.maximum(a, b)
        apart = a != b
        a, b = a[apart], b[apart]
        if not len(a):
            break
        up = np.arange(len(label))
        np.minimum.at(up, b, a)
        while (up[up] != up).any():
            up = up[up]
        label = up[label]
    return label


def forest(x: Index, y: Index | None, most: int) -> tuple[np.ndarray, np.ndarray]:
    """All codes of both indexes, and for each the place of its group's first: groups by the links between x and y (or inside x)."""
    own = y is None
    y = x if own else y
    shift = 0 if own else len(x.codes)
    codes = x.codes if own else np.concatenate([x.codes, y.codes])
    label = x.groups(most) if own else np.concatenate([x.groups(most), y.groups(most) + shift])
    top = max(len(x.levels), len(y.levels)) - 1
    depth = lambda i, level: min(level, len(i.levels) - 1)
    one = np.zeros(1, np.int64)
    stack = [(top, one, one, one, np.zeros(1, np.uint64))]  # level, nodes of x and y, differences so far, bits counted so far
    joined, work = None, 0
    while stack:
        level, u, v, far, seen = stack.pop()
        if len(u) > PAIRS:
            order = np.argsort(-far, kind="stable")  # the nearest are handled first
            u, v, far, seen = u[order], v[order], far[order], seen[order]
            stack.extend((level, u[k : k + PAIRS], v[k : k + PAIRS], far[k : k + PAIRS], seen[k : k + PAIRS]) for k in range(0, len(u), PAIRS))
            continue
        kx, ky = depth(x, level), depth(y, level)
        if joined is None:
            joined, work = (x.whole(label[: len(x.codes)], -1), y.whole(label[shift:], -2)), 0
        (bu, mu), (bv, mv) = x.levels[kx], y.levels[ky]
        shared = mu[u] & mv[v]
        far = far + np.bitwise_count((bu[u] ^ bv[v]) & shared & ~seen)
        ju, jv = joined[0][kx][u], joined[1][ky][v]
        stay = (far <= most) & (ju != jv)
        sure = stay & (far + 64 - np.bitwise_count(shared).astype(np.int64) <= most)
        before = label
        label = merged(label, u[sure] * x.width(kx), v[sure] * y.width(ky) + shift)
        stay &= ~sure
        u, v, far, seen = u[stay], v[stay], far[stay], shared[stay]
        if level == 0 and len(u):
            a, b = (np.minimum(t * LEAF + np.arange(LEAF)[:, None], len(i.codes) - 1) for t, i in ((u, x), (v, y)))
            cu, cv = x.codes[a], y.codes[b]
            found = []
            for i in range(LEAF):
                j, p = np.nonzero(np.bitwise_count(cu[i] ^ cv) <= most)
                found.append((a[i][p], b[j, p] + shift))
            label = merged(label, *(np.concatenate(f) for f in zip(*found, strict=True)))
        elif len(u):
            wide = [t[:, None] * FAN + np.arange(FAN) if level < len(i.levels) else t[:, None] for t, i in ((u, x), (v, y))]
            cu, cv = np.broadcast_arrays(wide[0][:, :, None], wide[1][:, None, :])
            good = (cu < len(x.levels[depth(x, level - 1)][0])) & (cv < len(y.levels[depth(y, level - 1)][0]))
            if own:
                good &= cu <= cv
            at = np.nonzero(good)
            stack.append((level - 1, cu[at], cv[at], far[at[0]], seen[at[0]]))
        work += PAIRS
        if label is not before and work >= len(codes) // 8:
            joined = None
    return codes, label


def block_patterns(codes: DataFrame, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bits set in all codes and in any code of each block; an empty block has none in any and all in all."""

    def run(batches):
        for batch in batches:
            code = batch.column("code").to_numpy()
            block = np.searchsorted(bounds, gray_rank(code.view(np.uint64)), "right")
            order = np.argsort(block, kind="stable")
            cut = np.concatenate([[0], np.flatnonzero(np.diff(block[order])) + 1]) if len(order) else np.empty(0, np.int64)
            if len(cut):
                yield pa.RecordBatch.from_arrays([pa.array(block[order][cut]), pa.array(np.bitwise_and.reduceat(code[order], cut)), pa.array(np.bitwise_or.reduceat(code[order], cut))], names=["block", "a", "o"])

    found = codes.select("code").mapInArrow(run, "block long, a long, o long").groupBy("block").agg(F.expr("bit_and(a)").alias("a"), F.expr("bit_or(o)").alias("o")).collect()  # a row for each block
    both, any_ = np.full(len(bounds) + 1, -1, np.int64), np.zeros(len(bounds) + 1, np.int64)
    for r in found:
        both[r["block"]], any_[r["block"]] = r["a"], r["o"]
    return both.view(np.uint64), any_.view(np.uint64)


def links(codes: DataFrame, most: int = 4, blocks: int | None = None) -> DataFrame:
    """Links (a, b) between different codes, enough to join all that are linked: a spanning forest of each pair of blocks."""
    spark = codes.sparkSession
    n = codes.count()
    blocks = blocks or max(math.ceil((2 * partitions(spark)) ** 0.5), -(-n // LARGEST))
    unsigned = lambda c: np.array(c, np.int64).view(np.uint64) ^ np.uint64(1 << 63)

    def ranks(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array((gray_rank(batch.column("code").to_numpy().view(np.uint64)) ^ np.uint64(1 << 63)).view(np.int64))], names=["rank"])

    shares = [k / blocks for k in range(1, blocks)]
    cuts = codes.select("code").mapInArrow(ranks, "rank long").agg(F.percentile_approx("rank", shares, 20 * blocks).alias("p")).first()["p"] if shares and n else None
    bounds = np.unique(unsigned(cuts or []))
    both, any_ = block_patterns(codes, bounds)
    mask = ~(both ^ any_)
    full = np.flatnonzero((both & ~any_) == 0)
    partners: list[np.ndarray] = [np.empty(0, np.int64)] * len(both)
    for i in full.tolist():  # blocks whose patterns leave room for a link
        partners[i] = full[np.bitwise_count((both[i] ^ both[full]) & mask[i] & mask[full]) <= most]
    partners = spark.sparkContext.broadcast(partners)

    def spread(batches):
        for batch in batches:
            code = batch.column("code").to_numpy()
            rank = gray_rank(code.view(np.uint64))
            own = np.searchsorted(bounds, rank, "right")
            for x in range(0, len(code), 1024):
                some = [partners.value[b] for b in own[x : x + 1024].tolist()]
                other = np.concatenate(some)
                at = x + np.repeat(np.arange(len(some)), [len(s) for s in some])
                columns = [np.minimum(own[at], other), np.maximum(own[at], other), (rank[at] ^ np.uint64(1 << 63)).view(np.int64), code[at], own[at]]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["x", "y", "rank", "code", "own"])

    rows = codes.select("code").mapInArrow(spread, "x long, y long, rank long, code long, own long")
    rows = rows.repartition(partitions(spark), "x", "y").sortWithinPartitions("x", "y", "rank")

    def joined(table: pa.Table) -> pa.RecordBatch:
        code, own = table.column("code").to_numpy().view(np.uint64), table.column("own").to_numpy()
        x, y = int(table.column("x")[0].as_py()), int(table.column("y")[0].as_py())
        if x == y:
            flat, label = forest(Index(code), None, most)
        elif (own == x).all() or (own == y).all():
            flat, label = code[:0], np.empty(0, np.int64)
        else:
            flat, label = forest(Index(code[own == x]), Index(code[own == y]), most)
        at = np.flatnonzero(label != np.arange(len(label)))
        return pa.RecordBatch.from_arrays([pa.array(flat[label[at]].view(np.int64)), pa.array(flat[at].view(np.int64))], names=["a", "b"])

    def run(batches):
        waiting: list[pa.RecordBatch] = []
        for batch in batches:
            waiting.append(batch)
            first, last = waiting[0], batch
            if (first.column("x")[0], first.column("y")[0]) == (last.column("x")[-1], last.column("y")[-1]):
                continue
            table = pa.Table.from_batches(waiting).combine_chunks()
            place = np.stack([table.column(c).to_numpy() for c in ("x", "y")])
            cut = [0, *(np.flatnonzero((place[:, 1:] != place[:, :-1]).any(0)) + 1).tolist()]
            for a, b in zip(cut[:-1], cut[1:], strict=True):
                yield joined(table.slice(a, b - a))
            waiting = table.slice(cut[-1]).to_batches()  # the last pair waits for more
        if waiting:
            yield joined(pa.Table.from_batches(waiting).combine_chunks())

    return rows.mapInArrow(run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", size: int = 4, most: int = 4) -> DataFrame:
    """One row a document: ``key``, ``fingerprint`` (16 hexadecimal digits) and ``component_id``."""
    marked = materialise(fingerprints(docs, text, key, size), "fingerprints")
    classes = materialise(marked.groupBy("code").agg(F.min("key").alias("least")), "codes")
    groups = components(links(classes, most))
    rooted = classes.join(groups, classes.code == groups.v, "left").select("code", "least", F.coalesce("root", "code").alias("root"))
    rooted = materialise(rooted, "rooted")
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component_id")).withColumnRenamed("root", "r")
    named = materialise(rooted.join(smallest, rooted.root == smallest.r).select(F.col("code").alias("c"), "component_id"), "named")
    return marked.join(named, marked.code == named.c).select(F.col("key").alias(key), F.lower(F.lpad(F.hex("code"), 16, "0")).alias("fingerprint"), "component_id")
