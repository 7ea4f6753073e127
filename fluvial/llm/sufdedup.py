"""Removal of repeated substrings by a distributed difference-cover algorithm.

Two equal windows of ``length`` bytes meet at a sampled position: positions in
a difference cover (mod ``period``) are sampled in each document, and any two
windows hold sampled positions at some same distance from their starts.

1. Sample. The sampled suffixes are named by their first ``length - period +
   1`` bytes, and the names sorted; a name that stands alone rules its suffix
   out. A window can only repeat if it holds a sample that is left.
2. Recursion on names. The samples that are left are named again, by their name
   and by all bytes of the windows through it. Where such a name repeats, all
   those windows do; a first name whose second names all repeat is done.
3. Merge. Windows through a sample whose second name is alone, and those that
   may equal them (of each second name that repeats, one sample's), are named
   by their ``length`` bytes; names are sorted, and neighbours with equal
   prefixes are repeats.

To a fixed depth only equality of prefixes matters, so names are keyed hashes
and sorting them stands for ranking the suffixes. Names that decide (steps 2
and 3) have 96 bits of two polynomial hashes, with odd bases drawn at random for
each call, over byte groups that a keyed mixing function spreads first. Equal
strings always agree; two different ones agree with a chance of about 2**-96.

Documents are dealt to batches as they come. A batch sends each name once to the bucket of
its hash, as packed arrays, and gets one bit for each name back, so a passage
shared by very many documents costs a bucket one name a batch. What a batch has
found out travels along as its state. Nothing is collected anywhere; the text is
shuffled once and lost tasks are run again.

Edge cases: a null or empty text has 0 bytes and none removed; texts shorter
than ``length`` are never touched; matches never cross documents; repeated rows
are separate documents, so they repeat each other, whatever batches they are in.
``docs`` has to give the same rows in the same order when read again,
as files do; a batch that finds other names than before raises an error.
"""

from __future__ import annotations

import hashlib
import secrets
from itertools import product

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import extended, flat_utf8, input_bytes, mixed, partitions, relieved, slices, trimmed


def difference_cover(period: int) -> list[int]:
    """A perfect difference set modulo q*q + q + 1 for a prime q (Singer): every residue is a difference of two members."""
    q = next(q for q in range(1, period + 1) if q * q + q + 1 == period)
    if q == 1:
        return [0, 1]
    for a, b, c in product(range(q), repeat=3):  # x**3 = a x**2 + b x + c; wanted: powers of x run through all elements
        if not c:
            continue
        power, zeros, seen = (0, 0, 1), [], 0
        while True:
            if power[0] == 0 and seen < period:
                zeros.append(seen)
            h = power[0]
            power, seen = ((power[1] + h * a) % q, (power[2] + h * b) % q, h * c % q), seen + 1
            if power == (0, 0, 1) or seen > q**3:
                break
        if seen == q**3 - 1 and len({(x - y) % period for x in zeros for y in zeros}) == period:
            return zeros
    raise ValueError(period)


def period_for(length: int) -> tuple[int, list[int]]:
    """The largest period up to two thirds of the length, and its cover; 1 for very short lengths."""
    for q in (11, 7, 5, 3, 2):
        if 3 * (q * q + q + 1) <= 2 * length + 1:
            return q * q + q + 1, difference_cover(q * q + q + 1)
    return 1, [0]


class Names:
    """Keyed hashes of byte ranges; the key is drawn once for each call of ``dedup``."""

    def __init__(self, key: list[int], group: int):
        self.key, self.group = [np.uint64(k | 1) for k in key], group
        self.powers = [np.ones(1, np.uint64)] * 4  # of both bases and of their inverses

    def _grow(self, n: int) -> None:
        if len(self.powers[0]) < n:
            bases = [int(k) for k in self.key[-2:]]
            for i, base in enumerate([*bases, *(pow(b, -1, 1 << 64) for b in bases)]):
                a = np.full(n + n // 4, base, np.uint64)
                a[0] = 1
                self.powers[i] = np.multiply.accumulate(a)

    def of(self, data: np.ndarray, words: int) -> list:
        """Functions (starts, stops) -> unmixed hashes, as many independent ones as ``words``."""
        n = max(len(data) - self.group + 1, 0)
        self._grow(n + 1)
        if self.group == 8 and n:
            z = np.ndarray((n,), np.uint64, np.ascontiguousarray(data), strides=(1,)) ^ self.key[0]
        else:
            z = np.zeros(n, np.uint64)
            for k in range(self.group):
                z |= data[k : k + n].astype(np.uint64) << np.uint64(8 * k)
            z ^= self.key[0]
        z *= self.key[1]
        z ^= z >> np.uint64(32)
        z *= self.key[2]
        z ^= z >> np.uint64(29)
        out = []
        for k in range(words):
            sums = np.zeros(n + 1, np.uint64)
            np.cumsum(z * self.powers[k][:n], out=sums[1:])
            out.append(lambda a, b, sums=sums, inv=self.powers[2 + k]: (sums[b - (self.group - 1)] - sums[a]) * inv[a])
        return out


class Rule:
    """Lengths of windows and names, and where samples are."""

    def __init__(self, length: int):
        self.length = length
        self.period, cover = period_for(length)
        self.cover = np.array(sorted(cover))
        self.name = length - self.period + 1

    def samples(self, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sampled positions of documents that hold a window, and their documents."""
        size = np.diff(off)
        count = np.where(size >= self.length, size - self.name + 1, 0)
        rounds = -(-count // self.period)
        owner = np.repeat(np.arange(len(size)), rounds)
        number = np.arange(len(owner)) - np.repeat(np.cumsum(rounds) - rounds, rounds)
        local = (number * self.period)[:, None] + self.cover
        inside = local < count[owner][:, None]
        return (off[owner][:, None] + local)[inside], np.repeat(owner, inside.sum(1))

    def through(self, at: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last starts of the windows that hold a sample's name."""
        doc = np.searchsorted(off, at, "right") - 1
        return np.maximum(off[doc], at - self.period + 1), np.minimum(off[doc + 1] - self.length, at)


def marked(lo: np.ndarray, hi: np.ndarray, n: int) -> np.ndarray:
    """A flag for each place in one of the ranges lo..hi (both included)."""
    return np.cumsum((np.bincount(lo, minlength=n + 1) - np.bincount(hi + 1, minlength=n + 1))[:n]) > 0


def ranges(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last places of the runs of true flags."""
    step = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1) - 1


def spread(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """All places of the ranges."""
    size = hi - lo + 1
    return np.repeat(lo - (np.cumsum(size) - size), size) + np.arange(size.sum())


def bucket_of(names: np.ndarray, buckets: int) -> np.ndarray:
    return (names >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)


def short(names: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket and 32 bits of a name, enough to rule most lone names out."""
    return bucket_of(names, buckets) << np.uint64(32) | names & np.uint64(0xFFFFFFFF)


def pack(values: np.ndarray) -> bytes:
    """Sorted numbers as gaps of as few bytes as the widest needs."""
    gaps = np.diff(values, prepend=np.uint64(0))
    width = max(1, (int(gaps[1:].max() if len(gaps) > 1 else 0).bit_length() + 7) // 8)
    first = gaps[:1].copy()
    gaps[:1] = 0
    return bytes([width]) + first.tobytes() + np.ascontiguousarray(gaps.view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def unpack(data: bytes) -> np.ndarray:
    width = data[0]
    body = np.frombuffer(data, np.uint8, offset=9).reshape(-1, width)
    gaps = np.zeros((len(body), 8), np.uint8)
    gaps[:, :width] = body
    gaps = gaps.view(np.uint64).ravel()
    gaps[:1] = np.frombuffer(data, np.uint64, 1, 1)
    return np.cumsum(gaps, dtype=np.uint64)


def save(arrays: list[np.ndarray]) -> bytes:
    """Arrays of places below 2**32 as one value."""
    return np.array([len(arrays), *map(len, arrays)], "<u4").tobytes() + b"".join(a.astype("<u4").tobytes() for a in arrays)


def load(data: bytes) -> list[np.ndarray]:
    flat = np.frombuffer(data, "<u4").astype(np.int64)
    n = int(flat[0])
    return np.split(flat[1 + n :], np.cumsum(flat[1 : 1 + n])[:-1])


#: A packet has a batch's names for one bucket: of kind 1 and 2 the first one, of kind 2 and 3 all of the deciding one. Kind 0 is a batch's state.
PACKET = "batch long, bucket long, kind int, n long, names binary, more binary, twice binary"
REPLY = "batch long, bucket long, kind int, n long, bits binary, mixed binary"


def order_of(words: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """An order by all words, and in it a flag where a new value begins."""
    order = np.argsort(words[0])
    new = np.ones(len(order), bool)
    a = words[0][order]
    new[1:] = a[1:] != a[:-1]
    if len(words) > 1 and not new.all():
        other = np.zeros(len(order), bool)
        for w in words[1:]:
            b = w[order]
            other[1:] |= b[1:] != b[:-1]
        if (other & ~new).any():  # one first word with several others
            order = np.lexsort(words[::-1])
            new[1:] = False
            for w in words:
                b = w[order]
                new[1:] |= b[1:] != b[:-1]
    return order, new


def keyed(kind: int, words: list[np.ndarray], buckets: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Words as they are sent, the last one of 32 bits, and the bucket of each row."""
    if kind > 1:
        words = [*words[:-1], (words[-1] >> np.uint64(32)).astype(np.uint32)]
    if kind == 3:
        return words, bucket_of(words[0], buckets)
    first = short(words[0], buckets)
    return [first, *words[1:]], first >> np.uint64(32)


def packets(batch: int, kind: int, words: list[np.ndarray], buckets: int, state: bytes) -> pa.Table:
    """A batch's distinct names, one row a bucket, with a flag for those it has twice, and its state."""
    words, where = keyed(kind, words, buckets)
    order, new = order_of(words)
    at = np.flatnonzero(new)
    twice = np.diff(np.append(at, len(order))) > 1
    own = [w[order[at]] for w in words]
    where = where[order[at]].astype(np.int64)
    bounds = np.concatenate([[0], np.flatnonzero(np.diff(where)) + 1, [len(where)]]) if len(where) else np.array([0])
    rows = [(int(where[x]), kind, y - x, pack(own[0][x:y]), b"".join(w[x:y].tobytes() for w in own[1:]) if kind > 1 else b"", np.packbits(twice[x:y]).tobytes()) for x, y in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
    rows.append((batch % buckets, 0, 0, state, b"", b""))
    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
    cols = [pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)]
    return pa.table([pa.array([batch] * len(rows), pa.int64()), *cols], names=["batch", "bucket", "kind", "n", "names", "more", "twice"])


def flags(data: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(data, np.uint8))[:n].astype(bool)


def resolve(table: pa.Table) -> pa.Table:
    """Of one bucket: which names of each packet are in another one too, or twice in one; for kind 2 also one of each second name whose first name has a lone one too. States go on as they are."""
    rows = table.to_pylist()
    out = [(r["batch"], r["bucket"], 0, 0, r["names"], b"") for r in rows if not r["kind"]]
    rows = [r for r in rows if r["kind"]]
    if rows:
        kind, sizes = rows[0]["kind"], [r["n"] for r in rows]
        first = np.concatenate([unpack(r["names"]) for r in rows])
        words = [] if kind == 2 else [first]
        if kind == 2:
            words.append(np.concatenate([np.frombuffer(r["more"], np.uint64, r["n"]) for r in rows]))
        if kind > 1:
            words.append(np.concatenate([np.frombuffer(r["more"], np.uint32, r["n"], len(r["more"]) - 4 * r["n"]) for r in rows]))
        twice = np.concatenate([flags(r["twice"], r["n"]) for r in rows])
        order, new = order_of(words)
        at = np.flatnonzero(new)
        known = np.empty(len(order), bool)
        known[order] = np.repeat(np.add.reduceat(1 + twice[order], at) > 1, np.diff(np.append(at, len(order))))
        mixed_first = np.zeros(0, bool)
        if kind == 2:
            lone = np.unique(first[~known])
            mixed_first = np.zeros(len(first), bool)
            some = order[at]  # of equal second names one speaks for all: the windows of the others are the same
            mixed_first[some] = lone[np.minimum(np.searchsorted(lone, first[some]), len(lone) - 1)] == first[some] if len(lone) else False
        cuts = np.cumsum(sizes)[:-1]
        bits = [np.split(f, cuts) if len(f) else [f] * len(rows) for f in (known, mixed_first)]
        out += [(r["batch"], r["bucket"], kind, r["n"], np.packbits(a).tobytes(), np.packbits(b).tobytes()) for r, a, b in zip(rows, *bits, strict=True)]
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary())
    return pa.table([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], names=["batch", "bucket", "kind", "n", "bits", "mixed"])


def answers(replies: list[dict], kind: int, words: list[np.ndarray], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """For each name, whether it repeats, and for kind 2 whether its windows are to be merged with those of lone names."""
    order, new = order_of(keyed(kind, words, buckets)[0])
    place = np.empty(len(order), np.int64)
    place[order] = np.cumsum(new) - 1
    rows = sorted((r for r in replies if r["kind"] == kind), key=lambda r: r["bucket"])
    both = [np.concatenate([flags(r[c], r["n"]) for r in rows] or [np.empty(0, bool)]) for c in (("bits", "mixed") if kind == 2 else ("bits",))]
    if len(both[0]) != (int(new.sum())):
        raise RuntimeError("a batch's documents changed between two passes over it")
    return both[0][place], both[-1][place]


def dealt(batches, most: int):
    """Batches of about ``most`` bytes of text, in the order of the rows: each one's number and its rows, compressed."""
    task, made, held, size = TaskContext.get().partitionId(), 0, [], 0

    def packed() -> pa.RecordBatch:
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, held[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            for part in held:
                out.write_batch(part)
        return pa.RecordBatch.from_arrays([pa.array([task << 32 | made], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["__batch", "__rows"])

    for batch in batches:
        for x, y in slices(batch.column("__text"), most):
            held.append(batch.slice(x, y - x))
            size += pc.sum(pc.binary_length(held[-1].column("__text"))).as_py() or 0
            if size >= most // 2:
                yield packed()
                made, held, size = made + 1, [], 0
    if held:
        yield packed()


class Batch:
    """The documents of one batch in a fixed order."""

    def __init__(self, packed: pa.Table, rule: Rule, names: Names, buckets: int, part: int = 1 << 18):
        self.number = packed.column("__batch")[0].as_py()
        self.table = pa.ipc.open_stream(packed.column("__rows")[0].as_buffer()).read_all().combine_chunks()
        text = self.table.column("__text")
        self.text = text.combine_chunks() if isinstance(text, pa.ChunkedArray) else text
        self.rule, self.names, self.buckets, self.part = rule, names, buckets, part

    def parts(self, text: pa.Array):
        """(first document, place of its first byte, bytes, offsets) of slices of the documents."""
        base = 0
        for x, y in slices(text, self.part):
            data, off = flat_utf8(text.slice(x, y - x))
            yield x, base, data, off
            base += len(data)

    def first(self) -> list[np.ndarray]:
        """The names of all samples."""
        out = [np.empty(0, np.uint64)]
        for _, _, data, off in self.parts(self.text):
            at, _ = self.rule.samples(off)
            if len(at):
                out.append(mixed(self.names.of(data, 1)[0](at, at + self.rule.name)))
        return [np.concatenate(out)]

    def second(self, replies: list[dict]) -> tuple[list[np.ndarray], bytes]:
        """Names of the samples that are left. State: documents that have some, and their places in these documents alone."""
        kept, _ = answers(replies, 1, self.first(), self.buckets)
        docs, samples, seen, base = [np.empty(0, np.int64)], [np.empty(0, np.int64)], 0, 0
        for x, _, _, off in self.parts(self.text):
            at, doc = self.rule.samples(off)
            mine = kept[seen : seen + len(at)]
            seen += len(at)
            at, doc = at[mine], doc[mine]
            held, number = np.unique(doc, return_inverse=True)
            size = np.diff(off)[held]
            docs.append(x + held)
            samples.append(at + (np.cumsum(size) - size + base - off[held])[number])
            base += int(size.sum())
        state = [np.concatenate(docs), np.concatenate(samples)]
        return self.named(*state), save(state)

    def named(self, docs: np.ndarray, samples: np.ndarray) -> list[np.ndarray]:
        """First names, and both words of the names of all windows through each sample."""
        out: list[list[np.ndarray]] = [[np.empty(0, np.uint64)] for _ in range(3)]
        for _, base, data, off in self.parts(self.text.take(pa.array(docs))):
            at = samples[slice(*np.searchsorted(samples, [base, base + len(data)]))] - base
            a, b = self.rule.through(at, off)
            hashes = self.names.of(data, 2)
            out[0].append(mixed(hashes[0](at, at + self.rule.name)))
            place = (at - a).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + (b - a).astype(np.uint64)  # the same bytes around another place are another name
            for k, h in enumerate(hashes):
                out[k + 1].append(mixed(h(a, b + self.rule.length) + place))
        return [np.concatenate(w) for w in out]

    def third(self, replies: list[dict]) -> tuple[list[np.ndarray], bytes]:
        """Names of the windows to be merged. State: documents; windows known to repeat; windows that are merged."""
        docs, samples = load(next(r["bits"] for r in replies if not r["kind"]))
        repeat, is_mixed = answers(replies, 2, self.named(docs, samples), self.buckets)
        state: list[list[np.ndarray]] = [[], [], [], []]
        words: list[list[np.ndarray]] = [[np.empty(0, np.uint64)] for _ in range(2)]
        for _, base, data, off in self.parts(self.text.take(pa.array(docs))):
            n = len(data)
            x, y = np.searchsorted(samples, [base, base + n])
            a, b = self.rule.through(samples[x:y] - base, off)
            rep, mix = repeat[x:y], is_mixed[x:y]
            settled = marked(a[rep], b[rep], n)
            merged = marked(a[~rep | mix], b[~rep | mix], n)
            for k, r in enumerate((*ranges(settled), *ranges(merged))):
                state[k].append(r + base)
            starts = np.flatnonzero(merged)
            if len(starts):
                for w, h in zip(words, self.names.of(data, 2), strict=True):
                    w.append(mixed(h(starts, starts + self.rule.length)))
        found = [docs, *(np.concatenate(s) if s else np.empty(0, np.int64) for s in state)]
        return [np.concatenate(w) for w in words], save(found)

    def removed(self, replies: list[dict]):
        """(document, bytes, removed flags) of the documents that lose some."""
        docs, known_lo, known_hi, lo, hi = load(next(r["bits"] for r in replies if not r["kind"]))
        starts = spread(lo, hi)
        words: list[list[np.ndarray]] = [[np.empty(0, np.uint64)] for _ in range(2)]
        taken = self.text.take(pa.array(docs))
        for _, base, data, _ in self.parts(taken):
            at = starts[slice(*np.searchsorted(starts, [base, base + len(data)]))] - base
            if len(at):
                for w, h in zip(words, self.names.of(data, 2), strict=True):
                    w.append(mixed(h(at, at + self.rule.length)))
        repeat, _ = answers(replies, 3, [np.concatenate(w) for w in words], self.buckets)
        for first, base, data, off in self.parts(taken):
            n = len(data)
            at = starts[slice(*np.searchsorted(starts, [base, base + n]))] - base
            at = at[repeat[slice(*np.searchsorted(starts, [base, base + n]))]]
            x, y = np.searchsorted(known_lo, [base, base + n])
            last = self.rule.length - 1
            gone = marked(np.concatenate([at, known_lo[x:y] - base]), np.concatenate([at, known_hi[x:y] - base]) + last, n)
            for k, (s, e) in enumerate(zip(off[:-1].tolist(), off[1:].tolist(), strict=True)):
                if gone[s:e].any():
                    yield int(docs[first + k]), data[s:e], gone[s:e]


def dedup(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), length: int = 200, digests: bool = False) -> DataFrame:
    """One row a document: ``keep``, n_bytes, n_removed, n_spans, and the remaining text ``kept`` (or ``kept_sha256``).

    A character of which only some bytes remain is left out of ``kept``.
    """
    n = partitions(docs.sparkSession)
    # batches grow with the root of the volume, so packets keep a size; a bucket's names fit one task at any volume
    size = input_bytes(docs) or n * (8 << 20)
    batch_bytes = min(64 << 20, max(4 << 20, int(180 * size**0.5)))
    buckets = max(8, size // max(10 << 20, int(10 * size**0.5)))
    rule = Rule(length)
    key, group = [secrets.randbits(64) for _ in range(5)], min(8, rule.name)
    named = [f"__k{i}" for i in range(len(keep))]
    rows = docs.select(*(F.col(c).alias(k) for c, k in zip(keep, named, strict=True)), F.col(text).cast("string").alias("__text"))
    # a batch is one packed row, so the text is shuffled this once, and small
    staged = rows.mapInArrow(trimmed(lambda batches: dealt(batches, batch_bytes)), "__batch long, __rows binary").repartition(n, "__batch")
    out = extended(rows.select(*named).schema, "n_bytes long, n_removed long, n_spans long, " + ("kept_sha256 string" if digests else "kept string"))

    def opened(table: pa.Table) -> Batch:
        return Batch(table, rule, Names(key, group), buckets)

    def one(table: pa.Table) -> pa.Table:
        batch = opened(table)
        return packets(batch.number, 1, batch.first(), buckets, b"")

    def two(table: pa.Table, replies: pa.Table) -> pa.Table:
        batch = opened(table)
        words, state = batch.second(replies.to_pylist())
        return packets(batch.number, 2, words, buckets, state)

    def three(table: pa.Table, replies: pa.Table) -> pa.Table:
        batch = opened(table)
        words, state = batch.third(replies.to_pylist())
        return packets(batch.number, 3, words, buckets, state)

    def finish(table: pa.Table, replies: pa.Table) -> pa.Table:
        batch = opened(table)
        table, texts = batch.table, batch.text
        data, off = flat_utf8(texts)
        counts = np.zeros((2, len(texts)), np.int64)
        rest = {}
        for k, own, gone in batch.removed(replies.to_pylist()):
            counts[:, k] = gone.sum(), int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
            rest[k] = own[~gone].tobytes()
        if digests:
            view = memoryview(data)
            last = [hashlib.sha256(rest[k] if k in rest else view[s:e]).hexdigest() for k, (s, e) in enumerate(zip(off[:-1].tolist(), off[1:].tolist(), strict=True))]
        else:
            last = [rest[k].decode("utf-8", "ignore") if k in rest else t or "" for k, t in enumerate(texts.to_pylist())]
        cols = [pa.array(np.diff(off)), pa.array(counts[0]), pa.array(counts[1]), pa.array(last, pa.string())]
        return pa.table([*(table.column(k) for k in named), *cols], names=out.names)

    by_batch = staged.groupBy("__batch")
    replies = by_batch.applyInArrow(relieved(one), PACKET).groupBy("bucket").applyInArrow(relieved(resolve), REPLY)
    for step in (two, three):
        sent = by_batch.cogroup(replies.groupBy("batch")).applyInArrow(relieved(step), PACKET)
        replies = sent.groupBy("bucket").applyInArrow(relieved(resolve), REPLY)
    done = by_batch.cogroup(replies.groupBy("batch")).applyInArrow(relieved(finish), out)
    made = out.names[len(named) :]
    return done.select(*(F.col(k).alias(c) for c, k in zip(keep, named, strict=True) if c not in made), *made)

