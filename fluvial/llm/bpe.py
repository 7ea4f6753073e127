"""Byte-level BPE by corpus-level merge replay.

All distinct pre-tokens of a block of documents form one small corpus. An
inverted index leads from each adjacent token pair to the places where it
stands; merges are applied in rank order, each to all its places at once, and
only the neighbours of merged places get new index entries. Documents are then
written as the concatenation of their pre-tokens' ids.

Edge cases: a null text is the empty text (0 tokens); repeated rows give
repeated results; extra columns are ignored unless listed in ``keep``.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import distinct, extended, give_back, trimmed


def load_ranks(path: str) -> dict[bytes, int]:
    """Reads a rank file: a base64 token and its rank on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (x.split() for x in f if x.strip())}


class MergeReplay:
    """Encodes sets of distinct pre-tokens with one shared replay of the merges."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.whole = {t: r.to_bytes(4, "little") for t, r in ranks.items()} | {b"": b""}
        self.token = {r: t for t, r in ranks.items()}
        self.byte_id = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        self.pairs: dict[int, int] = {}  # pair as left << 32 | right -> rank of the joined token, -1 if there is none

    def encode(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word as little-endian unsigned 32-bit integers."""
        out = [self.whole.get(w) for w in words]
        rest = [i for i, ids in enumerate(out) if ids is None]
        if rest:
            for i, ids in zip(rest, self._replay([words[i] for i in rest]), strict=True):
                out[i] = ids
        return out

    def _replay(self, words: list[bytes]) -> list[bytes]:
        end = np.cumsum(np.fromiter((len(w) for w in words), np.int64, len(words)))
        tok = self.byte_id[np.frombuffer(b"".join(words), np.uint8)].astype(np.int64)
        n = len(tok)
        nxt, prv = np.arange(1, n + 1), np.arange(-1, n - 1)
        nxt[end - 1] = -1
        prv[end[:-1]] = -1
        index: dict[int, list[np.ndarray]] = {}  # rank -> places where such a pair may start
        named: dict[int, set[int]] = {}  # rank -> the pairs that join to it
        heap: list[int] = []
        late: list[np.ndarray] = []  # places where an earlier rank turned up: their words are done alone

        def note(places: np.ndarray, keys: np.ndarray, now: int) -> None:
            """Enters pairs into the index, split by the rank they join to."""
            order = np.argsort(keys, kind="stable")
            places, keys = places[order], keys[order]
            cuts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
            bounds = [0, *cuts.tolist(), len(keys)]
            for x, y in zip(bounds[:-1], bounds[1:], strict=True):
                key = int(keys[x])
                r = self.pairs.get(key)
                if r is None:
                    if len(self.pairs) > 250_000:
                        self.pairs.clear()
                    r = self.pairs[key] = self.ranks.get(self.token[key >> 32] + self.token[key & 0xFFFFFFFF], -1)
                if r < 0:
                    continue
                if r <= now:
                    late.append(places[x:y])
                if r in index:
                    index[r].append(places[x:y])
                    named[r].add(key)
                else:
                    index[r], named[r] = [places[x:y]], {key}
                    heapq.heappush(heap, r)

        at = np.flatnonzero(nxt >= 0)
        if len(at):
            note(at, tok[at] << 32 | tok[at + 1], -1)
        while heap:
            r = heapq.heappop(heap)
            lists, pairs = index.pop(r), named.pop(r)
            i = distinct(np.concatenate(lists)) if len(lists) > 1 else lists[0]
            i = i[(tok[i] >= 0) & (nxt[i] >= 0)]
            key = tok[i] << 32 | tok[nxt[i]]
            i = i[key == next(iter(pairs))] if len(pairs) == 1 else i[np.isin(key, list(pairs))]
            if not len(i):
                continue
            tied = nxt[i[:-1]] == i[1:]
            if tied.any():  # overlapping pairs: every second one of a chain, from the left
                first = np.concatenate([[True], ~tied])
                start = np.maximum.accumulate(np.where(first, np.arange(len(i)), 0))
                i = i[(np.arange(len(i)) - start) % 2 == 0]
            j = nxt[i]
            f = nxt[j]
            tok[i], tok[j], nxt[i] = r, -1, f
            inner = f >= 0
            prv[f[inner]] = i[inner]
            right = i[inner]
            left = prv[i]
            left = left[left >= 0]
            places = np.concatenate([right, left])
            if len(places):
                note(places, tok[places] << 32 | tok[nxt[places]], r)
        live = tok >= 0
        flat = tok[live].astype("<u4").tobytes()
        stops = np.cumsum(live)[end - 1] * 4
        starts = np.concatenate([[0], stops[:-1]])
        out = [flat[x:y] for x, y in zip(starts.tolist(), stops.tolist(), strict=True)]
        if late:
            for w in distinct(np.searchsorted(end, np.concatenate(late), "right")).tolist():
                out[w] = np.array(self._alone(words[w]), "<u4").tobytes()
        return out

    def _alone(self, word: bytes) -> list[int]:
        """The same merges on one word: always the lowest rank there is, leftmost first."""
        parts = self.byte_id[np.frombuffer(word, np.uint8)].tolist()
        while len(parts) > 1:
            ranks = [self.ranks.get(self.token[x] + self.token[y], -1) for x, y in zip(parts[:-1], parts[1:], strict=True)]
            best = min((r for r in ranks if r >= 0), default=-1)
            if best < 0:
                break
            i = ranks.index(best)
            parts[i : i + 2] = [best]
        return parts


#: A single space between two characters that are no white space: a pre-token always begins there.
BREAK = re.compile(r"(?<=\S) (?=\S)")
#: A space beside other white space; texts without one can be cut at every space.
ODD = re.compile(r"\s | \s")


class Codec:
    """Texts to ids and back.

    A text is cut at its single spaces, where a pre-token always begins, into
    chunks; ids of chunks and of pre-tokens are kept in caches of bounded size.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str, cache: int = 120_000):
        import regex

        self.find = regex.compile(pattern).findall
        self.replay = MergeReplay(ranks)
        self.limit = cache
        self.packed: dict[str, bytes] = {}
        self.chunks: dict[str, bytes] = {}
        self.tokens = np.empty(max(ranks.values()) + 1, object)
        for t, r in ranks.items():
            self.tokens[r] = t

    def encode(self, texts: Iterable[str | None]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        alone: dict[str, str] = {}  # each distinct string once: a text is held as references to its chunks
        one = alone.setdefault
        cut, split_heads = [], []
        for t in texts:
            c = (BREAK.split(t) if ODD.search(t) else t.split(" ")) if t else []
            h = self.find(c[0]) if c else []
            split_heads.append(list(map(one, h, h)))
            cut.append(list(map(one, islice(c, 1, None), islice(c, 1, None))))
        count = Counter(chain.from_iterable(cut))
        new = [w for w in count if w not in self.chunks]
        split = []
        for w in new:
            f = self.find(" " + w)
            split.append(tuple(map(one, f, f)))
        fresh = set(chain.from_iterable(chain(split, split_heads))).difference(self.packed)
        if len(self.packed) + len(fresh) > self.limit:
            self.packed.clear()
            fresh = set(chain.from_iterable(chain(split, split_heads)))
        tokens = list(fresh)
        self.packed.update(zip(tokens, self.replay.encode([w.encode() for w in tokens]), strict=True))
        get, each = self.packed.__getitem__, self.chunks.__getitem__
        self.chunks.update(zip(new, (b"".join(map(get, x)) for x in split), strict=True))
        out = [b"".join(chain(map(get, h), map(each, c))) for h, c in zip(split_heads, cut, strict=True)]
        if len(self.chunks) > self.limit:
            self.chunks.clear()
        else:
            for w in new:
                if count[w] == 1:  # seldom words would fill the cache
                    del self.chunks[w]
        return out

    def decode(self, packed: bytes) -> bytes:
        return b"".join(self.tokens[np.frombuffer(packed, "<u4")].tolist())


def blocks(texts: pa.Array, most: int) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``most`` characters."""
    total = np.cumsum(pc.fill_null(pc.utf8_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < len(total):
        stop = min(len(total), int(np.searchsorted(total, (total[start - 1] if start else 0) + most)) + 1)
        yield start, stop
        start = stop


def encode_documents(docs: DataFrame, ranks: dict[bytes, int], pattern: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), block_chars: int = 4_000_000, digests: bool = False) -> DataFrame:
    """Adds each document's token ids and their decoding.

    Returns ``keep`` plus ``ids`` array<int> and ``decoded`` binary; with
    ``digests`` instead ``n_tokens``, ``ids_sha256`` and ``decoded_sha256``,
    which spares writing the ids.
    """
    table = docs.sparkSession.sparkContext.broadcast(ranks)  # bounded: one vocabulary
    rows = docs.select(*keep, F.col(text).alias("__text"))
    out = extended(rows.drop("__text").schema, "n_tokens long, ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>, decoded binary")
    own_names = out.names[: -3 if digests else -2]

    def run(batches):
        codec = Codec(table.value, pattern)
        for batch in batches:
            texts = batch.column("__text")
            for x, y in blocks(texts, block_chars):
                ids = codec.encode(t.as_py() for t in texts.slice(x, y - x))
                give_back()  # before the next block, which the other workers of a machine may be at
                back = [codec.decode(i) for i in ids]
                own = [batch.column(n).slice(x, y - x) for n in own_names]
                if digests:
                    more = [
                        pa.array([len(i) // 4 for i in ids], pa.int64()),
                        pa.array([hashlib.sha256(i).hexdigest() for i in ids], pa.string()),
                        pa.array([hashlib.sha256(b).hexdigest() for b in back], pa.string()),
                    ]
                else:
                    more = [pa.array([np.frombuffer(i, "<i4") for i in ids], pa.list_(pa.int32())), pa.array(back, pa.binary())]
                yield pa.RecordBatch.from_arrays([*own, *more], names=out.names)

    return rows.mapInArrow(trimmed(run), out)


def decode_documents(encoded: DataFrame, ranks: dict[bytes, int], ids: str = "ids", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Turns token ids back into text; bytes that are no UTF-8 become replacement characters. Null ids give null."""
    table = encoded.sparkSession.sparkContext.broadcast({r: t for t, r in ranks.items()})
    rows = encoded.select(*keep, F.col(ids).alias("__ids"))
    out = extended(rows.drop("__ids").schema, "text string")

    def run(batches):
        for batch in batches:
            texts = [None if i is None else b"".join(map(table.value.__getitem__, i)).decode("utf-8", "replace") for i in batch.column("__ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in out.names[:-1]), pa.array(texts, pa.string())], names=out.names)

    return rows.mapInArrow(trimmed(run), out)
