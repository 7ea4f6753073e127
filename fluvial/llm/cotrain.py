"""Quality classification by co-training of a text view and a metadata view.

Two logistic classifiers see different views of a document: what its text
looks like, and its metadata (host, language, length). Over some rounds each
one labels the unlabelled rows it is sure of, for the other to learn from. Both
are then calibrated on rows kept back, and their log-odds are combined by
weights fitted on other rows kept back, so a view that says nothing gets no
weight.

Edge cases: null and empty texts have no features but a mark that they are
empty; a score depends on its own row alone; null metadata is a value of its
own; clashing columns give way to the operator's, if kept at all; with labels of one kind only, or none, every score is that label's
rate (0.5 if there is none). Repeated label rows count once, by their mean.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import RangeHash, extended, flat_utf8, fraction_key, mixed, sigmoid, slices

#: Classes of bytes: control and space, newline, digits, upper case, lower case, other bytes, and each mark.
MARKS = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
CLASSES = np.zeros(256, np.int64)
CLASSES[10], CLASSES[48:58], CLASSES[65:91], CLASSES[97:123], CLASSES[128:] = 1, 2, 3, 4, 5
CLASSES[list(MARKS)] = np.arange(6, 6 + len(MARKS))
KINDS = 6 + len(MARKS)
STATS = 6
META = 128 + 32 + 4


def text_view(col: pa.Array) -> np.ndarray:
    """Square roots of byte-class bigram frequencies, and some statistics."""
    data, off = flat_utf8(col)
    rows, size = len(col), np.diff(off)
    row = np.repeat(np.arange(rows), size)
    kind = CLASSES[data]
    pair = kind * KINDS
    pair[:-1] += kind[1:]
    ends = off[1:][size > 0] - 1
    pair[ends] = kind[ends] * KINDS  # a text's last byte has no follower: the next text's first byte is none
    x = np.bincount(row * KINDS**2 + pair, minlength=rows * KINDS**2).reshape(rows, -1).astype(np.float32)
    x = np.sqrt(x / np.maximum(size, 1)[:, None])
    space = (data == 32) | ((data >= 9) & (data <= 13))
    edge = np.zeros(len(data) + 1, bool)
    edge[off] = True
    stats = np.zeros((rows, STATS), np.float32)
    stats[:, 0] = np.log1p(size) / 10
    if len(data):
        ranges = RangeHash(data)
        for k, apart in ((1, space), (3, data == 10)):  # words, lines: how many, and how many of them are different
            begin = np.flatnonzero(~apart & (edge[:-1] | np.concatenate([[True], apart[:-1]])))
            end = np.flatnonzero(~apart & (edge[1:] | np.concatenate([apart[1:], [True]]))) + 1
            own = np.searchsorted(off, begin, "right") - 1
            h = mixed(ranges(begin, end))
            order = np.lexsort((h, own))
            h, o = h[order], own[order]
            new = np.concatenate([[True], (h[1:] != h[:-1]) | (o[1:] != o[:-1])]) if len(h) else np.empty(0, bool)
            n = np.bincount(own, minlength=rows)
            stats[:, k] = np.log1p(n) / 10
            stats[:, k + 1] = np.bincount(o[new], minlength=rows) / np.maximum(n, 1)
    stats[:, 5] = size == 0
    return np.concatenate([x, stats], 1)


def meta_view(host: pa.Array, lang: pa.Array, chars: pa.Array) -> np.ndarray:
    """Hashed host and language, and the length."""
    x = np.zeros((len(host), META), np.float32)
    at = np.arange(len(host))
    for col, start, width in ((host, 0, 128), (lang, 128, 32)):
        data, off = flat_utf8(pc.fill_null(col.cast(pa.string()), "\x00"))
        h = mixed(RangeHash(data)(off[:-1], off[1:])) % np.uint64(width)
        x[at, start + h.astype(np.int64)] = 1
    n = pc.fill_null(chars.cast(pa.float64()), 0.0).to_numpy(zero_copy_only=False)
    x[:, 160], x[:, 161], x[:, 162], x[:, 163] = np.log1p(np.maximum(n, 0)) / 10, n < 100, n < 400, n > 20_000
    return x


@dataclass
class View:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float
    slope: float = 1.0
    shift: float = 0.0

    def raw(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) / self.scale @ self.weights + self.bias

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        return self.slope * self.raw(x) + self.shift


def logistic(x: np.ndarray, y: np.ndarray, decay: float = 1e-3, steps: int = 300, rate: float = 0.05) -> tuple[np.ndarray, float]:
    """Weights and bias by Adam on all rows."""
    w, b = np.zeros(x.shape[1]), 0.0
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    for t in range(1, steps + 1):
        e = (sigmoid(x @ w + b) - y) / len(y)
        g = np.append(x.T @ e + decay * w, e.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    return w, b


def fit_view(x: np.ndarray, y: np.ndarray, cal_x: np.ndarray, cal_y: np.ndarray) -> View:
    mean, scale = x.mean(0), np.maximum(x.std(0), 0.02)
    w, b = logistic((x - mean) / scale, y)
    view = View(mean, scale, w, b)
    slope, shift = logistic(view.raw(cal_x)[:, None], cal_y, 1e-4)
    view.slope, view.shift = max(float(slope[0]), 0.0), float(shift)
    return view


@dataclass
class Model:
    rate: float
    views: list[View] = field(default_factory=list)
    mix: np.ndarray = field(default_factory=lambda: np.ones(2))
    bias: float = 0.0

    def score(self, views: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
        if not self.views:
            flat = np.full(len(views[0]), self.rate)
            return flat, [flat, flat]
        odds = [v.log_odds(x) for v, x in zip(self.views, views, strict=True)]
        return sigmoid(np.stack(odds, 1) @ self.mix + self.bias), [sigmoid(o) for o in odds]


def fit(views: list[np.ndarray], y: np.ndarray, rounds: int = 5, share: float = 0.05, sure: float = 0.95) -> Model:
    """Co-trains on rows with y of 0 or 1 (nan: unlabelled); of every six labelled rows one calibrates the views and another weighs them."""
    known = np.flatnonzero(~np.isnan(y))
    if len(known) < 30 or len(set(y[known])) < 2:
        return Model(float(y[known].mean()) if len(known) else 0.5)
    cal, blend, base = known[::6], known[3::6], np.setdiff1d(known, known[::3])
    if any(len(set(y[part])) < 2 for part in (cal, blend, base)):
        return Model(float(y[known].mean()))
    pool = np.flatnonzero(np.isnan(y))
    pseudo = [np.full(len(y), np.nan), np.full(len(y), np.nan)]  # labels that a view got from the other one
    most = max(1, int(share * len(pool)))
    trained: list[View] = []
    for turn in range(rounds + 1):
        trained = []
        for x, own in zip(views, pseudo, strict=True):
            extra = np.flatnonzero(~np.isnan(own))
            rows = np.concatenate([base, extra])
            trained.append(fit_view(x[rows], np.concatenate([y[base], own[extra]]), x[cal], y[cal]))
        if turn == rounds or not len(pool):
            break
        for k, view in enumerate(trained):
            p = sigmoid(view.log_odds(views[k][pool]))
            good, bad = np.argsort(-p, kind="stable")[:most], np.argsort(p, kind="stable")[:most]
            pseudo[1 - k][pool[good[p[good] >= sure]]] = 1.0
            pseudo[1 - k][pool[bad[p[bad] <= 1 - sure]]] = 0.0
    odds = np.stack([v.log_odds(x[blend]) for v, x in zip(trained, views, strict=True)], 1)
    mix, bias = logistic(odds, y[blend], 1e-3)
    return Model(float(y[known].mean()), trained, np.maximum(mix, 0), float(bias))


def _views(batch: pa.RecordBatch, x: int, y: int) -> list[np.ndarray]:
    part = [batch.column(c).slice(x, y - x) for c in ("__text", "__host", "__lang", "__chars")]
    return [text_view(part[0]), meta_view(*part[1:])]


def _ranges(col: pa.Array):
    for x, y in slices(col, 1 << 19):
        for z in range(x, y, 1024):
            yield z, min(y, z + 1024)


def _inputs(text: str, host: str, lang: str, chars: str) -> list:
    return [F.col(text).alias("__text"), F.col(host).cast("string").alias("__host"), F.col(lang).cast("string").alias("__lang"), F.col(chars).cast("double").alias("__chars")]


def train(docs: DataFrame, labels: DataFrame, usable, key: str = "doc_id", label: str = "quality", text: str = "text", host: str = "source", lang: str = "lang", chars: str = "n_chars", labelled: int = 4000, unlabelled: int = 6000) -> Model:
    """Fits on a bounded sample by hash of the id: about ``labelled`` usable labels and ``unlabelled`` other rows."""
    spark = docs.sparkSession
    own = labels.where(usable(F.col(key)) & F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(F.col(key).alias("k")).agg(F.avg(label).alias("y"))
    n, total = own.count(), docs.count()
    picked = own.where(fraction_key(F.col("k"), 4) < min(1.0, labelled / max(n, 1)))
    chosen = spark.createDataFrame(picked.collect(), own.schema)  # about ``labelled`` rows
    rows = docs.select(F.col(key).alias("d"), *_inputs(text, host, lang, chars)).join(F.broadcast(chosen), F.col("d") == F.col("k"), "left")
    other = (fraction_key(F.col("d"), 5) < min(1.0, unlabelled / max(total, 1))) & usable(F.col("d"))
    rows = rows.where(F.col("k").isNotNull() | other).select("__text", "__host", "__lang", "__chars", "y", F.xxhash64(F.col("d").cast("string")).alias("h"))

    def run(batches):
        for batch in batches:
            for x, y in _ranges(batch.column("__text")):
                got = [[v.astype(np.float16).tobytes() for v in view] for view in _views(batch, x, y)]
                yield pa.RecordBatch.from_arrays([batch.column("h").slice(x, y - x), batch.column("y").slice(x, y - x), *(pa.array(g, pa.binary()) for g in got)], names=["h", "y", "a", "b"])

    got = rows.mapInArrow(run, "h long, y double, a binary, b binary").toPandas().sort_values(["h", "a"])
    views = [np.frombuffer(b"".join(got[c]), np.float16).reshape(len(got), -1).astype(np.float64) if len(got) else np.zeros((0, 1)) for c in ("a", "b")]
    y = got.y.to_numpy(float)
    return fit(views, np.where(np.isnan(y), np.nan, (y >= 0.5).astype(float)))


def score(docs: DataFrame, model: Model, text: str = "text", host: str = "source", lang: str = "lang", chars: str = "n_chars", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Adds ``score`` (0 to 1), ``predicted``, ``text_score`` and ``meta_score`` to the kept columns."""
    rows = docs.select(*keep, *_inputs(text, host, lang, chars))
    out = extended(docs.select(*keep).schema, "score double, predicted int, text_score double, meta_score double")
    held = docs.sparkSession.sparkContext.broadcast(model)  # bounded: a few thousand weights

    def run(batches):
        for batch in batches:
            for x, y in _ranges(batch.column("__text")):
                both, each = held.value.score(_views(batch, x, y))
                more = [pa.array(both), pa.array((both >= 0.5).astype(np.int32)), pa.array(each[0]), pa.array(each[1])]
                yield pa.RecordBatch.from_arrays([*(batch.column(n).slice(x, y - x) for n in out.names[:-4]), *more], names=out.names)

    return rows.mapInArrow(run, out)
