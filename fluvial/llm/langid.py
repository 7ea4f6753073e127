"""Language identification with error-correcting output codes.

Each language has a codeword; one logistic classifier over hashed byte n-grams
predicts each bit. Decoding adds the logistic losses of all bits, weighted by
each bit's reliability on rows kept back from training, and takes the language
whose codeword loses least; a small lead over the second is flagged.

Edge cases: a text that is null, empty or without any letter is ``und`` with
score 0 and not ambiguous; with no labelled rows every text is ``und``, with
one language every text with a letter is of it. Equal losses go to the
language that sorts first. Repeated rows give repeated results.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import product

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import extended, flat_utf8, fraction_key, sigmoid, slices

#: Buckets of the n-gram hash, and the lengths of the n-grams in bytes.
BUCKETS = 4096
ORDERS = (2, 3, 4)


def grams(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of the lower-cased letters of each text (other characters count as one space): buckets, row offsets."""
    text = pc.replace_substring_regex(pc.utf8_lower(pc.fill_null(col, "")), r"[^\pL]+", " ")
    text = pc.binary_join_element_wise("", text, "", " ")  # a space at both ends
    data, off = flat_utf8(text)
    n = len(data)
    out = np.empty((len(ORDERS), n), np.uint16)
    code = data.astype(np.uint32)
    for k, order in enumerate(ORDERS):
        h = np.full(n, order, np.uint32)
        for i in range(order):
            h[: n - i] = h[: n - i] * np.uint32(0x01000193) ^ code[i:]
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x85EBCA6B)
        out[k] = h >> np.uint32(20)
        for i in range(order - 1):  # n-grams that would run into the next text: counted with its last byte's short one
            out[k][np.maximum(off[1:] - 1 - i, 0)] = 0
    return out, off


def histogram(col: pa.Array) -> np.ndarray:
    """Square roots of n-gram frequencies, one row of BUCKETS for each text."""
    got, off = grams(col)
    rows = len(col)
    row = np.repeat(np.arange(rows), np.diff(off))
    counts = sum(np.bincount(row * BUCKETS + g, minlength=rows * BUCKETS) for g in got).reshape(rows, BUCKETS)
    counts[:, 0] = 0
    return np.sqrt(counts / np.maximum(counts.sum(1, keepdims=True), 1)).astype(np.float32)


def codewords(k: int, seed: int = 7) -> np.ndarray:
    """k codewords of +-1 bits: all splits for few languages, else random ones, the best-separated of several draws."""
    if k <= 1:
        return np.ones((k, 1))
    if k <= 6:
        bits = [b for b in product((1, -1), repeat=k) if b[0] == 1 and -1 in b]
        return np.array(bits).T
    rng, best = np.random.default_rng(seed), None
    for _ in range(64):
        code = rng.choice([-1, 1], size=(k, int(np.ceil(10 * np.log2(k)))))
        near = (code @ code.T - np.eye(k) * 1e9).max()
        if best is None or near < best[0]:
            best = (near, code)
    return best[1]


@dataclass
class Model:
    langs: list[str]
    code: np.ndarray  # languages x bits
    weights: np.ndarray  # buckets x bits
    bias: np.ndarray
    trust: np.ndarray  # weight of each bit's loss
    margin: float = 0.2


def fit(x: np.ndarray, lang: list[str], steps: int = 300, rate: float = 0.5, decay: float = 1e-5, seed: int = 7) -> Model:
    """Trains one classifier a bit by full-batch gradient steps with momentum; every fifth row is kept back to weigh the bits."""
    langs = sorted(set(lang))
    code = codewords(len(langs))
    if not langs:
        return Model([], code, np.zeros((BUCKETS, 1), np.float32), np.zeros(1, np.float32), np.ones(1))
    y = code[np.searchsorted(langs, lang)].astype(np.float32)
    back = np.arange(len(x)) % 5 == 4 if len(x) >= 50 else np.zeros(len(x), bool)
    xs, ys = x[~back], y[~back]
    weight = np.array([1 / lang.count(v) for v in langs], np.float32)[np.searchsorted(langs, lang)][~back]
    weight = (weight / weight.sum())[:, None]
    w, b = np.zeros((x.shape[1], y.shape[1]), np.float32), np.zeros(y.shape[1], np.float32)
    mw, mb = np.zeros_like(w), np.zeros_like(b)
    scale = np.float32(40)
    for _ in range(steps):
        g = -ys * sigmoid(-ys * (xs @ w + b)) * weight
        mw = 0.9 * mw + xs.T @ g * scale + decay * w
        mb = 0.9 * mb + g.sum(0)
        w -= rate * mw
        b -= rate * mb
    test = back if back.any() else ~back
    right = ((x[test] @ w + b) * y[test] > 0).mean(0)
    trust = np.maximum(np.log(np.clip(right, 0.51, 0.999) / (1 - np.clip(right, 0.51, 0.999))), 0.05)
    return Model(langs, code, w, b, trust / trust.sum())


def decode(model: Model, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The nearest codeword by weighted logistic loss: index, share of the winner, lead over the second."""
    loss = np.stack([(np.logaddexp(0, -bits * c) * model.trust).sum(1) for c in model.code], 1)
    share = np.exp(-4 * (loss - loss.min(1, keepdims=True)))
    share /= share.sum(1, keepdims=True)
    best = loss.argmin(1)
    ordered = np.sort(share, 1)
    lead = ordered[:, -1] - ordered[:, -2] if share.shape[1] > 1 else ordered[:, -1]
    return best, ordered[:, -1], lead


def score_bits(model: Model, col: pa.Array) -> np.ndarray:
    """Bit scores of each text."""
    out = [histogram(col.slice(x, y - x)) @ model.weights + model.bias for x, y in _few(col)]
    return np.concatenate(out) if out else np.empty((0, model.code.shape[1]))


def _few(col: pa.Array):
    """Row ranges bounded in bytes and, for the histograms, in rows."""
    for x, y in slices(col):
        for z in range(x, y, 256):
            yield z, min(y, z + 256)


def train(docs: DataFrame, usable: Column, text: str = "text", lang: str = "lang", key: str = "doc_id", per_language: int = 600, most_rows: int = 24_000) -> Model:
    """Fits on a bounded sample by hash of the id: about ``per_language`` rows of each language, fewer where all languages together would have more than ``most_rows`` (of 8 KB)."""
    rows = docs.where(usable & F.col(lang).isNotNull() & F.col(text).isNotNull())
    counts = rows.groupBy(F.col(lang).alias("l")).count().collect()  # one row a language
    if not counts:
        return fit(np.zeros((0, BUCKETS), np.float32), [])
    spark = docs.sparkSession
    each = min(per_language, max(1, most_rows // len(counts)))
    share = spark.createDataFrame([(r["l"], min(1.0, each / r["count"])) for r in counts], "l string, share double")
    chosen = rows.join(F.broadcast(share), rows[lang] == share.l).where(fraction_key(F.col(key), 1) < F.col("share")).select(F.col(text).alias("t"), "l", F.xxhash64(F.col(key).cast("string")).alias("k"))

    def run(batches):
        for batch in batches:
            col = batch.column("t")
            x = np.concatenate([histogram(col.slice(a, b - a)) for a, b in _few(col)]) if len(col) else np.empty((0, BUCKETS), np.float32)
            yield pa.RecordBatch.from_arrays([batch.column("l"), batch.column("k"), pa.array([v.astype(np.float16).tobytes() for v in x], pa.binary())], names=["l", "k", "x"])

    got = chosen.mapInArrow(run, "l string, k long, x binary").toPandas().sort_values(["k", "l"])
    x = np.frombuffer(b"".join(got.x), np.float16).reshape(len(got), BUCKETS).astype(np.float32)
    return fit(x, got.l.tolist())


def predict(docs: DataFrame, model: Model, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Adds ``lang_pred``, ``score`` (0 to 1) and ``ambiguous`` to the kept columns."""
    rows = docs.select(*keep, F.col(text).alias("__text"))
    out = extended(rows.drop("__text").schema, "lang_pred string, score double, ambiguous boolean")
    held = docs.sparkSession.sparkContext.broadcast(model)  # bounded: buckets x bits

    def run(batches):
        model = held.value
        for batch in batches:
            col = batch.column("__text")
            known = pc.fill_null(pc.match_substring_regex(col, r"\pL"), False).to_numpy(zero_copy_only=False)
            if model.langs:
                best, share, lead = decode(model, score_bits(model, col))
                pred = np.where(known, np.array(model.langs, object)[best], "und")
            else:
                pred, share, lead = np.full(len(col), "und", object), np.zeros(len(col)), np.ones(len(col))
                known[:] = False
            more = [pa.array(pred, pa.string()), pa.array(np.where(known, share, 0.0)), pa.array(known & (lead < model.margin))]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in out.names[:-3]), *more], names=out.names)

    return rows.mapInArrow(run, out)
