"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic examples and a sample of unlabelled texts train a linear
logistic classifier under the class-prior-corrected risk
``prior * R+(positive) + max(0, R-(unlabelled) - prior * R-(positive))``.
Features are the presence of hashed words and word beginnings; those whose
document rates differ most between the two samples are kept.

Edge cases: null and empty texts have no features and get the score of the
bias alone; with no confirmed example every score is 0. Repeated label rows
count once, toxic if any says so. Repeated documents give repeated results.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import RangeHash, distinct, extended, flat_utf8, fraction_key, input_bytes, mixed, sigmoid, slices, tallied, trimmed

#: Bits of a feature's hash, and lengths in bytes of the word beginnings used.
BITS = 32
PREFIXES = (4, 5, 6, 7)


def features(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature) of every word and word beginning, with repeats."""
    data, off = flat_utf8(pc.utf8_lower(pc.fill_null(col, "")))
    if not len(data):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    letter = ((data >= 97) & (data <= 122)) | (data >= 128)
    first = letter.copy()
    first[1:] &= ~letter[:-1]
    starts_row = np.zeros(len(data), bool)
    starts_row[off[:-1][off[:-1] < len(data)]] = True
    first |= letter & starts_row
    last = np.ones(len(data), bool)
    last[:-1] = ~letter[1:] | starts_row[1:]
    begin, end = np.flatnonzero(first), np.flatnonzero(letter & last) + 1
    row = np.searchsorted(off, begin, "right") - 1
    ranges = RangeHash(data)
    rows, got = [row], [ranges(begin, end)]
    for n in PREFIXES:
        long = end - begin >= n
        rows.append(row[long])
        got.append(ranges(begin[long], begin[long] + n) + np.uint64(n))
    return np.concatenate(rows), (mixed(np.concatenate(got)) >> np.uint64(64 - BITS)).astype(np.int64)


def presence(col: pa.Array) -> list[np.ndarray]:
    """The distinct features of each text."""
    row, feature = features(col)
    key = distinct(row << BITS | feature)
    cut = np.searchsorted(key, np.arange(len(col) + 1) << BITS)
    return [(key[a:b] & ((1 << BITS) - 1)).astype(np.uint32) for a, b in zip(cut[:-1], cut[1:], strict=True)]


@dataclass
class Model:
    chosen: np.ndarray  # sorted feature ids
    weights: np.ndarray
    bias: float
    prior: float


def fit(pos: list[np.ndarray], unl: list[np.ndarray], prior: float, most: int = 1024, steps: int = 600, rate: float = 0.05, decay: float = 1e-4) -> Model:
    """Trains on lists of feature sets; full-batch Adam on the non-negative risk."""
    if not pos or not unl:
        return Model(np.empty(0, np.int64), np.empty(0), -40.0, prior)
    names, counts = tallied(np.concatenate(pos))
    other, more = tallied(np.concatenate(unl))
    at = np.minimum(np.searchsorted(other, names), max(len(other) - 1, 0))
    cp, cu = counts, np.where(other[at] == names, more[at], 0) if len(other) else np.zeros(len(names))
    rp, ru = (cp + 0.5) / (len(pos) + 1), (cu + 0.5) / (len(unl) + 1)
    z = (rp - ru) / np.sqrt(rp * (1 - rp) / len(pos) + ru * (1 - ru) / len(unl))
    z[cp + cu < 5] = 0
    # unlabelled texts hold a share ``prior`` of toxic ones, so a feature of toxic texts alone has rates that differ by 1 / prior
    z[rp < ru * max(1.5, 0.5 / max(prior, 1e-3))] = 0
    best = np.argsort(-z, kind="stable")[:most]
    chosen = np.sort(names[best[z[best] > 4]])

    def dense(sets: list[np.ndarray]) -> np.ndarray:
        x = np.zeros((len(sets), len(chosen)), np.float32)
        for i, s in enumerate(sets):
            x[i, np.isin(chosen, s, assume_unique=True)] = 1
        return x

    xp, xu = dense(pos), dense(unl)
    w, b = np.zeros(len(chosen), np.float32), 0.0
    m, v = np.zeros(len(chosen) + 1), np.zeros(len(chosen) + 1)
    for t in range(1, steps + 1):
        fp, fu = xp @ w + b, xu @ w + b
        plus = -sigmoid(-fp) / len(fp)  # gradient of the loss of a positive, log(1 + exp(-f))
        minus_p, minus_u = sigmoid(fp) / len(fp), sigmoid(fu) / len(fu)
        negative = np.logaddexp(0, fu).mean() - prior * np.logaddexp(0, fp).mean()
        if negative >= 0:
            gp, gu = prior * plus - prior * minus_p, minus_u
        else:  # the risk of the negatives is below 0: step back from it
            gp, gu = prior * minus_p, -minus_u
        g = np.append(xp.T @ gp + xu.T @ gu + decay * w, gp.sum() + gu.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = w - step[:-1].astype(np.float32), b - step[-1]
    return Model(chosen.astype(np.int64), w.astype(np.float64), float(b), prior)


def train(docs: DataFrame, labels: DataFrame, usable, text: str = "text", key: str = "doc_id", label: str = "toxic", positives: int = 2500, unlabelled: int = 7500, prior: float | None = None, most_bytes: int = 256 << 20) -> Model:
    """Fits on a bounded sample by hash of the id: about ``positives`` confirmed and ``unlabelled`` other rows, fewer where rows of the table's mean size would have more than ``most_bytes``.

    ``usable`` (id column -> condition) says whose labels may be read. ``prior`` is
    the share of toxic texts; by default the share among usable labels.
    """
    spark = docs.sparkSession
    own = labels.where(usable(F.col(key)) & F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(F.col(key).alias("k")).agg(F.max(label).alias("y"))
    n, n_pos = own.agg(F.count("*"), F.coalesce(F.sum((F.col("y") == 1).cast("int")), F.lit(0))).first()
    if not n_pos:
        return fit([], [], 0.0)
    total = docs.count()
    fit_in = most_bytes / max((positives + unlabelled) * (input_bytes(docs) or 0) / max(total, 1), 1)
    positives, unlabelled = (int(max(100, k * min(1.0, fit_in))) for k in (positives, unlabelled))
    share = min(1.0, positives / n_pos)
    ids = [r["k"] for r in own.where((F.col("y") == 1) & (fraction_key(F.col("k"), 2) < share)).select("k").collect()]  # about ``positives`` ids
    wanted = spark.createDataFrame([(k,) for k in ids], own.select("k").schema)
    rows = docs.select(F.col(key).alias("d"), F.col(text).alias("t")).join(F.broadcast(wanted), F.col("d") == F.col("k"), "left")
    u = (fraction_key(F.col("d"), 3) < min(1.0, unlabelled / max(total, 1))) & usable(F.col("d"))
    rows = rows.select("t", F.col("k").isNotNull().alias("p"), u.alias("u"), F.xxhash64(F.col("d").cast("string")).alias("h")).where(F.col("p") | F.col("u"))

    def run(batches):
        for batch in batches:
            col = batch.column("t")
            sets = [s.tobytes() for x, y in slices(col) for s in presence(col.slice(x, y - x))]
            yield pa.RecordBatch.from_arrays([batch.column("p"), batch.column("u"), batch.column("h"), pa.array(sets, pa.binary())], names=["p", "u", "h", "x"])

    got = rows.mapInArrow(trimmed(run), "p boolean, u boolean, h long, x binary").toPandas().sort_values(["h", "x"])
    sets = [np.frombuffer(x, np.uint32) for x in got.x]
    return fit([s for s, p in zip(sets, got.p, strict=True) if p], [s for s, u in zip(sets, got.u, strict=True) if u], n_pos / n if prior is None else prior)


def score(docs: DataFrame, model: Model, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Adds ``score`` (0 to 1) and ``predicted`` (1 from 0.5 on) to the kept columns."""
    rows = docs.select(*keep, F.col(text).alias("__text"))
    out = extended(rows.drop("__text").schema, "score double, predicted int")
    held = docs.sparkSession.sparkContext.broadcast(model)  # bounded: the chosen features

    def run(batches):
        model = held.value
        maybe = np.zeros(1 << 16, bool)  # low bits of the chosen features
        maybe[model.chosen & 0xFFFF] = True
        for batch in batches:
            col = batch.column("__text")
            got = []
            for x, y in slices(col):
                row, feature = features(col.slice(x, y - x))
                hit = maybe[feature & 0xFFFF]
                key = distinct(row[hit] << BITS | feature[hit])
                feature = key & ((1 << BITS) - 1)
                at = np.minimum(np.searchsorted(model.chosen, feature), max(len(model.chosen) - 1, 0))
                real = model.chosen[at] == feature if len(model.chosen) else np.zeros(len(key), bool)
                got.append(np.bincount(key[real] >> BITS, model.weights[at[real]], minlength=y - x))
            s = sigmoid((np.concatenate(got) if got else np.empty(0)) + model.bias)
            if not len(model.chosen):
                s[:] = 0.0
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in out.names[:-2]), pa.array(s, pa.float64()), pa.array((s >= 0.5).astype(np.int32))], names=out.names)

    return rows.mapInArrow(trimmed(run), out)
