"""Operator 13 against all pairs, on ordinary and on odd rows; that its bounds cut something is tested as well."""

import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from fluvial.llm import negatives
from fluvial.llm.vectors import LONGEST


def plain(rows, positives=5, count=10, low=30, high=90, every=10):
    good = [(i, g, [math.floor(256 * x) for x in v]) for i, v, g in rows if i is not None and g is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a in sorted({r[0] for r in good if r[0] % every == 0}):
        for width in {len(r[2]) for r in good if r[0] == a}:
            own = min(r[1:] for r in good if r[0] == a and len(r[2]) == width)
            best: dict = {}
            for i, g, v in good:
                if i != a and len(v) == width:
                    score = max(-LONGEST, min(LONGEST, sum(x * y for x, y in zip(own[1], v, strict=True))))
                    best.setdefault((g == own[0], i), []).append(score)
            first = sorted((-max(s), i) for (same, i), s in best.items() if same)[:positives]
            for p, i in first:
                fit = sorted((-max(x for x in s if 30 * -p <= 100 * x <= 90 * -p), j) for (same, j), s in best.items() if not same and any(low * -p <= 100 * x <= high * -p for x in s))
                out += [(a, i, r + 1, j, -p, -s) for r, (s, j) in enumerate(fit[:count])]
    return sorted(out)


def mined(spark, rows, kind="double"):
    frame = spark.createDataFrame([(i, v, g, "x", 1, 2) for i, v, g in rows], f"vec_id long, embedding array<{kind}>, label int, vec string, norm int, group int")
    got = negatives.mine(frame, F.expr("vec_id % 10 = 0"))
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(map(tuple, got.collect()))


def clustered(rng, n: int, width: int = 6, centres: int = 12, spread: float = 0.05):
    c = rng.normal(size=(centres, width))
    at = rng.integers(0, centres, n)
    return [(i, v, int(g)) for i, (v, g) in enumerate(zip((c[at] + spread * rng.normal(size=(n, width))).tolist(), rng.integers(0, 3, n), strict=True))]


@pytest.mark.parametrize("spread", [0.05, 2.0])
def test_equals_all_pairs(spark, spread):
    rows = clustered(np.random.default_rng(2), 400, spread=spread)
    got = mined(spark, rows)
    assert got == plain(rows) and len(got) > 500


def test_odd_rows(spark):
    """Nulls, values that are no numbers, repeated ids, ties, lengths that differ, one label that most have, very large components."""
    rng, nan, inf = np.random.default_rng(3), float("nan"), float("inf")
    rows = clustered(rng, 120)
    rows += [(None, [1.0] * 6, 1), (500, None, 1), (501, [1.0] * 6, None), (510, [nan] * 6, 1), (520, [inf] * 6, 0), (503, [None] * 6, 1), (530, [], 1), (531, [], 2), (532, [], 1)]
    rows += [(540 + k % 10, [1.0, 2.0, 3.0], k % 2) for k in range(30)] + rows[:15] + [(10, rows[11][1], 0), (11, rows[12][1], 2)]
    rows += [(600 + k, [1.0, 0.5, 0.25, 0.0, 0.0, 0.0], 1) for k in range(40)] + [(700, [1e300, 1e9, 0.0, -1e12, 1.0, 1.0], 1), (701, [2.0**40, 0.0, 0.0, 0.0, 0.0, 1.0], 2)]
    usual = [r for r in rows if r[0] not in (700,)]
    assert mined(spark, usual) == plain(usual)
    assert len(mined(spark, rows)) >= 1  # components beyond 64 bits have a result
    assert mined(spark, [r for r in rows if r[0] in (500, 501, 510, 503)]) == [] == mined(spark, [(10, [1.0], 1)])


def test_bounds_leave_rows_out(spark):
    """With clusters, few rows meet the groups of other cells, and no useful one is left out."""
    rows = clustered(np.random.default_rng(4), 600, centres=16, spread=0.01)
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    kept = negatives.prepared(frame, "embedding", "vec_id", "label", 256)
    some = kept.where("key % 10 = 0").select("key", "label", "vec", "norm")
    pivots = negatives.unpacked(pa.array([bytes(r["vec"]) for r in kept.orderBy("key").limit(16).collect()]), 6)
    cells = negatives.Cells(pivots, kept.agg(F.max("norm")).first()[0])
    placed = negatives.grouped(some, cells, 6).withColumns({"lo": F.expr("array(cast(0.8 * norm as bigint))"), "hi": F.array(F.lit(LONGEST))})
    groups = negatives.bounds(placed, cells.top)
    met = sum(negatives.spread(kept, cells, groups, 6, 1, home).count() for home in (True, False))
    assert met < 0.6 * 600 * len(groups["group"])
