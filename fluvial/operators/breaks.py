"""Natural breaks (classes of least squares) of a column of any number of values.

Values are summed up in cells between quantiles: count, sum, squares, least and
largest. Dynamic programming over the cells gives the best breaks between
cells, and, with one cell left out at each border, what a break inside a cell
could reach at least. Cells that might hold a better break are cut again, in
one pass a round, until none is left, so the result is that of all values. The
driver holds the cells.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Cells of the first pass, and parts of a cell that is cut again.
CELLS, PARTS = 512, 16


def _cells(rows: DataFrame, cuts: np.ndarray) -> list:
    """n, s, q, lo and hi of each cell (values up to its cut; the last one is open), in order."""
    held = rows.sparkSession.sparkContext.broadcast(cuts)

    @F.pandas_udf("int")
    def cell(x):
        import pandas as pd

        return pd.Series(np.searchsorted(held.value, x.to_numpy(), "left").astype(np.int32))

    c = F.col("__x")
    got = rows.groupBy(cell(c).alias("c")).agg(F.count("*").alias("n"), F.sum(c).alias("s"), F.sum(c * c).alias("q"), F.min(c).alias("lo"), F.max(c).alias("hi"))
    return sorted(got.collect(), key=lambda r: r["c"])  # a row for each cell


def _forward(n: np.ndarray, s: np.ndarray, q: np.ndarray, k: int, skip: bool) -> tuple[np.ndarray, np.ndarray]:
    """Least squares of the first c cells in j classes, and where the last class begins; with ``skip`` the cell between two classes may be left out."""
    m = len(n)
    tn, ts, tq = (np.concatenate([[0.0], np.cumsum(v)]) for v in (n, s, q))
    best, begin = np.full((k + 1, m + 1), np.inf), np.zeros((k + 1, m + 1), np.int64)
    best[0, 0] = 0.0
    for j in range(1, k + 1):
        before = best[j - 1].copy()
        if skip and j > 1:
            before[1:] = np.minimum(before[1:], best[j - 1, :-1])
        for c in range(1, m + 1):
            size = tn[c] - tn[:c]
            cost = before[:c] + np.maximum(tq[c] - tq[:c] - (ts[c] - ts[:c]) ** 2 / size, 0.0)
            begin[j, c] = int(np.argmin(cost))
            best[j, c] = cost[begin[j, c]]
    return best, begin


def natural_breaks(df: DataFrame, v: str, k: int, rounds: int = 30) -> tuple[list[float], float]:
    """The largest value of each of k classes and the goodness of fit: 1 less the share of squares within classes.

    Null, NaN and infinite values are left out; with fewer than k different
    values each is a class. Values are taken from their mean, so squares stay
    exact enough.
    """
    x = F.col(v).cast("double")
    good = df.where(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < math.inf))
    centre = good.agg(F.avg(x)).first()[0]
    if centre is None:
        return [], math.nan
    rows = good.select((x - centre).alias("__x"))
    cuts = np.unique(rows.agg(F.percentile_approx("__x", [i / CELLS for i in range(1, CELLS)], 20 * CELLS)).first()[0])
    for _ in range(rounds):
        cells = _cells(rows, cuts)
        n, s, q, lo, hi = (np.array([r[c] for r in cells], float) for c in ("n", "s", "q", "lo", "hi"))
        classes = min(k, len(cells))
        best, begin = _forward(n, s, q, classes, False)
        least, _ = _forward(n, s, q, classes, True)
        back = _forward(n[::-1], s[::-1], q[::-1], classes, True)[0][:, ::-1]  # back[j, c]: cells from c on in j classes
        found = best[classes, len(n)]
        wide = lo < hi
        reach = np.full(len(n), np.inf)
        for j in range(1, k):
            if j < classes + 1 and k - j < classes + 1:
                reach = np.minimum(reach, least[j, :-1] + back[k - j, 1:])
        if classes < k:
            reach[:] = 0.0
        else:
            reach = np.minimum(reach, np.where(np.arange(len(n)) == 0, back[k - 1, 1:] if k > 1 else np.inf, np.inf))
            reach = np.minimum(reach, np.where(np.arange(len(n)) == len(n) - 1, least[k - 1, :-1] if k > 1 else np.inf, np.inf))
        open_ = np.flatnonzero(wide & (reach < found * (1 - 1e-12)))
        if not len(open_):
            break
        new = [np.linspace(lo[i], hi[i], PARTS + 1)[:-1] for i in open_]  # the least value is a cell of its own
        cuts = np.unique(np.concatenate([cuts, hi, *new]))
    ends, c = [], len(n)
    for j in range(classes, 0, -1):
        ends.append(float(hi[c - 1] + centre))
        c = begin[j, c]
    total = q.sum() - s.sum() ** 2 / n.sum()
    return ends[::-1], float(1 - found / total) if total > 0 else 1.0
