"""Maximum likelihood of many groups at once, each of any size, by partial sums.

A round sends each group some trial parameters and adds up the log-likelihood
of the group's rows at all of them in one aggregate; groups then choose their
next trials from these sums. The trials are a stencil around a point, from
which first and second differences give a Newton step, and shorter steps along
it. Where the likelihood is not concave, or ends at the edge of the support,
the best trial is the next point and the stencil shrinks. A group's rows are
never gathered: a large one is added up by many tasks, and the state of the
search is a row a group.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import distributions as D
from ..sources.tables import discard, materialise

#: Width of the first stencil and the narrowest ones, in units of a tenth of the start; steps below STILL, or that gain less than the share SMALL of the log-likelihood, end the search.
WIDE, NARROW, LAST, STILL, SMALL = 0.05, 1e-3, 1e-9, 1e-6, 1e-11
#: Shares of a Newton step that are tried beside the whole one.
SHARES = (0.5, 0.2, 0.05)
#: Groups whose state is broadcast: rows of some hundred bytes.
BROADCAST = 100_000

#: Families whose estimates are closed expressions of sums over the sample.
CLOSED: dict[str, Callable[[Column], Column]] = {
    "normal": lambda x: F.array(F.avg(x), F.stddev_pop(x)),
    "ln_normal": lambda x: F.array(F.avg(F.ln(x)), F.stddev_pop(F.ln(x))),
    "exponential": lambda x: F.array(F.min(x), F.avg(x) - F.min(x)),
    "uniform": lambda x: F.array(F.min(x), F.max(x)),
    "rayleigh": lambda x: F.array(F.sqrt(F.avg(x * x) / 2)),
    "pareto": lambda x: F.array(F.min(x), 1 / (F.avg(F.ln(x)) - F.ln(F.min(x)))),
    "poisson": lambda x: F.array(F.avg(x)),
}


def stencil(at: np.ndarray, h: np.ndarray) -> list[np.ndarray]:
    """The point, its two neighbours along each axis, and those along each two."""
    e = np.diag(h)
    p = len(at)
    return [at, *(at + s * e[i] for i in range(p) for s in (1, -1)), *(at + e[i] + e[j] for i in range(p) for j in range(i))]


def newton_step(ll: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, float] | None:
    """The step to the top of the parabola through a stencil's values and what it would gain; none where they are not finite or not concave."""
    p = len(h)
    up, down, both = ll[1 : 2 * p + 1 : 2], ll[2 : 2 * p + 1 : 2], ll[2 * p + 1 : 1 + 2 * p + p * (p - 1) // 2]
    if not np.isfinite(ll[: 1 + 2 * p + p * (p - 1) // 2]).all():
        return None
    hess = np.diag(up + down - 2 * ll[0])
    i, j = np.tril_indices(p, -1)
    hess[i, j] = hess[j, i] = both - up[i] - up[j] + ll[0]
    if np.linalg.eigvalsh(hess).max() >= 0:
        return None
    step = np.linalg.solve(-hess, (up - down) / 2)
    return step * h, float(step @ (up - down)) / 4


def advance(center: np.ndarray, best: float, trials: np.ndarray, ll: np.ndarray, h: float, unit: np.ndarray) -> tuple[np.ndarray, float, np.ndarray, float, bool]:
    """The next center, its log-likelihood, trials, stencil width and whether the search has ended."""
    p = len(center)
    size = 1 + 2 * p + p * (p - 1) // 2
    ll = np.where(np.isfinite(ll), ll, -np.inf)
    top = int(np.argmax(ll))
    if ll[0] >= best and (found := newton_step(ll, h * unit)) is not None:
        center, best = trials[0], ll[0]
        step, gain = found
        far = float(np.max(np.abs(step) / unit))
        if far <= STILL or gain <= SMALL * (1 + abs(best)):
            return center + step, best, trials, h, True
        step *= min(1.0, 20 / far)
        h = min(max(far / 10, NARROW), WIDE)
        around, more = center + step, [center + s * step for s in SHARES]
    elif ll[top] > best:  # a better point without a parabola
        way = trials[top] - center
        center, best = trials[top], ll[top]
        around, more = center, [center + s * way for s in (1, 3, 0.3)]
        h = h if top else h / 4
    else:
        h /= 4
        around, more = center, [center] * len(SHARES)
    nxt = np.array([*stencil(around, h * unit), *more])
    assert len(nxt) == size + len(SHARES)
    return center, best, nxt, h, h < LAST


def _sums(rows: DataFrame, state: DataFrame, keys: list[str], name: str, count: int, few: bool) -> DataFrame:
    """keys and ll: the log-likelihood at each trial."""
    small = state.where("not done").select(*keys, "trials")
    joined = rows.join(F.broadcast(small) if few else small, keys)
    x = F.col("__x")
    if D.express("log_pdf", x, name, F.col("trials")[0]) is not None:
        parts = [F.sum(D.express("log_pdf", x, name, F.element_at("trials", j + 1))).alias(f"l{j}") for j in range(count)]
    else:
        kinds = ", ".join(f"`{k}` {t}" for k, t in rows.select(*keys).dtypes)

        def run(batches):
            for pdf in batches:
                out = []
                for at, part in pdf.groupby("__g", sort=False):
                    v = part["__x"].to_numpy(float)
                    trials = np.stack(part["trials"].iloc[0])
                    out.append([*part[keys].iloc[0], *(float(D.evaluate(name, "log_pdf", v, p).sum()) for p in trials)])
                yield pd.DataFrame(out, columns=[*keys, *(f"l{j}" for j in range(count))])

        joined = joined.withColumn("__g", F.xxhash64(*keys)).mapInPandas(run, kinds + "".join(f", l{j} double" for j in range(count)))
        parts = [F.sum(f"l{j}").alias(f"l{j}") for j in range(count)]
    return joined.groupBy(*keys).agg(*parts).select(*keys, F.array(*(f"l{j}" for j in range(count))).alias("ll"))


def fit(df: DataFrame, v: str, keys: Sequence[str], name: str, rounds: int = 40) -> DataFrame:
    """keys, dist, params, loglik and n of each group; groups of fewer than four values have no parameters.

    Null, NaN and infinite values are left out; null keys are a group. Without
    keys all rows are one group. A search that has not ended after ``rounds``
    gives its best point, with ``converged`` false.
    """
    keys = list(keys)
    alone = not keys
    x = F.col(v).cast("double")
    rows = df.where(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < math.inf)).select(*(F.struct(F.col(k)).alias(k) for k in keys), x.alias("__x"))  # a struct is never null, so null keys join
    if alone:
        rows, keys = rows.withColumn("__one", F.lit(0)), ["__one"]
    names = D.FAMILIES[name].names
    width = len(names)
    x = F.col("__x")
    if name in CLOSED:
        found = rows.groupBy(*keys).agg(F.count("*").alias("n"), CLOSED[name](x).alias("params"))
        found = materialise(found.withColumn("params", F.when(F.col("n") > 3, F.col("params"))))
        few = found.count() <= BROADCAST
        ll = _sums(rows, found.where("params is not null").select(*keys, F.array("params").alias("trials"), F.lit(False).alias("done")), keys, name, 1, few)
        out = found.join(ll, keys, "left").select(*keys, "params", F.element_at("ll", 1).alias("loglik"), "n", F.lit(True).alias("converged"))
    else:
        out = _searched(rows, keys, name, width, rounds)
    back = [] if alone else [F.col(k)[k].alias(k) for k in keys]
    return out.select(*back, F.lit(name).alias("dist"), F.coalesce("params", F.array(*[F.lit(math.nan)] * width)).alias("params"), F.coalesce("loglik", F.lit(math.nan)).alias("loglik"), "n", "converged")


def _searched(rows: DataFrame, keys: list[str], name: str, width: int, rounds: int) -> DataFrame:
    count = 1 + 2 * width + width * (width - 1) // 2 + len(SHARES)
    shares = [k / 100 for k in range(101)]
    marks = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.percentile_approx("__x", shares, 2000).alias("q"))  # a sketch a group: only the start comes from it
    kinds = ", ".join(f"`{k}` {t}" for k, t in rows.select(*keys).dtypes)
    schema = f"{kinds}, n long, center array<double>, best double, trials array<array<double>>, h double, unit array<double>, done boolean"

    def begin(batches):
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                head = list(r[: len(keys)])
                start = np.array(D._STARTS[name](np.array(r.q, float)), float) if r.n > 3 else np.full(width, np.nan)
                good = bool(np.isfinite(start).all())
                unit = 0.1 * np.maximum(np.abs(start), 0.1)
                trials = [p.tolist() for p in [*stencil(start, WIDE * unit), *[start] * len(SHARES)]]
                out.append([*head, r.n, start.tolist(), -math.inf, trials, WIDE, unit.tolist(), not good])
            yield pd.DataFrame(out, columns=[*keys, "n", "center", "best", "trials", "h", "unit", "done"])

    def onward(batches):
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                c, best, trials, h, done = advance(np.array(r.center), r.best, np.stack(r.trials), np.array(r.ll, float), r.h, np.array(r.unit))
                out.append([*r[: len(keys)], r.n, c.tolist(), best, [t.tolist() for t in trials], h, list(r.unit), done])
            yield pd.DataFrame(out, columns=[*keys, "n", "center", "best", "trials", "h", "unit", "done"])

    state = materialise(marks.mapInPandas(begin, schema))
    few = state.count() <= BROADCAST
    for _ in range(rounds):
        if not state.where("not done").limit(1).count():
            break
        moved = state.where("not done").join(_sums(rows, state, keys, name, count, few), keys).mapInPandas(onward, schema)
        before, state = state, materialise(state.where("done").unionByName(moved))
        discard(before)
    good = F.col("best") > -math.inf
    return state.select(*keys, F.when(good, F.col("center")).alias("params"), F.when(good, F.col("best")).alias("loglik"), "n", (F.col("done") & good).alias("converged"))
