"""Random and low-discrepancy sampling, bootstrap, and Markov chains.

Replicates and chains are rows: each is made in its own task from a seed that
depends on its number alone, so results do not depend on partitioning and lost
tasks give the same rows again.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import special as S
from ..functions.distributions import apply, evaluate, l_moment_parameters, maximum_likelihood


def latin_hypercube(n: int, d: int, seed: int = 1, median: bool = False) -> np.ndarray:
    """n points, one in each of n strata of every axis."""
    rng = np.random.default_rng(seed)
    inside = 0.5 if median else rng.random((n, d))
    return (np.stack([rng.permutation(n) for _ in range(d)], 1) + inside) / n


#: Primitive polynomials (degree, inner coefficients) and first direction numbers, fixed values of Joe and Kuo (2008).
_SOBOL = [(1, 0, (1,)), (2, 1, (1, 3)), (3, 1, (1, 3, 1)), (3, 2, (1, 1, 1)), (4, 1, (1, 1, 3, 3)), (4, 4, (1, 3, 5, 13)), (5, 2, (1, 1, 5, 5, 17)), (5, 4, (1, 1, 5, 5, 5)), (5, 7, (1, 1, 7, 11, 19))]


def sobol(n: int, d: int, skip: int = 0) -> np.ndarray:
    """Points skip .. skip + n - 1 of the sequence in Gray-code order, up to 10 dimensions."""
    if d > len(_SOBOL) + 1:
        raise ValueError("at most 10 dimensions")
    bits = 52
    v = np.zeros((d, bits), np.uint64)
    v[0] = [1 << (bits - 1 - i) for i in range(bits)]
    for j in range(1, d):
        s, a, m = _SOBOL[j - 1]
        m = list(m)
        for i in range(s, bits):
            new = m[i - s] ^ (m[i - s] << s)
            for k in range(1, s):
                new ^= ((a >> (s - 1 - k)) & 1) * (m[i - k] << k)
            m.append(new)
        v[j] = [m[i] << (bits - 1 - i) for i in range(bits)]
    k = np.arange(skip, skip + n, dtype=np.uint64)
    gray = k ^ (k >> np.uint64(1))
    out = np.zeros((n, d), np.uint64)
    for i in range(bits):
        on = (gray >> np.uint64(i) & np.uint64(1)).astype(bool)
        out[on] ^= v[:, i]
    return out / float(1 << bits)


def stratify(lo: float, hi: float, bins: int, log: bool = False) -> list[tuple[float, float, float]]:
    """Bins [lower, upper) of equal width (or equal width of logarithms) with their middle."""
    edges = np.geomspace(lo, hi, bins + 1) if log else np.linspace(lo, hi, bins + 1)
    mid = np.sqrt(edges[1:] * edges[:-1]) if log else (edges[1:] + edges[:-1]) / 2
    return list(zip(edges[:-1].tolist(), edges[1:].tolist(), mid.tolist(), strict=True))


def stratify_probability(lo: float, hi: float, bins: int, by: str = "uniform") -> list[tuple[float, float, float]]:
    """Probability bins that are equal on the axis of ``by`` (uniform, normal, gumbel), with weights that add to one."""
    to = {"uniform": lambda p: p, "normal": S.normal_quantile, "gumbel": lambda p: -np.log(-np.log(p))}[by]
    back = {"uniform": lambda z: z, "normal": S.normal_cdf, "gumbel": lambda z: np.exp(-np.exp(-z))}[by]
    e = back(np.linspace(float(to(np.array(lo))), float(to(np.array(hi))), bins + 1))
    w = np.diff(e)
    w[0], w[-1] = w[0] + e[0], w[-1] + 1 - e[-1]
    return list(zip(e[:-1].tolist(), e[1:].tolist(), w.tolist(), strict=True))


def random_values(spark: SparkSession, n: int, dist: str, params: Sequence[float], seed: int = 1, per_task: int = 100_000) -> DataFrame:
    """n draws by inversion: rows (i, x)."""
    p = [float(v) for v in params]

    def run(batches):
        for pdf in batches:
            for b in pdf.id:
                count = min(per_task, n - b * per_task)
                u = np.random.default_rng([seed, int(b)]).random(count)
                yield pd.DataFrame({"i": b * per_task + np.arange(count), "x": evaluate(dist, "quantile", u, p)})

    return spark.range(0, math.ceil(n / per_task)).mapInPandas(run, "i long, x double")


def knn_resample(x: np.ndarray, n: int, k: int | None = None, seed: int = 1) -> np.ndarray:
    """Conditional bootstrap: from a value, a near one is drawn (weights 1 / rank) and its successor taken."""
    rng = np.random.default_rng(seed)
    x = np.asarray(x, float)
    k = k or max(1, int(math.sqrt(len(x))))
    w = 1 / np.arange(1, k + 1)
    w /= w.sum()
    cur, out = x[rng.integers(len(x) - 1)], []
    for _ in range(n):
        near = np.argsort(np.abs(x[:-1] - cur), kind="stable")[:k]
        cur = x[near[rng.choice(len(near), p=w[: len(near)] / w[: len(near)].sum())] + 1]
        out.append(cur)
    return np.array(out)


def block_resample(x: np.ndarray, n: int, block: int, seed: int = 1) -> np.ndarray:
    """Moving-block bootstrap."""
    rng = np.random.default_rng(seed)
    start = rng.integers(0, len(x) - block + 1, math.ceil(n / block))
    return np.asarray(x)[(start[:, None] + np.arange(block)).ravel()[:n]]


def sample_l_moments(x: np.ndarray) -> tuple[float, float, float, float]:
    x = np.sort(np.asarray(x, float))
    n, i = len(x), np.arange(len(x))
    b = [x.mean(), (i / (n - 1) * x).mean(), (i * (i - 1) / ((n - 1) * (n - 2)) * x).mean(), (i * (i - 1) * (i - 2) / ((n - 1) * (n - 2) * (n - 3)) * x).mean()]
    l2 = 2 * b[1] - b[0]
    return b[0], l2, 2 * (3 * b[2] - b[0]) / l2 - 3, 5 * (2 * (2 * b[3] - 3 * b[2]) + b[0]) / l2 + 6


def estimate(name: str, x: np.ndarray, method: str = "lmom") -> list[float]:
    """Parameters by L-moments, moments or maximum likelihood of an array."""
    if method == "mle":
        return maximum_likelihood(name, x)
    l1, l2, t3, _ = sample_l_moments(x)
    simple = {"normal": [l1, l2 * math.sqrt(math.pi)], "exponential": [l1 - 2 * l2, 2 * l2], "gumbel": [l1 - l2 / math.log(2) * 0.5772156649015329, l2 / math.log(2)], "logistic": [l1, l2]}
    if name in simple:
        return simple[name]
    if name == "generalized_logistic":
        k = -t3
        a = l2 * math.sin(k * math.pi) / (k * math.pi)
        return [l1 - a * (1 / k - math.pi / math.sin(k * math.pi)), a, k]
    if name == "generalized_pareto":
        k = (1 - 3 * t3) / (1 + t3)
        return [l1 - (2 + k) * l2, (1 + k) * (2 + k) * l2, k]
    if name in ("ln_normal", "log_normal", "log_pearson3"):
        logs = np.log(x) if name == "ln_normal" else np.log10(x)
        m = sample_l_moments(logs)
        return l_moment_parameters("pearson3", *m[:3]) if name == "log_pearson3" else [m[0], m[1] * math.sqrt(math.pi)]
    return l_moment_parameters(name, l1, l2, t3)


def _refit(dist: str, params: Sequence[float], n: int, at: np.ndarray, method: str, seed: Sequence[int], tries: int) -> tuple[list[float], np.ndarray, np.ndarray]:
    """Parameters, quantiles and the sample of a refitted draw; a draw that cannot be fitted is made again."""
    for t in range(tries):
        x = evaluate(dist, "quantile", np.random.default_rng([*seed, t]).random(n), params)
        try:
            fit = estimate(dist, x, method)
            q = evaluate(dist, "quantile", at, fit)
        except (ValueError, ZeroDivisionError, OverflowError):
            continue
        if np.isfinite(q).all():
            return fit, q, x
    raise ValueError(f"no fit of {dist} in {tries} draws")


def bootstrap(spark: SparkSession, dist: str, params: Sequence[float], n: int, replicates: int, probabilities: Sequence[float], method: str = "lmom", seed: int = 1, tries: int = 20, inner: int = 0) -> DataFrame:
    """Parametric bootstrap: rows (replicate, params, quantiles, moments, inner_mean, inner_sd) of refitted samples.

    A replicate that cannot be fitted is drawn again; one that fails ``tries``
    times is an error. With ``inner`` > 0 each replicate is itself resampled so
    often, for double bootstrap and studentised limits: the last two columns
    are the mean and deviation of the inner quantiles.
    """
    p, at = [float(v) for v in params], np.asarray(probabilities, float)

    def run(batches):
        for pdf in batches:
            rows = []
            for r in pdf.id:
                fit, q, x = _refit(dist, p, n, at, method, [seed, int(r)], tries)
                sd = x.std(ddof=1)
                moments = [float(x.mean()), float(sd), float(((x - x.mean()) ** 3).mean() / x.std() ** 3), float(((x - x.mean()) ** 4).mean() / x.std() ** 4)]
                sub = np.array([_refit(dist, fit, n, at, method, [seed, int(r), k + 1], tries)[1] for k in range(inner)])
                rows.append((int(r), fit, q.tolist(), moments, sub.mean(0).tolist() if inner else None, sub.std(0, ddof=1).tolist() if inner > 1 else None))
            yield pd.DataFrame(rows, columns=["replicate", "params", "quantiles", "moments", "inner_mean", "inner_sd"])

    schema = "replicate long, params array<double>, quantiles array<double>, moments array<double>, inner_mean array<double>, inner_sd array<double>"
    return spark.range(0, replicates, 1, min(replicates, 64)).mapInPandas(run, schema)


def double_bootstrap(replicates: DataFrame, probabilities: Sequence[float]) -> DataFrame:
    """Quantiles corrected for bias: twice each replicate's own less the mean of its inner ones, averaged over replicates (which need ``inner``)."""
    rows = replicates.select(F.posexplode(F.zip_with("quantiles", "inner_mean", lambda q, m: 2 * q - m)).alias("k", "q"))
    return rows.groupBy("k").agg(F.avg("q").alias("corrected")).select(F.element_at(F.array(*(F.lit(float(p)) for p in probabilities)), F.col("k") + 1).alias("p"), "corrected")


def acceleration(dist: str, x: np.ndarray, probabilities: Sequence[float], method: str = "lmom") -> list[float]:
    """Skewness of the jackknife's quantiles, for limits by BCa."""
    x, at = np.asarray(x, float), np.asarray(probabilities, float)
    q = np.array([evaluate(dist, "quantile", at, estimate(dist, np.delete(x, i), method)) for i in range(len(x))])
    d = q.mean(0) - q
    return ((d**3).sum(0) / (6 * np.maximum((d**2).sum(0), 1e-300) ** 1.5)).tolist()


def percentile_intervals(replicates: DataFrame, probabilities: Sequence[float], level: float = 0.9, estimates: Sequence[float] | None = None, how: str = "percentile", accelerations: Sequence[float] | None = None, errors: Sequence[float] | None = None) -> DataFrame:
    """Lower and upper limits of each quantile.

    percentile; normal (on cube roots), bias_corrected, pivotal (2 estimate - q) and
    bca (with ``accelerations``) need the ``estimates`` of the sample itself, student
    also its ``errors`` and replicates with ``inner``.
    """
    if how != "percentile" and estimates is None:
        raise ValueError(f"{how} limits need the estimates of the sample")
    if how == "bca" and accelerations is None or how == "student" and errors is None:
        raise ValueError(f"{how} limits need accelerations or errors")
    a = (1 - level) / 2
    array = lambda v: F.array(*(F.lit(float(x)) for x in v))
    ps, k = array(probabilities), F.col("k") + 1
    both = F.array(F.lit(a), F.lit(1 - a))
    rows = replicates.select(F.posexplode("quantiles").alias("k", "q"))
    low, high = F.element_at("c", 1), F.element_at("c", 2)
    if how == "percentile":
        return rows.groupBy("k").agg(F.percentile("q", both).alias("c")).select(F.element_at(ps, k).alias("p"), low.alias("lower"), high.alias("upper"))
    own = F.element_at(array(estimates), k)
    if how == "normal":
        c = F.signum("q") * F.pow(F.abs("q"), F.lit(1 / 3))
        got = rows.groupBy("k").agg(F.stddev_samp(c).alias("s"))
        z = float(S.normal_quantile(1 - a))
        root = F.signum(own) * F.pow(F.abs(own), F.lit(1 / 3))
        cube = lambda x: x * x * x
        return got.select(F.element_at(ps, k).alias("p"), cube(root - z * F.col("s")).alias("lower"), cube(root + z * F.col("s")).alias("upper"))
    if how == "pivotal":
        got = rows.groupBy("k").agg(F.percentile("q", both).alias("c"))
        return got.select(F.element_at(ps, k).alias("p"), (2 * own - high).alias("lower"), (2 * own - low).alias("upper"))
    if how == "student":
        pairs = replicates.select(F.posexplode(F.arrays_zip("quantiles", "inner_sd")).alias("k", "x")).select("k", F.try_divide(F.col("x.quantiles") - own, F.col("x.inner_sd")).alias("t"))
        got = pairs.groupBy("k").agg(F.percentile("t", both).alias("c"))
        error = F.element_at(array(errors), k)
        return got.select(F.element_at(ps, k).alias("p"), (own - high * error).alias("lower"), (own - low * error).alias("upper"))
    share = rows.groupBy("k").agg(F.avg((F.col("q") <= own).cast("double")).alias("f"), F.sort_array(F.collect_list("q")).alias("all"))
    speed = F.element_at(array(accelerations if how == "bca" else [0.0] * len(probabilities)), k)

    @F.pandas_udf("array<double>")
    def corrected(f: pd.Series, all_q: pd.Series, speed: pd.Series) -> pd.Series:
        z0 = S.normal_quantile(np.clip(f.to_numpy(float), 1e-6, 1 - 1e-6))
        ends = S.normal_quantile(np.array([a, 1 - a]))
        return pd.Series([np.quantile(q, S.normal_cdf(z + (z + ends) / (1 - s * (z + ends)))).tolist() for z, q, s in zip(z0, all_q, speed, strict=True)])

    got = share.select("k", corrected("f", "all", speed).alias("c"))
    return got.select(F.element_at(ps, k).alias("p"), low.alias("lower"), high.alias("upper"))


def pivotal_replicates(replicates: DataFrame, estimates: Sequence[float], links: Sequence[str] = ()) -> DataFrame:
    """Replicated parameters mirrored at the sample's own, in link space (a link's name for each parameter, identity beyond the list)."""
    from ..functions import scalars

    d = len(estimates)
    control = scalars.LinkController(list(links) + ["identity"] * (d - len(links)))
    own = control.forward(F.array(*(F.lit(float(e)) for e in estimates)), d)
    rows = replicates.select("replicate", control.forward(F.col("params"), d).alias("t"))
    turned = F.zip_with(own, F.col("t"), lambda e, t: 2 * e - t)
    return rows.select("replicate", control.inverse(turned, d).alias("params"))


def expected_curve(replicates: DataFrame, dist: str, points: Sequence[float]) -> DataFrame:
    """Mean, lower and upper probability (5, 95 %) of each point over the replicates' or a posterior's distributions: rows (x, expected, lower, upper)."""
    rows = replicates.select("params", F.explode(F.array(*(F.lit(float(x)) for x in points))).alias("x"))
    rows = rows.withColumn("f", apply("cdf", F.col("x"), F.lit(dist), F.col("params")))
    got = rows.groupBy("x").agg(F.avg("f").alias("expected"), F.percentile("f", F.array(F.lit(0.05), F.lit(0.95))).alias("c"))
    return got.select("x", "expected", F.element_at("c", 1).alias("lower"), F.element_at("c", 2).alias("upper"))


def mode_curve(dist: str, params: Sequence[float], probabilities: Sequence[float]) -> list[tuple[float, float]]:
    """Quantiles of the most likely distribution."""
    return list(zip(map(float, probabilities), evaluate(dist, "quantile", probabilities, params).tolist(), strict=True))


def log_grid(lo: float, hi: float, points: int = 100) -> np.ndarray:
    """Values that are equally spaced in logarithms, shifted where the range is not positive."""
    shift = 0.0 if lo > 0 else 1 - lo
    return np.geomspace(lo + shift, hi + shift, points) - shift


def minimum_size(q: float = 0.025, r: float = 0.005, s: float = 0.95) -> int:
    """Draws needed to know a quantile's probability within r, with probability s (Raftery and Lewis)."""
    z = float(S.normal_quantile((1 + s) / 2))
    return math.ceil(q * (1 - q) * (z / r) ** 2)


def multivariate_strata(bins: Sequence[Sequence[tuple[float, float, float]]], corr, seed: int = 1) -> np.ndarray:
    """One bin of each axis a row, without replacement, in an order whose normal scores have a correlation."""
    n = len(bins[0])
    z = np.random.default_rng(seed).normal(size=(n, len(bins))) @ np.linalg.cholesky(np.asarray(corr, float)).T
    return np.argsort(np.argsort(z, 0, kind="stable"), 0, kind="stable")


def bins_to_probability(bins: Sequence[tuple[float, float, float]], dist: str, params: Sequence[float], exceedance: bool = False) -> list[tuple[float, float, float]]:
    """Value bins as probability bins (or exceedance bins, in falling order of value) with their mass."""
    e = evaluate(dist, "cdf", [b[0] for b in bins] + [bins[-1][1]], params)
    e = 1 - e if exceedance else e
    return [(float(a), float(b), float(abs(b - a))) for a, b in zip(e[:-1], e[1:], strict=True)]


def strata_xml(bins: Sequence[tuple[float, float, float]]) -> str:
    """Bins as XML elements with lower, upper and weight."""
    return "<StratificationBins>" + "".join(f'<Bin LowerBound="{a!r}" UpperBound="{b!r}" Weight="{w!r}"/>' for a, b, w in bins) + "</StratificationBins>"


def strata_from_xml(text: str) -> list[tuple[float, float, float]]:
    from xml.etree import ElementTree

    return [tuple(float(e.get(k)) for k in ("LowerBound", "UpperBound", "Weight")) for e in ElementTree.fromstring(text)]


def strata_errors(lo: float, hi: float, bins: int, probability: bool = False) -> list[str]:
    """What is wrong with the options of a stratification."""
    found = []
    if not lo < hi:
        found.append("the lower bound must be below the upper one")
    if bins < 1:
        found.append("there must be a bin at least")
    if probability and not (0 <= lo and hi <= 1):
        found.append("probabilities must lie between 0 and 1")
    return found


def random_subset(df: DataFrame, n: int, seed: int = 1, key: str | None = None) -> DataFrame:
    """n rows without replacement; with a key the draw depends on keys alone, and so not on partitions."""
    order = F.rand(seed) if key is None else F.xxhash64(F.col(key), F.lit(seed))
    return df.orderBy(order, *([key] if key else [])).limit(n)


def jackknife(x: np.ndarray, statistic: Callable) -> tuple[float, np.ndarray]:
    """Standard error and leave-one-out values of a statistic."""
    x = np.asarray(x, float)
    out = np.array([statistic(np.delete(x, i)) for i in range(len(x))])
    n = len(x)
    return float(np.sqrt((n - 1) / n * ((out - statistic(x)) ** 2).sum())), out


# --- Markov chains ----------------------------------------------------------


def _adaptive_walk(rng, f, x, n, warm, thin, **_):
    d, fx = len(x), f(x)
    mean, cov, seen = x.copy(), np.eye(d) * 0.1, 1
    for k in range(warm + n * thin):
        step = (2.38**2 / d) * cov + 1e-9 * np.eye(d) if rng.random() > 0.05 else np.eye(d) * 1e-2 / d
        new = rng.multivariate_normal(x, step)
        fn = f(new)
        if math.log(rng.random() + 1e-300) < fn - fx:
            x, fx = new, fn
        if k < warm:
            seen += 1
            delta = x - mean
            mean = mean + delta / seen
            cov = cov + (np.outer(delta, x - mean) - cov) / seen
        elif (k - warm) % thin == thin - 1:
            yield x, fx


def _walk(rng, f, x, n, warm, thin, scale=None, **_):
    fx = f(x)
    s = np.broadcast_to(0.5 if scale is None else scale, len(x))
    for k in range(warm + n * thin):
        new = x + s * rng.normal(size=len(x))
        fn = f(new)
        if math.log(rng.random() + 1e-300) < fn - fx:
            x, fx = new, fn
        if k >= warm and (k - warm) % thin == thin - 1:
            yield x, fx


def _evolution(rng, f, x, n, warm, thin, snooker=0.0, **_):
    """Differences of past states as proposals, now and then along a line through one of them."""
    d, past = len(x), [x + rng.normal(size=len(x)) for _ in range(10 * len(x))]
    fx = f(x)
    for k in range(warm + n * thin):
        a, b, c = (past[i] for i in rng.choice(len(past), 3, replace=False))
        extra = 0.0
        if rng.random() < snooker and np.any(x != c):
            line = (x - c) / np.linalg.norm(x - c)
            new = x + rng.uniform(1.2, 2.2) * ((a - b) @ line) * line
            extra = (d - 1) * (math.log(np.linalg.norm(new - c) + 1e-300) - math.log(np.linalg.norm(x - c)))
        else:
            new = x + (1.0 if rng.random() < 0.1 else 2.38 / math.sqrt(2 * d)) * (a - b) + 1e-4 * rng.normal(size=d)
        fn = f(new)
        if math.log(rng.random() + 1e-300) < fn - fx + extra:
            x, fx = new, fn
        if k % 10 == 0:
            past.append(x)
        if k >= warm and (k - warm) % thin == thin - 1:
            yield x, fx


def _hamiltonian(rng, f, x, n, warm, thin, step=0.1, leaps=20, **_):
    from ..functions.optimize import gradient

    fx = f(x)
    for k in range(warm + n * thin):
        p = rng.normal(size=len(x))
        h = step * rng.uniform(0.8, 1.2)
        y, q = x.copy(), p + h / 2 * gradient(f, x)
        for i in range(leaps):
            y = y + h * q
            q = q + (h if i < leaps - 1 else h / 2) * gradient(f, y)
        fy = f(y)
        accept = fy - q @ q / 2 - fx + p @ p / 2
        if math.log(rng.random() + 1e-300) < accept:
            x, fx = y, fy
        if k < warm:  # steps towards an acceptance of 0.8
            step *= math.exp(0.05 * (min(1.0, math.exp(min(accept, 0.0))) - 0.8)) if math.isfinite(accept) else 0.8
        elif (k - warm) % thin == thin - 1:
            yield x, fx


def _no_u_turn(rng, f, x, n, warm, thin, step=0.1, depth=8, **_):
    """Trajectories double until they turn back; a state is drawn from a slice of the joint density."""
    from ..functions.optimize import gradient

    def leap(y, q, h):
        q = q + h / 2 * gradient(f, y)
        y = y + h * q
        return y, q + h / 2 * gradient(f, y)

    def grow(y, q, u, way, j, h, joint0):
        if j == 0:
            y, q = leap(y, q, way * h)
            fy = f(y)
            joint = fy - q @ q / 2
            good = math.isfinite(joint) and u <= joint
            return y, q, y, q, y, fy, int(good), math.isfinite(joint) and u < joint + 1000, min(1.0, math.exp(min(joint - joint0, 0.0))) if math.isfinite(joint) else 0.0, 1
        a = grow(y, q, u, way, j - 1, h, joint0)
        if not a[7]:
            return a
        b = grow(*(a[:2] if way < 0 else a[2:4]), u, way, j - 1, h, joint0)
        lo, hi = (b[:2], a[2:4]) if way < 0 else (a[:2], b[2:4])
        pick = b if b[6] and rng.random() < b[6] / max(a[6] + b[6], 1) else a
        span = hi[0] - lo[0]
        return *lo, *hi, pick[4], pick[5], a[6] + b[6], b[7] and span @ lo[1] >= 0 and span @ hi[1] >= 0, a[8] + b[8], a[9] + b[9]

    fx, log_h, bar, avg_h = f(x), math.log(step), 0.0, 0.0
    mu = math.log(10 * step)
    for k in range(warm + n * thin):
        p = rng.normal(size=len(x))
        joint0 = fx - p @ p / 2
        u = joint0 + math.log(rng.random() + 1e-300)
        lo, hi, total, alive, j = (x, p), (x, p), 1, True, 0
        h = math.exp(log_h)
        while alive and j < depth:
            way = -1 if rng.random() < 0.5 else 1
            t = grow(*(lo if way < 0 else hi), u, way, j, h, joint0)
            lo, hi = (t[:2], hi) if way < 0 else (lo, t[2:4])
            if t[7] and rng.random() < t[6] / total:
                x, fx = t[4], t[5]
            total += t[6]
            span = hi[0] - lo[0]
            alive = t[7] and span @ lo[1] >= 0 and span @ hi[1] >= 0
            j += 1
        if k < warm:  # dual averaging towards an acceptance of 0.8
            m = k + 1
            avg_h += (0.8 - t[8] / t[9] - avg_h) / (m + 10)
            log_h = mu - math.sqrt(m) / 0.05 * avg_h
            bar += m**-0.75 * (log_h - bar)
        else:
            log_h = bar
            if (k - warm) % thin == thin - 1:
                yield x, fx


SAMPLERS = {"rwmh": _walk, "arwmh": _adaptive_walk, "demcz": _evolution, "demczs": lambda *a, **k: _evolution(*a, **{"snooker": 0.1, **k}), "hmc": _hamiltonian, "nuts": _no_u_turn}


def gibbs(rng, propose: Callable, x, n: int, warm: int):
    """Full-conditional draws, always taken."""
    for k in range(warm + n):
        x = propose(x, rng)
        if k >= warm:
            yield x


def chains(spark: SparkSession, loglik: Callable, names: Sequence[str], start: Sequence[float], sampler: str = "demczs", chains: int = 4, draws: int = 1000, warm: int = 500, thin: int = 2, seed: int = 1, spread: float = 0.1, **options) -> DataFrame:
    """Long rows (chain, iter, param, value, loglik); one chain a task."""
    step = SAMPLERS[sampler]
    x0 = np.asarray(start, float)

    def f(x: np.ndarray) -> float:
        with np.errstate(all="ignore"):
            v = float(loglik(x))
        return v if math.isfinite(v) else -1e300

    def run(batches):
        for pdf in batches:
            for c in pdf.id:
                rng = np.random.default_rng([seed, int(c)])
                x = x0 + spread * rng.normal(size=len(x0)) * np.maximum(np.abs(x0), 1e-3)
                rows = [(int(c), i, name, float(v), float(ll)) for i, (s, ll) in enumerate(step(rng, f, x, draws, warm, thin, **options)) for name, v in zip(names, s, strict=True)]
                yield pd.DataFrame(rows, columns=["chain", "iter", "param", "value", "loglik"])

    return spark.range(0, chains, 1, chains).mapInPandas(run, "chain long, iter long, param string, value double, loglik double")


def posterior(draws: DataFrame, level: float = 0.9) -> DataFrame:
    """Mean, deviation, median, limits, and the Gelman-Rubin ratio of each parameter."""
    a = (1 - level) / 2
    per = draws.groupBy("param", "chain").agg(F.count("*").alias("n"), F.avg("value").alias("m"), F.var_samp("value").alias("v"))
    rhat = per.groupBy("param").agg(F.avg("v").alias("w"), F.var_samp("m").alias("b"), F.first("n").alias("n"))
    rhat = rhat.select("param", F.sqrt(((F.col("n") - 1) / F.col("n") * F.col("w") + F.coalesce("b", F.lit(0.0))) / F.col("w")).alias("rhat"))
    s = draws.groupBy("param").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"), F.percentile("value", F.array(F.lit(a), F.lit(0.5), F.lit(1 - a))).alias("c"))
    return s.join(rhat, "param").select("param", "mean", "sd", F.element_at("c", 2).alias("median"), F.element_at("c", 1).alias("lower"), F.element_at("c", 3).alias("upper"), "rhat")


def effective_size(x: np.ndarray) -> float:
    """From the autocorrelations (by FFT) up to the first negative one."""
    x = np.asarray(x, float) - np.mean(x)
    n = len(x)
    f = np.fft.rfft(x, 2 * n)
    r = np.fft.irfft(f * np.conj(f))[:n]
    r = r / r[0]
    stop = np.argmax(r < 0) if (r < 0).any() else n
    return float(n / (1 + 2 * r[1:stop].sum()))


def importance_sample(loglik: Callable, draw: Callable, log_density: Callable, n: int, keep: int, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Self-normalised weights of n proposals, and a systematic resample of ``keep`` of them."""
    rng = np.random.default_rng(seed)
    x = draw(rng, n)
    lw = np.array([loglik(v) for v in x]) - log_density(x)
    w = np.exp(lw - lw.max())
    w /= w.sum()
    at = np.searchsorted(np.cumsum(w), (rng.random() + np.arange(keep)) / keep)
    return w, x[np.minimum(at, n - 1)]
