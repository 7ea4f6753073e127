"""Sample statistics, error metrics, ranks and hypothesis tests as aggregates.

Everything is by group: ``keys`` may be empty. Power sums and ranks stay in
built-in aggregates and windows; only p-values need ``fluvial.functions``.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from . import pairs
from .numbering import average_ranks, numbered
from .pairs import inversions


def describe(df: DataFrame, v: str, keys: Sequence[str] = ()) -> DataFrame:
    """n, sum, min, max, means, variances, and bias-corrected skewness and excess kurtosis."""
    x = F.col(v).cast("double")
    n = F.count(x)
    positive = F.min(x) > 0
    g1, g2 = F.skewness(x), F.kurtosis(x)
    return df.groupBy(*keys).agg(
        n.alias("n"), F.sum(x).alias("total"), F.min(x).alias("minimum"), F.max(x).alias("maximum"), F.avg(x).alias("mean"),
        F.when(positive, F.exp(F.avg(F.ln(F.when(x > 0, x))))).alias("geometric"), F.when(positive, n / F.sum(F.when(x > 0, 1 / x))).alias("harmonic"),
        F.var_samp(x).alias("variance"), F.var_pop(x).alias("pop_variance"), F.stddev_samp(x).alias("sd"), F.stddev_pop(x).alias("pop_sd"), F.try_divide(F.stddev_samp(x), F.avg(x)).alias("cv"),
        F.when(n > 2, g1 * F.sqrt(n * (n - 1)) / (n - 2)).alias("skew"), F.when(n > 3, ((n + 1) * g2 + 6) * (n - 1) / ((n - 2) * (n - 3))).alias("kurt"),
    )


def percentiles(df: DataFrame, v: str, at: Sequence[float], keys: Sequence[str] = (), approximate: int = 0) -> DataFrame:
    """Percentiles by linear interpolation, one row each; ``approximate`` > 0 gives a sketch of that accuracy, which needs no group in memory."""
    cut = F.array(*(F.lit(float(a)) for a in at))
    got = F.percentile_approx(v, [float(a) for a in at], approximate) if approximate else F.percentile(v, cut)
    rows = df.groupBy(*keys).agg(got.alias("__p"))
    return rows.select(*keys, F.posexplode("__p").alias("__i", "value")).select(*keys, F.element_at(cut, F.col("__i") + 1).alias("p"), "value")


def l_moments(df: DataFrame, v: str, keys: Sequence[str] = ()) -> DataFrame:
    """L-mean, L-scale, L-skewness and L-kurtosis from unbiased probability-weighted moments (n > 3)."""
    x = F.col(v).cast("double")
    rows = numbered(df.where(x.isNotNull()).select(*keys, x.alias("x")), ["x"], keys)
    count = rows.groupBy(*keys).agg(F.count("*").cast("double").alias("n"))
    rows = rows.join(count, list(keys)) if keys else rows.join(F.broadcast(count), F.lit(True))
    i, n = (F.col("__i") - 1).cast("double"), F.col("n")
    b = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.avg("x").alias("b0"), F.avg(F.try_divide(i, n - 1) * F.col("x")).alias("b1"), F.avg(F.try_divide(i * (i - 1), (n - 1) * (n - 2)) * F.col("x")).alias("b2"), F.avg(F.try_divide(i * (i - 1) * (i - 2), (n - 1) * (n - 2) * (n - 3)) * F.col("x")).alias("b3"))
    l2 = 2 * F.col("b1") - F.col("b0")
    t3, t4 = 2 * (3 * F.col("b2") - F.col("b0")) / l2 - 3, 5 * (2 * (2 * F.col("b3") - 3 * F.col("b2")) + F.col("b0")) / l2 + 6
    return b.where("n > 3").select(*keys, "n", F.col("b0").alias("l1"), l2.alias("l2"), t3.alias("t3"), t4.alias("t4"))


def correlations(df: DataFrame, a: str, b: str, keys: Sequence[str] = ()) -> DataFrame:
    """Pearson and Spearman correlation, and both covariances."""
    ranked = average_ranks(average_ranks(df.where(F.col(a).isNotNull() & F.col(b).isNotNull()), a, keys, "__ra"), b, keys, "__rb")
    return ranked.groupBy(*keys).agg(F.corr(a, b).alias("pearson"), F.corr("__ra", "__rb").alias("spearman"), F.covar_samp(a, b).alias("cov"), F.covar_pop(a, b).alias("pop_cov"))


def concordance(x: np.ndarray, y: np.ndarray) -> tuple[int, int, int]:
    """Of two arrays the concordant less discordant pairs, and the pairs without a tie in x and in y."""
    order = np.lexsort((y, x))
    x, y = x[order], y[order]
    tied = lambda a: int(sum(c * (c - 1) // 2 for c in np.unique(a, axis=0, return_counts=True)[1].tolist()))
    n = len(x)
    total, tx, ty, both = n * (n - 1) // 2, tied(x), tied(y), tied(np.stack([x, y], 1))
    swapped = inversions(y)  # rows of one x are in order of y and count none
    return total - tx - ty + both - 2 * swapped, total - tx, total - ty


def _sums(parts: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """Tables of one figure a key side by side: an aggregate and no join, so null keys stay."""
    names = [next(c for c in p.columns if c not in keys) for p in parts]
    out = None
    for part, own in zip(parts, names, strict=True):
        row = part.select(*keys, *(F.col(c) if c == own else F.lit(None).cast("decimal(38, 0)").alias(c) for c in names))
        out = row if out is None else out.unionByName(row)
    return out.groupBy(*keys).agg(*(F.coalesce(F.sum(c), F.lit(0)).cast("double").alias(c) for c in names))


def kendall(df: DataFrame, a: str, b: str, keys: Sequence[str] = (), order: str | None = None) -> DataFrame:
    """Kendall's tau-b by key (or of all rows) from counts of swapped and of tied pairs; null where either column has one value only. Rows with a null or NaN are left out."""
    keys = list(keys) or ["__all"]
    rows = df.withColumn("__all", F.lit(0)) if keys == ["__all"] else df
    rows = rows.select(*keys, F.col(a).cast("double").alias("__a"), F.col(b).cast("double").alias("__b")).dropna(subset=["__a", "__b"])
    s = _sums([pairs.tied(rows, [], keys, "all"), pairs.tied(rows, ["__a"], keys, "ta"), pairs.tied(rows, ["__b"], keys, "tb"), pairs.tied(rows, ["__a", "__b"], keys, "both"), pairs.swapped(rows, ["__a"], "__b", keys)], keys)
    c = F.col
    tau = F.try_divide(c("all") - c("ta") - c("tb") + c("both") - 2 * c("swapped"), F.sqrt((c("all") - c("ta")) * (c("all") - c("tb"))))
    return s.select(*(k for k in keys if k != "__all"), tau.alias("tau"))


def histogram(df: DataFrame, v: str, bins: int | None = None) -> DataFrame:
    """Equal-width bins on [min, max]; Rice's rule by default; a constant sample has bins of one unit in all."""
    s = df.agg(F.min(v).alias("lo"), F.max(v).alias("hi"), F.count(v).alias("n"))
    k = F.lit(bins) if bins else (F.ceil(2 * F.pow("n", F.lit(1 / 3))) + 1).cast("int")
    hi = F.when(F.col("hi") == F.col("lo"), F.col("lo") + 1).otherwise(F.col("hi"))
    s = s.select("lo", k.alias("k"), ((hi - F.col("lo")) / k).alias("w"))
    rows = df.where(F.col(v).isNotNull()).select(F.col(v).alias("x")).join(F.broadcast(s), F.lit(True))
    rows = rows.select("lo", "w", F.least(F.col("k") - 1, F.floor((F.col("x") - F.col("lo")) / F.col("w")).cast("int")).alias("bin"))
    return rows.groupBy("bin", "lo", "w").agg(F.count("*").alias("freq")).select("bin", (F.col("lo") + F.col("bin") * F.col("w")).alias("lower"), (F.col("lo") + (F.col("bin") + 1) * F.col("w")).alias("upper"), "freq")


def errors(df: DataFrame, obs: str, mod: str, keys: Sequence[str] = ()) -> DataFrame:
    """Goodness of fit of modelled to observed values."""
    o, m = F.col(obs).cast("double"), F.col(mod).cast("double")
    df = df.where(o.isNotNull() & m.isNotNull())
    mean = df.groupBy(*keys).agg(F.avg(o).alias("__mo"))
    rows = df.join(mean, list(keys)) if keys else df.join(F.broadcast(mean), F.lit(True))
    mo = F.col("__mo")
    sse, sst = F.sum((o - m) * (o - m)), F.sum((o - mo) * (o - mo))
    sad, sod = F.sum(F.abs(o - m)), F.sum(F.abs(o - mo))
    r, a, b = F.corr(o, m), F.try_divide(F.stddev_samp(m), F.stddev_samp(o)), F.try_divide(F.avg(m), F.avg(o))
    g = F.try_divide(F.stddev_samp(m) / F.avg(m), F.stddev_samp(o) / F.avg(o))
    return rows.groupBy(*keys).agg(
        F.sqrt(sse / F.count("*")).alias("rmse"), (sse / F.count("*")).alias("mse"), F.avg(F.abs(o - m)).alias("mae"), (100 * F.avg(F.abs(F.try_divide(o - m, o)))).alias("mape"), (100 * F.avg(F.try_divide(F.abs(o - m), (F.abs(o) + F.abs(m)) / 2))).alias("smape"),
        (1 - F.try_divide(sse, sst)).alias("nse"), (1 - F.sqrt((r - 1) * (r - 1) + (a - 1) * (a - 1) + (b - 1) * (b - 1))).alias("kge"), (1 - F.sqrt((r - 1) * (r - 1) + (g - 1) * (g - 1) + (b - 1) * (b - 1))).alias("kge_mod"),
        (100 * F.try_divide(F.sum(m - o), F.sum(o))).alias("pbias"), F.try_divide(F.sqrt(sse / F.count("*")), F.stddev_pop(o)).alias("rsr"), (r * r).alias("r2"), (1 - F.try_divide(sad, F.sum(o))).alias("ve"),
        (1 - F.try_divide(sse, F.sum(F.pow(F.abs(m - mo) + F.abs(o - mo), F.lit(2))))).alias("d"), (1 - F.try_divide(sad, F.sum(F.abs(m - mo) + F.abs(o - mo)))).alias("d1"), F.when(sad <= 2 * sod, 1 - F.try_divide(sad, 2 * sod)).otherwise(F.try_divide(2 * sod, sad) - 1).alias("dr"),
    )


def classification(df: DataFrame, obs: str, mod: str, keys: Sequence[str] = ()) -> DataFrame:
    """Accuracy (percent), precision, recall, F1, specificity and balanced accuracy of 0/1 columns."""
    tp, tn, fp, fn = (F.count_if((F.col(obs) == a) & (F.col(mod) == b)) for a, b in ((1, 1), (0, 0), (0, 1), (1, 0)))
    p, r, s = F.try_divide(tp, tp + fp), F.try_divide(tp, tp + fn), F.try_divide(tn, tn + fp)
    return df.groupBy(*keys).agg((100 * F.try_divide(tp + tn, tp + tn + fp + fn)).alias("accuracy"), p.alias("prec"), r.alias("recall"), F.try_divide(2 * p * r, p + r).alias("f1"), s.alias("specificity"), ((r + s) / 2).alias("balanced"))


def information(df: DataFrame, n: str, k: str, loglik: str) -> DataFrame:
    """AIC, corrected AIC and BIC of each row, with Akaike weights over all rows."""
    a = 2.0 * F.col(k) - 2.0 * F.col(loglik)
    df = df.select("*", a.alias("aic"), (a + F.try_divide(2.0 * F.col(k) * (F.col(k) + 1), F.col(n) - F.col(k) - 1)).alias("aicc"), (F.col(k) * F.ln(n) - 2.0 * F.col(loglik)).alias("bic"))
    best = df.agg(F.min("aic").alias("__b"))
    df = df.join(F.broadcast(best), F.lit(True)).withColumn("__e", F.exp(-0.5 * (F.col("aic") - F.col("__b"))))
    return df.join(F.broadcast(df.agg(F.sum("__e").alias("__t"))), F.lit(True)).withColumn("weight", F.col("__e") / F.col("__t")).drop("__b", "__e", "__t")


#: Plotting-position constants by name.
POSITIONS = {"weibull": 0.0, "median": 0.3175, "blom": 0.375, "cunnane": 0.4, "gringorten": 0.44, "hazen": 0.5}


def plotting_positions(df: DataFrame, v: str, tie: str, keys: Sequence[str] = (), a: float = 0.0) -> DataFrame:
    """(i - a) / (n + 1 - 2a) of the ascending order."""
    n = df.groupBy(*keys).agg(F.count("*").alias("__n"))
    rows = numbered(df, [v, tie], keys)
    joined = rows.join(n, list(keys)) if keys else rows.join(F.broadcast(n), F.lit(True))
    return joined.withColumn("pp", (F.col("__i") - a) / (F.col("__n") + 1 - 2 * a)).drop("__i", "__n")


def t_tests(df: DataFrame, v: str, first: Column, keys: Sequence[str] = (), mu: float = 0.0) -> DataFrame:
    """One-sample, equal-variance and Welch t statistics with degrees of freedom and two-sided p, and the variance ratio F; ``first`` tells the two samples apart."""
    x = F.when(first, F.col(v).cast("double"))
    y = F.when(~first, F.col(v).cast("double"))
    m = df.groupBy(*keys).agg(*(f(z).alias(f"{name}{s}") for s, z in (("1", x), ("2", y)) for name, f in (("n", F.count), ("m", F.avg), ("v", F.var_samp))))
    n1, n2, m1, m2, v1, v2 = (F.col(c) for c in ("n1", "n2", "m1", "m2", "v1", "v2"))
    q = F.try_divide  # a sample that is empty, or of one value, gives nulls
    pooled = q((n1 - 1) * v1 + (n2 - 1) * v2, n1 + n2 - 2)
    a, b = q(v1, n1), q(v2, n2)
    m = m.select(
        *keys, q(m1 - mu, F.sqrt(a)).alias("t_one"), (n1 - 1.0).alias("df_one"), q(m1 - m2, F.sqrt(pooled * (q(F.lit(1.0), n1) + q(F.lit(1.0), n2)))).alias("t_equal"), (n1 + n2 - 2.0).alias("df_equal"),
        q(m1 - m2, F.sqrt(a + b)).alias("t_welch"), q((a + b) * (a + b), q(a * a, n1 - 1) + q(b * b, n2 - 1)).alias("df_welch"), q(v1, v2).alias("f"), (n1 - 1.0).alias("dfn"), (n2 - 1.0).alias("dfd"),
    )
    for c in ("one", "equal", "welch"):
        m = m.withColumn(f"p_{c}", C.t_two_sided(F.col(f"t_{c}"), F.col(f"df_{c}")))
    return m.withColumn("p_f", C.f_two_sided(F.col("f"), F.col("dfn"), F.col("dfd"))).drop("dfn", "dfd")


def jarque_bera(df: DataFrame, v: str, keys: Sequence[str] = ()) -> DataFrame:
    """n / 6 (S^2 + K^2 / 4) of population moments; chi-squared with two degrees of freedom has a closed p."""
    x = F.col(v).cast("double")
    jb = F.count(x) / 6.0 * (F.pow(F.skewness(x), F.lit(2)) + F.pow(F.kurtosis(x), F.lit(2)) / 4)
    return df.groupBy(*keys).agg(jb.alias("jb")).withColumn("p", F.exp(-F.col("jb") / 2))


def mann_whitney(df: DataFrame, v: str, first: Column, keys: Sequence[str] = ()) -> DataFrame:
    """U of the first sample, and a two-sided normal p."""
    rows = average_ranks(df.where(F.col(v).isNotNull()).withColumn("__f", first), v, keys)
    s = rows.groupBy(*keys).agg(F.sum(F.when(F.col("__f"), F.col("__r"))).alias("r1"), F.count_if("__f").alias("n1"), F.count_if(~F.col("__f")).alias("n2"))
    n1, n2 = F.col("n1").cast("double"), F.col("n2").cast("double")
    s = s.withColumn("u", F.col("r1") - n1 * (n1 + 1) / 2)
    z = (F.col("u") - n1 * n2 / 2) / F.sqrt(n1 * n2 * (n1 + n2 + 1) / 12)
    return s.select(*keys, "n1", "n2", "u", z.alias("z"), (2 * (1 - C.normal_cdf(F.abs(z)))).alias("p"))


def mann_kendall(df: DataFrame, v: str, order: str, keys: Sequence[str] = ()) -> DataFrame:
    """S from the counts of swapped and of tied pairs, tie-corrected variance, z and p; by key or of all rows."""
    keys = list(keys) or ["__all"]
    rows = df.withColumn("__all", F.lit(0)) if keys == ["__all"] else df
    rows = rows.select(*keys, F.col(order).alias("__o"), F.col(v).cast("double").alias("__v")).dropna(subset=["__v"])
    t = F.col("t").cast("decimal(19, 0)")
    ties = rows.groupBy(*keys, "__v").agg(F.count("*").alias("t"))
    sums = [ties.groupBy(*keys).agg(F.sum(t).cast("decimal(38, 0)").alias("n")), ties.groupBy(*keys).agg(F.sum((F.col("t").cast("double") * (F.col("t") - 1) * (2 * F.col("t") + 5)).cast("decimal(38, 0)")).cast("decimal(38, 0)").alias("c"))]
    s = _sums([*sums, pairs.tied(rows, [], keys, "all"), pairs.tied(rows, ["__v"], keys, "tied"), pairs.swapped(rows, ["__o"], "__v", keys)], keys)
    n = F.col("n")
    r = s.where("n > 1").select(*(k for k in keys if k != "__all"), (F.col("all") - F.col("tied") - 2 * F.col("swapped")).alias("s"), ((n * (n - 1) * (2 * n + 5) - F.col("c")) / 18).alias("var_s"))
    z = F.try_divide(F.col("s") - F.signum("s"), F.sqrt("var_s"))
    return r.withColumn("z", z).withColumn("p", 2 * (1 - C.normal_cdf(F.abs("z"))))


def linear_trend(df: DataFrame, v: str, x: str, keys: Sequence[str] = ()) -> DataFrame:
    """Least-squares line, r squared, and the t test of its slope."""
    y, t = F.col(v).cast("double"), F.col(x).cast("double")
    m = df.groupBy(*keys).agg(F.regr_slope(y, t).alias("slope"), F.regr_intercept(y, t).alias("intercept"), F.regr_r2(y, t).alias("r2"), F.regr_sxx(y, t).alias("__sxx"), F.regr_syy(y, t).alias("__syy"), F.regr_count(y, t).alias("n"))
    se = F.sqrt(F.try_divide(F.try_divide(F.col("__syy") - F.col("slope") * F.col("slope") * F.col("__sxx"), F.col("n") - 2), F.col("__sxx")))
    return m.withColumn("t", F.try_divide(F.col("slope"), se)).withColumn("p", C.t_two_sided(F.col("t"), F.col("n") - 2.0)).drop("__sxx", "__syy")


def grubbs_beck(df: DataFrame, v: str, keys: Sequence[str] = ()) -> DataFrame:
    """Thresholds of low and high outliers at the 10 % level: exp(mean -+ K sd) of logs, K a polynomial in n**0.25."""
    x = F.ln(F.when(F.col(v) > 0, F.col(v).cast("double")))
    m = df.groupBy(*keys).agg(F.count(x).cast("double").alias("n"), F.avg(x).alias("m"), F.stddev_samp(x).alias("s"))
    q = F.pow("n", F.lit(0.25))
    k = -3.62201 + 6.28446 * q - 2.49835 * q * q + 0.491436 * q * q * q - 0.037911 * q * q * q * q
    return m.select(*keys, "n", F.exp(F.col("m") - k * F.col("s")).alias("low"), F.exp(F.col("m") + k * F.col("s")).alias("high"))


def fit_distances(df: DataFrame, v: str, cdf, keys: Sequence[str] = ()) -> DataFrame:
    """Kolmogorov-Smirnov and Anderson-Darling distances of a sample to a distribution; ``cdf`` maps the value's column to its probability."""
    rows = df.where(F.col(v).isNotNull())
    s = rows.groupBy(*keys).agg(F.count("*").cast("double").alias("__n"))
    rows = numbered(rows, [v], keys)
    rows = rows.join(s, list(keys)) if keys else rows.join(F.broadcast(s), F.lit(True))
    rows = rows.select(*keys, F.col("__n").alias("n"), F.col("__i").alias("i"), cdf(F.col(v)).alias("f"))
    i, n = F.col("i"), F.col("n")
    # with ascending rank i, ln(1 - F(x)) has the weight of rank n + 1 - i
    term = (2 * i - 1) * F.ln(F.greatest("f", F.lit(1e-300))) + (2 * (n + 1 - i) - 1) * F.ln(F.greatest(1 - F.col("f"), F.lit(1e-300)))
    return rows.groupBy(*keys).agg(F.max(F.greatest(F.col("f") - (i - 1) / n, i / n - F.col("f"))).alias("ks"), (-F.first("n") - F.sum(term) / F.first("n")).alias("ad"))


def ks_normal(df: DataFrame, v: str, keys: Sequence[str] = ()) -> DataFrame:
    """Distances to the normal distribution with the sample's moments."""
    s = df.groupBy(*keys).agg(F.avg(v).alias("__m"), F.stddev_samp(v).alias("__s"))
    rows = df.join(s, list(keys)) if keys else df.join(F.broadcast(s), F.lit(True))
    return fit_distances(rows.withColumn("__z", (F.col(v) - F.col("__m")) / F.col("__s")), "__z", C.normal_cdf, keys)


def chi_squared_fit(df: DataFrame, v: str, cdf, bins: int | None = None) -> DataFrame:
    """Sum of (observed - expected)**2 / expected over the bins of a histogram (Rice's rule by default); ``cdf`` maps a column to its probability."""
    h = histogram(df, v, bins)
    n = h.agg(F.sum("freq").cast("double").alias("n"))
    rows = h.join(F.broadcast(n), F.lit(True)).withColumn("e", F.col("n") * (cdf(F.col("upper")) - cdf(F.col("lower"))))
    return rows.agg(F.sum(F.try_divide(F.pow(F.col("freq") - F.col("e"), F.lit(2)), F.col("e"))).alias("chi_squared"), F.count("*").alias("bins"))


def histogram_statistics(bins: DataFrame) -> DataFrame:
    """Mean, median, mode and population deviation from bin midpoints, and the count, of a table of ``histogram``."""
    mid = (F.col("lower") + F.col("upper")) / 2
    rows = bins.select("bin", mid.alias("m"), "freq")
    s = rows.agg(F.sum("freq").alias("n"), (F.sum(F.col("m") * F.col("freq")) / F.sum("freq")).alias("mean"), F.max_by("m", F.struct("freq", -F.col("bin"))).alias("mode"))
    w = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)  # one row a bin
    half = rows.withColumn("c", F.sum("freq").over(w)).join(F.broadcast(s), F.lit(True)).where(F.col("c") >= F.floor(F.col("n") / 2))
    median = half.agg(F.min_by("m", "bin").alias("median"))
    spread = rows.join(F.broadcast(s), F.lit(True)).agg(F.sqrt(F.sum(F.col("freq") * F.pow(F.col("m") - F.col("mean"), F.lit(2))) / F.sum("freq")).alias("sd"))
    return s.join(F.broadcast(median), F.lit(True)).join(F.broadcast(spread), F.lit(True))


def bin_index(x: Column, lower: Column, width: Column, bins: int) -> Column:
    """Left-closed bin of a value; values outside belong to the end bins."""
    return F.least(F.lit(bins - 1), F.greatest(F.lit(0), F.floor((x - lower) / width).cast("int")))


def entropy(df: DataFrame, p: str | Column, keys: Sequence[str] = ()) -> DataFrame:
    """-sum of p ln p of a column of densities or probabilities."""
    c = F.col(p) if isinstance(p, str) else p
    return df.groupBy(*keys).agg((-F.sum(F.when(c > 0, c * F.ln(c)).otherwise(0.0))).alias("entropy"))


def masked(df: DataFrame, v: str, mask: Column, keys: Sequence[str] = ()) -> DataFrame:
    """Count, sum, mean, product, min and max of the values where a mask holds, and of the others."""
    parts = (("in", F.when(mask, F.col(v))), ("out", F.when(~mask, F.col(v))))
    return df.groupBy(*keys).agg(*(f(c).alias(f"{name}_{side}") for side, c in parts for name, f in (("n", F.count), ("total", F.sum), ("mean", F.avg), ("product", F.product), ("lo", F.min), ("hi", F.max))))


def extremes(df: DataFrame, v: str, order: str, keys: Sequence[str] = ()) -> DataFrame:
    """Smallest and largest value and the first places they stand at."""
    return df.groupBy(*keys).agg(F.min(v).alias("lo"), F.max(v).alias("hi"), F.min_by(order, F.struct(v, order)).alias("arg_lo"), F.min_by(order, F.struct(-F.col(v), order)).alias("arg_hi"))


def rmse_weights(df: DataFrame, rmse: str, out: str = "weight") -> DataFrame:
    """Weights of models by the inverse of their mean squared error."""
    inverse = 1 / (F.col(rmse) * F.col(rmse))
    return df.join(F.broadcast(df.agg(F.sum(inverse).alias("__t"))), F.lit(True)).withColumn(out, inverse / F.col("__t")).drop("__t")


def adjusted_errors(df: DataFrame, obs: str, mod: str, parameters: int, keys: Sequence[str] = ()) -> DataFrame:
    """Root of the squared error over n less the number of parameters, and the efficiency of logarithms (a hundredth of the mean is added to both sides)."""
    o, m = F.col(obs).cast("double"), F.col(mod).cast("double")
    df = df.where(o.isNotNull() & m.isNotNull())
    mean = df.groupBy(*keys).agg((F.avg(o) / 100).alias("__e"))
    rows = df.join(mean, list(keys)) if keys else df.join(F.broadcast(mean), F.lit(True))
    lo, lm = F.ln(o + F.col("__e")), F.ln(m + F.col("__e"))
    return rows.groupBy(*keys).agg(F.sqrt(F.try_divide(F.sum((o - m) * (o - m)), F.count("*") - parameters)).alias("rmse_adjusted"), (1 - F.try_divide(F.sum((lo - lm) * (lo - lm)), F.var_pop(lo) * F.count("*"))).alias("log_nse"))


def nested_f(sse_small: Column, sse_full: Column, df_small: Column, df_full: Column) -> tuple[Column, Column]:
    """F statistic of a model against one with more terms, and its upper tail; degrees of freedom are those of the errors."""
    f = ((sse_small - sse_full) / (df_small - df_full)) / (sse_full / df_full)
    return f, C.f_upper(f, df_small - df_full, df_full)


def summary(df: DataFrame, v: str, keys: Sequence[str] = (), at: Sequence[float] = (0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99)) -> DataFrame:
    """Long rows (statistic, value): length, missing, extremes, moments and percentiles of one pass."""
    x = F.when(~F.isnan(F.col(v).cast("double")), F.col(v).cast("double"))
    n = F.count(x)
    names = {"length": F.count("*").cast("double"), "missing": (F.count("*") - n).cast("double"), "minimum": F.min(x), "maximum": F.max(x), "mean": F.avg(x), "sd": F.stddev_samp(x), "skew": F.when(n > 2, F.skewness(x) * F.sqrt(n * (n - 1)) / (n - 2)), "kurtosis": F.when(n > 3, ((n + 1) * F.kurtosis(x) + 6) * (n - 1) / ((n - 2) * (n - 3)))}
    cuts = F.percentile(x, F.array(*(F.lit(float(a)) for a in at)))
    wide = df.groupBy(*keys).agg(*(c.alias(f"__{k}") for k, c in names.items()), cuts.alias("__p"))
    pairs = [F.struct(F.lit(k).alias("statistic"), F.col(f"__{k}").alias("value")) for k in names]
    pairs += [F.struct(F.lit(f"p{100 * a:g}").alias("statistic"), F.element_at("__p", i + 1).alias("value")) for i, a in enumerate(at)]
    return wide.select(*keys, F.explode(F.array(*pairs)).alias("s")).select(*keys, "s.statistic", "s.value")


def low_outliers(df: DataFrame, v: str, keys: Sequence[str]) -> DataFrame:
    """Number of low outliers of each key's sample by the multiple Grubbs-Beck test; a key's sample is in one task."""
    from ..functions import outliers

    schema = ", ".join(f"`{k}` {t}" for k, t in df.select(*keys).dtypes) + ", n long, n_low long"

    def one(key, pdf):
        x = pdf[v].to_numpy(float)
        x = x[np.isfinite(x)]
        return pd.DataFrame([[*key, len(x), outliers.multiple_grubbs_beck(x)]], columns=[*keys, "n", "n_low"])

    return df.select(*keys, F.col(v).cast("double").alias(v)).groupBy(*keys).applyInPandas(one, schema)


def unimodality(df: DataFrame, v: str, keys: Sequence[str], seed: int = 12345) -> DataFrame:
    """Likelihood ratio of one against two normal components, with its chi-squared (3) p; a key's sample is in one task."""
    from ..functions import special as S
    from .learning import gaussian_mixture

    schema = ", ".join(f"`{k}` {t}" for k, t in df.select(*keys).dtypes) + ", ratio double, p double"

    def one(key, pdf):
        x = pdf[v].to_numpy(float)
        x = x[np.isfinite(x)]
        if len(x) < 10:
            return pd.DataFrame([[*key, None, None]], columns=[*keys, "ratio", "p"])
        ratio = 2 * (gaussian_mixture(x, 2, seed)[3] - gaussian_mixture(x, 1, seed)[3])
        return pd.DataFrame([[*key, ratio, float(S.gamma_q(1.5, max(ratio, 0.0) / 2))]], columns=[*keys, "ratio", "p"])

    return df.select(*keys, F.col(v).cast("double").alias(v)).groupBy(*keys).applyInPandas(one, schema)
