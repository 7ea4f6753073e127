"""Tests and transforms of ordered samples: serial tests, partial autocorrelation, spectra, seasonal decomposition."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from . import series


def ljung_box(df: DataFrame, lags: int, keys: Sequence[str] = (), v: str = "v", ts: str = "ts") -> DataFrame:
    """n (n + 2) times the sum of squared autocorrelations over n - lag, with its chi-squared p."""
    n = df.groupBy(*keys).agg(F.count(v).cast("double").alias("n"))
    acf = series.autocovariance(df, lags, keys, v, ts).where("lag > 0")
    rows = acf.join(n, list(keys)) if keys else acf.join(F.broadcast(n), F.lit(True))
    q = rows.groupBy(*keys).agg((F.first("n") * (F.first("n") + 2) * F.sum(F.col("acf") * F.col("acf") / (F.col("n") - F.col("lag")))).alias("q"))
    return q.withColumn("p", C.chi_squared_upper(F.col("q"), F.lit(float(lags))))


def wald_wolfowitz(df: DataFrame, keys: Sequence[str] = (), v: str = "v", ts: str = "ts") -> DataFrame:
    """Independence by the circular serial product, normal p."""
    w = Window.partitionBy(*keys).orderBy(ts)
    first = df.groupBy(*keys).agg(F.min_by(v, ts).alias("__f"), F.avg(v).alias("__m"))
    rows = df.join(first, list(keys)) if keys else df.join(F.broadcast(first), F.lit(True))
    x, f = F.col(v) - F.col("__m"), F.col("__f") - F.col("__m")  # centred: the statistic is the same, and sums stay small
    rows = rows.select(*keys, x.alias("x"), F.coalesce(F.lead(x).over(w), f).alias("y"))
    s = rows.groupBy(*keys).agg(F.count("*").cast("double").alias("n"), F.sum(F.col("x") * F.col("y")).alias("r"), *(F.sum(F.pow("x", F.lit(k))).alias(f"s{k}") for k in (1, 2, 3, 4)))
    n, s1, s2, s3, s4 = (F.col(c) for c in ("n", "s1", "s2", "s3", "s4"))
    mean = (s1 * s1 - s2) / (n - 1)
    var = (s2 * s2 - s4) / (n - 1) + (F.pow(s1, F.lit(4)) - 4 * s1 * s1 * s2 + 4 * s1 * s3 + s2 * s2 - 2 * s4) / ((n - 1) * (n - 2)) - mean * mean
    z = (F.col("r") - mean) / F.sqrt(var)
    return s.select(*keys, z.alias("z"), (2 * (1 - C.normal_cdf(F.abs(z)))).alias("p"))


def partial_autocorrelation(acf: Sequence[float]) -> list[float]:
    """From autocorrelations of lags 0, 1, ... by the Durbin-Levinson recursion."""
    out, phi = [1.0], np.empty(0)
    for k in range(1, len(acf)):
        top = acf[k] - sum(phi[j] * acf[k - 1 - j] for j in range(k - 1))
        low = 1 - sum(phi[j] * acf[j + 1] for j in range(k - 1))
        last = top / low
        phi = np.append(phi - last * phi[::-1], last)
        out.append(float(last))
    return out


def correlation_limits(n: int, level: float = 0.95) -> tuple[float, float]:
    """Limits of an autocorrelation of independent values."""
    from ..functions import special as S

    z = float(S.normal_quantile((1 + level) / 2)) / n**0.5
    return -z, z


def fft_correlation(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Circular cross-correlation."""
    n = 1 << (max(len(x), len(y)) - 1).bit_length()
    return np.fft.irfft(np.fft.rfft(x, n) * np.conj(np.fft.rfft(y, n)), n)


def decompose(df: DataFrame, period: int, keys: Sequence[str], v: str = "v", ts: str = "ts", harmonics: int = 6) -> DataFrame:
    """Trend (trailing moving average), seasonal part (harmonics of the period), and the rest; a series must fit one task."""
    schema = ", ".join(f"`{k}` {t}" for k, t in df.select(*keys, ts, v).dtypes) + ", trend double, seasonal double, rest double"

    def one(pdf):
        pdf = pdf.sort_values(ts)
        x = pdf[v].astype(float)
        trend = x.rolling(period).mean()
        loose = (x - trend).fillna(0.0).to_numpy()
        t = np.arange(len(loose))
        seasonal = np.zeros(len(loose))
        for h in range(1, min(harmonics, period // 2) + 1):
            wave = np.exp(-2j * np.pi * h * t / period)
            c = (loose * wave).sum() * (1 if 2 * h == period else 2) / max(len(loose), 1)
            seasonal += (c * np.conj(wave)).real
        return pdf.assign(trend=trend, seasonal=seasonal, rest=x - trend - seasonal)

    return df.select(*keys, ts, v).groupBy(*keys).applyInPandas(one, schema)


def summary_tests(df: DataFrame, keys: Sequence[str] = (), v: str = "v", ts: str = "ts", lags: int = 10) -> DataFrame:
    """p-values of normality, serial and trend tests side by side."""
    from . import stats

    number = df.withColumn("__t", F.row_number().over(Window.partitionBy(*keys).orderBy(ts)).cast("double"))
    parts = [stats.jarque_bera(df, v, keys).select(*keys, F.col("p").alias("jarque_bera")), ljung_box(df, lags, keys, v, ts).select(*keys, F.col("p").alias("ljung_box")), wald_wolfowitz(df, keys, v, ts).select(*keys, F.col("p").alias("wald_wolfowitz")), stats.linear_trend(number, v, "__t", keys).select(*keys, F.col("p").alias("linear_trend"))]
    out = parts[0]
    for p in parts[1:]:
        out = out.join(p, list(keys)) if keys else out.join(F.broadcast(p), F.lit(True))
    return out


def to_frame(spark, values: Sequence[float]) -> DataFrame:
    """One series of numbered ordinates."""
    return spark.createDataFrame(pd.DataFrame({"ts": np.arange(len(values)), "v": np.asarray(values, float)}))
