"""Univariate distributions: density, probability and quantile kernels, and fitting by group.

A distribution is a name and a parameter list; ``apply`` evaluates a column of
values against one distribution or against distribution columns in Arrow
batches, ``fit`` estimates parameters of each group. Closed families with
L-moments are estimated from one aggregate (``l_moments``), so a group of any
size never sits in one task; maximum likelihood takes groups that fit one.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import columns as C
from . import special as S

EULER = 0.5772156649015329


@dataclass(frozen=True)
class Family:
    names: tuple[str, ...]
    cdf: Callable
    quantile: Callable | None
    pdf: Callable | None = None
    discrete: bool = False


def _numeric_pdf(cdf: Callable) -> Callable:
    def f(x, *p):
        h = 1e-5 * np.maximum(np.abs(x), 1e-3)
        return (cdf(x + h, *p) - cdf(x - h, *p)) / (2 * h)

    return f


def _search(cdf: Callable, lo: float, hi: float) -> Callable:
    def q(p, *a):
        p = np.asarray(p, float)
        return S.bisect(lambda x: cdf(x, *a) - p, np.full(p.shape, lo), np.full(p.shape, hi))

    return q


def _kappa_y(x, loc, scale, k):
    """-ln(1 - k (x - loc) / scale) / k, its limit for k = 0, and infinities outside the support."""
    z = (x - loc) / scale
    if abs(k) < 1e-10:
        return z
    inner = 1 - k * z
    with np.errstate(divide="ignore", invalid="ignore"):
        y = -np.log(np.maximum(inner, 0)) / k
    return np.where(inner > 0, y, np.inf if k > 0 else -np.inf)


def _kappa_x(y, loc, scale, k):
    return loc + scale * (y if abs(k) < 1e-10 else -np.expm1(-k * y) / k)


def _gev_cdf(x, a, b, k):
    return np.exp(-np.exp(-_kappa_y(x, a, b, k)))


def _glo_cdf(x, a, b, k):
    return 1 / (1 + np.exp(-np.clip(_kappa_y(x, a, b, k), -700, 700)))


def _gno_cdf(x, a, b, k):
    return S.normal_cdf(_kappa_y(x, a, b, k))


def _gpa_cdf(x, a, b, k):
    return np.where(x <= a, 0.0, 1 - np.exp(-np.maximum(_kappa_y(x, a, b, k), 0)))


def _kappa4_cdf(x, a, b, k, h):
    e = np.exp(-_kappa_y(x, a, b, k))
    return np.exp(-e) if abs(h) < 1e-10 else np.maximum(1 - h * e, 0) ** (1 / h)


def _kappa4_q(p, a, b, k, h):
    y = -np.log(-np.log(p)) if abs(h) < 1e-10 else -np.log((1 - p**h) / h)
    return _kappa_x(y, a, b, k)


def _pe3_cdf(x, mu, sd, skew):
    if abs(skew) < 1e-8:
        return S.normal_cdf((x - mu) / sd)
    a, b = 4 / skew**2, sd * skew / 2
    y = (x - mu + 2 * sd / skew) / b
    p = S.gamma_p(np.full(np.shape(y), a), np.maximum(y, 0))
    return p if skew > 0 else 1 - p


def _pe3_q(p, mu, sd, skew):
    if abs(skew) < 1e-8:
        return mu + sd * S.normal_quantile(p)
    a, b = 4 / skew**2, sd * skew / 2
    return mu - 2 * sd / skew + b * S.gamma_p_inverse(np.full(np.shape(p), a), p if skew > 0 else 1 - p)


def _pert(a, c, b):
    return 1 + 4 * (c - a) / (b - a), 1 + 4 * (b - c) / (b - a)


def _tri_cdf(x, a, c, b):
    low = np.clip(x - a, 0, None) ** 2 / ((b - a) * max(c - a, 1e-300))
    high = 1 - np.clip(b - x, 0, None) ** 2 / ((b - a) * max(b - c, 1e-300))
    return np.where(x <= a, 0.0, np.where(x >= b, 1.0, np.where(x <= c, low, high)))


def _tri_q(p, a, c, b):
    f = (c - a) / (b - a)
    return np.where(p < f, a + np.sqrt(p * (b - a) * (c - a)), b - np.sqrt((1 - p) * (b - a) * (b - c)))


def _von_mises_cdf(x, mu, k):
    grid = np.linspace(-np.pi, np.pi, 4001)
    pdf = np.exp(k * np.cos(grid)) / (2 * np.pi * S.bessel_i(0, np.array(k)))
    total = np.concatenate([[0], np.cumsum((pdf[1:] + pdf[:-1]) / 2 * np.diff(grid))])
    return np.interp(x - mu, grid, total / total[-1])


_CHI: dict[float, np.ndarray] = {}


def _chi_points(v: float) -> np.ndarray:
    if v not in _CHI:
        u = (np.arange(400) + 0.5) / 400
        _CHI[v] = np.sqrt(S.gamma_p_inverse(np.full(400, v / 2), u) * 2 / v)
    return _CHI[v]


def _noncentral_t_cdf(t, v, d):
    s = _chi_points(float(v))
    return S.normal_cdf(np.asarray(t, float)[..., None] * s - d).mean(-1)


def _steps_q(cdf: Callable) -> Callable:
    def q(p, *a):
        return np.ceil(S.bisect(lambda x: cdf(np.floor(x), *a) - p, np.full(np.shape(p), -1.0), np.full(np.shape(p), 1e7)) - 1e-9)

    return q


def _exp_pdf_gamma(x, theta, kappa):
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(x > 0, np.exp((kappa - 1) * np.log(np.maximum(x, 1e-300)) - x / theta - S.log_gamma(kappa) - kappa * math.log(theta)), 0.0)


_binomial_cdf = lambda x, p, n: np.where(x < 0, 0.0, np.where(np.floor(x) >= n, 1.0, S.beta_i(np.maximum(n - np.floor(x), 1e-9), np.maximum(np.floor(x) + 1, 1e-9), 1 - p)))
_poisson_cdf = lambda x, lam: np.where(x < 0, 0.0, S.gamma_q(np.maximum(np.floor(x) + 1, 1), np.full(np.shape(x), lam)))

#: Parameter names, probability, quantile and density of each family.
FAMILIES: dict[str, Family] = {
    "normal": Family(("mu", "sigma"), lambda x, m, s: S.normal_cdf((x - m) / s), lambda p, m, s: m + s * S.normal_quantile(p), lambda x, m, s: S.normal_pdf((x - m) / s) / s),
    "ln_normal": Family(("mu", "sigma"), lambda x, m, s: np.where(x > 0, S.normal_cdf((np.log(np.maximum(x, 1e-300)) - m) / s), 0.0), lambda p, m, s: np.exp(m + s * S.normal_quantile(p)), lambda x, m, s: np.where(x > 0, S.normal_pdf((np.log(np.maximum(x, 1e-300)) - m) / s) / (s * np.maximum(x, 1e-300)), 0.0)),
    "log_normal": Family(("mu", "sigma"), lambda x, m, s: np.where(x > 0, S.normal_cdf((np.log10(np.maximum(x, 1e-300)) - m) / s), 0.0), lambda p, m, s: 10 ** (m + s * S.normal_quantile(p))),
    "exponential": Family(("xi", "alpha"), lambda x, a, b: np.where(x <= a, 0.0, -np.expm1(-np.maximum(x - a, 0) / b)), lambda p, a, b: a - b * np.log1p(-p), lambda x, a, b: np.where(x < a, 0.0, np.exp(-np.maximum(x - a, 0) / b) / b)),
    "gamma": Family(("theta", "kappa"), lambda x, t, k: S.gamma_p(np.full(np.shape(x), k), np.maximum(x, 0) / t), lambda p, t, k: t * S.gamma_p_inverse(np.full(np.shape(p), k), p), _exp_pdf_gamma),
    "inverse_gamma": Family(("beta", "alpha"), lambda x, b, a: np.where(x > 0, S.gamma_q(np.full(np.shape(x), a), b / np.maximum(x, 1e-300)), 0.0), lambda p, b, a: b / S.gamma_p_inverse(np.full(np.shape(p), a), 1 - p)),
    "chi_squared": Family(("nu",), lambda x, v: S.gamma_p(np.full(np.shape(x), v / 2), np.maximum(x, 0) / 2), lambda p, v: 2 * S.gamma_p_inverse(np.full(np.shape(p), v / 2), p), lambda x, v: _exp_pdf_gamma(x, 2.0, v / 2)),
    "inverse_chi_squared": Family(("nu", "sigma"), lambda x, v, s: np.where(x > 0, S.gamma_q(np.full(np.shape(x), v / 2), v * s / 2 / np.maximum(x, 1e-300)), 0.0), lambda p, v, s: v * s / 2 / S.gamma_p_inverse(np.full(np.shape(p), v / 2), 1 - p)),
    "gev": Family(("xi", "alpha", "kappa"), _gev_cdf, lambda p, a, b, k: _kappa_x(-np.log(-np.log(p)), a, b, k)),
    "gumbel": Family(("xi", "alpha"), lambda x, a, b: _gev_cdf(x, a, b, 0.0), lambda p, a, b: a - b * np.log(-np.log(p)), lambda x, a, b: np.exp(-(x - a) / b - np.exp(-(x - a) / b)) / b),
    "generalized_logistic": Family(("xi", "alpha", "kappa"), _glo_cdf, lambda p, a, b, k: _kappa_x(np.log(p / (1 - p)), a, b, k)),
    "logistic": Family(("xi", "alpha"), lambda x, a, b: _glo_cdf(x, a, b, 0.0), lambda p, a, b: a + b * np.log(p / (1 - p))),
    "generalized_normal": Family(("xi", "alpha", "kappa"), _gno_cdf, lambda p, a, b, k: _kappa_x(S.normal_quantile(p), a, b, k)),
    "generalized_pareto": Family(("xi", "alpha", "kappa"), _gpa_cdf, lambda p, a, b, k: _kappa_x(-np.log1p(-p), a, b, k)),
    "kappa4": Family(("xi", "alpha", "kappa", "h"), _kappa4_cdf, _kappa4_q),
    "pearson3": Family(("mu", "sigma", "gamma"), _pe3_cdf, _pe3_q),
    "log_pearson3": Family(("mu", "sigma", "gamma"), lambda x, m, s, g: np.where(x > 0, _pe3_cdf(np.log10(np.maximum(x, 1e-300)), m, s, g), 0.0), lambda p, m, s, g: 10 ** _pe3_q(p, m, s, g)),
    "weibull": Family(("lambda", "kappa"), lambda x, b, k: -np.expm1(-((np.maximum(x, 0) / b) ** k)), lambda p, b, k: b * (-np.log1p(-p)) ** (1 / k), lambda x, b, k: np.where(x > 0, k / b * (np.maximum(x, 1e-300) / b) ** (k - 1) * np.exp(-((np.maximum(x, 0) / b) ** k)), 0.0)),
    "pareto": Family(("xm", "alpha"), lambda x, m, a: np.where(x > m, 1 - (m / np.maximum(x, m)) ** a, 0.0), lambda p, m, a: m * (1 - p) ** (-1 / a)),
    "rayleigh": Family(("sigma",), lambda x, s: -np.expm1(-np.maximum(x, 0) ** 2 / (2 * s * s)), lambda p, s: s * np.sqrt(-2 * np.log1p(-p))),
    "cauchy": Family(("x0", "gamma"), lambda x, a, b: np.arctan((x - a) / b) / np.pi + 0.5, lambda p, a, b: a + b * np.tan(np.pi * (p - 0.5)), lambda x, a, b: 1 / (np.pi * b * (1 + ((x - a) / b) ** 2))),
    "student_t": Family(("mu", "sigma", "nu"), lambda x, m, s, v: S.t_cdf((x - m) / s, np.full(np.shape(x), v)), lambda p, m, s, v: m + s * S.t_quantile(p, v)),
    "noncentral_t": Family(("nu", "delta"), _noncentral_t_cdf, _search(_noncentral_t_cdf, -1e3, 1e3)),
    "beta": Family(("alpha", "beta"), lambda x, a, b: S.beta_i(a, b, np.clip(x, 0, 1)).reshape(np.shape(x)), lambda p, a, b: S.beta_i_inverse(a, b, p)),
    "generalized_beta": Family(("alpha", "beta", "min", "max"), lambda x, a, b, lo, hi: S.beta_i(a, b, np.clip((x - lo) / (hi - lo), 0, 1)).reshape(np.shape(x)), lambda p, a, b, lo, hi: lo + (hi - lo) * S.beta_i_inverse(a, b, p)),
    "pert": Family(("min", "mode", "max"), lambda x, a, c, b: S.beta_i(*_pert(a, c, b), np.clip((x - a) / (b - a), 0, 1)).reshape(np.shape(x)), lambda p, a, c, b: a + (b - a) * S.beta_i_inverse(*_pert(a, c, b), p)),
    "triangular": Family(("min", "mode", "max"), _tri_cdf, _tri_q),
    "uniform": Family(("min", "max"), lambda x, a, b: np.clip((x - a) / (b - a), 0, 1), lambda p, a, b: a + p * (b - a), lambda x, a, b: np.where((x >= a) & (x <= b), 1 / (b - a), 0.0)),
    "truncated_normal": Family(("mu", "sigma", "min", "max"), lambda x, m, s, a, b: np.clip((S.normal_cdf((np.clip(x, a, b) - m) / s) - S.normal_cdf((a - m) / s)) / (S.normal_cdf((b - m) / s) - S.normal_cdf((a - m) / s)), 0, 1), lambda p, m, s, a, b: m + s * S.normal_quantile(S.normal_cdf((a - m) / s) + p * (S.normal_cdf((b - m) / s) - S.normal_cdf((a - m) / s)))),
    "von_mises": Family(("mu", "kappa"), _von_mises_cdf, _search(_von_mises_cdf, -7.0, 7.0), lambda x, m, k: np.exp(k * np.cos(x - m)) / (2 * np.pi * S.bessel_i(0, np.array(k)))),
    "deterministic": Family(("value",), lambda x, v: np.where(x >= v, 1.0, 0.0), lambda p, v: np.full(np.shape(p), float(v)), lambda x, v: np.where(x == v, 1.0, 0.0)),
    "bernoulli": Family(("p",), lambda x, p: np.where(x < 0, 0.0, np.where(x < 1, 1 - p, 1.0)), lambda u, p: np.where(u > 1 - p, 1.0, 0.0), lambda x, p: np.where(x == 1, p, np.where(x == 0, 1 - p, 0.0)), True),
    "binomial": Family(("p", "n"), _binomial_cdf, _steps_q(_binomial_cdf), lambda x, p, n: np.exp(S.log_factorial(n) - S.log_factorial(x) - S.log_factorial(n - x) + x * np.log(p) + (n - x) * np.log1p(-p)), True),
    "geometric": Family(("p",), lambda x, p: np.where(x < 0, 0.0, 1 - (1 - p) ** (np.floor(x) + 1)), lambda u, p: np.maximum(np.ceil(np.log1p(-u) / np.log1p(-p)) - 1, 0), lambda x, p: p * (1 - p) ** x, True),
    "poisson": Family(("lambda",), _poisson_cdf, _steps_q(_poisson_cdf), lambda x, lam: np.exp(x * np.log(lam) - lam - S.log_factorial(x)), True),
    "uniform_discrete": Family(("min", "max"), lambda x, a, b: np.clip((np.floor(x) - a + 1) / (b - a + 1), 0, 1), lambda p, a, b: np.maximum(a + np.ceil(p * (b - a + 1)) - 1, a), lambda x, a, b: np.where((x >= a) & (x <= b), 1 / (b - a + 1), 0.0), True),
}


def evaluate(name: str, what: str, x, params: Sequence[float]) -> np.ndarray:
    """pdf, log_pdf, cdf, log_cdf, ccdf, log_ccdf, hazard or quantile of one distribution."""
    f = FAMILIES[name]
    x = np.asarray(x, float)
    p = [float(v) for v in params]
    safe_log = lambda y: np.where(y > 0, np.log(np.maximum(y, 1e-300)), -np.inf)
    with np.errstate(all="ignore"):
        if what == "cdf":
            return f.cdf(x, *p)
        if what == "log_cdf":
            return safe_log(f.cdf(x, *p))
        if what == "quantile":
            return f.quantile(x, *p)
        if what in ("ccdf", "log_ccdf"):
            survive = 1 - f.cdf(x, *p)
            return survive if what == "ccdf" else safe_log(survive)
        y = (f.pdf or _numeric_pdf(f.cdf))(x, *p)
        return y if what == "pdf" else safe_log(y) if what == "log_pdf" else y / (1 - f.cdf(x, *p))


#: Closed families as expressions: density, probability and quantile of a column, from parameter columns.
EXPRESSIONS: dict[str, dict[str, Callable]] = {
    "normal": {"pdf": lambda x, m, s: C.normal_pdf((x - m) / s) / s, "cdf": lambda x, m, s: C.normal_cdf((x - m) / s), "quantile": lambda p, m, s: m + s * C.normal_quantile(p)},
    "exponential": {"pdf": lambda x, a, b: F.when(x >= a, F.exp(-(x - a) / b) / b).otherwise(0.0), "cdf": lambda x, a, b: F.when(x > a, -F.expm1(-(x - a) / b)).otherwise(0.0), "quantile": lambda p, a, b: a - b * F.log1p(-p)},
    "gumbel": {"pdf": lambda x, a, b: F.exp(-(x - a) / b - F.exp(-(x - a) / b)) / b, "cdf": lambda x, a, b: F.exp(-F.exp(-(x - a) / b)), "quantile": lambda p, a, b: a - b * F.ln(-F.ln(p))},
    "logistic": {"pdf": lambda x, a, b: F.exp(-F.abs(x - a) / b) / (b * F.pow(1 + F.exp(-F.abs(x - a) / b), F.lit(2))), "cdf": lambda x, a, b: 1 / (1 + F.exp(-(x - a) / b)), "quantile": lambda p, a, b: a + b * F.ln(p / (1 - p))},
    "weibull": {"pdf": lambda x, b, k: F.when(x > 0, k / b * F.pow(x / b, k - 1) * F.exp(-F.pow(x / b, k))).otherwise(0.0), "cdf": lambda x, b, k: F.when(x > 0, -F.expm1(-F.pow(x / b, k))).otherwise(0.0), "quantile": lambda p, b, k: b * F.pow(-F.log1p(-p), 1 / k)},
    "uniform": {"pdf": lambda x, a, b: F.when((x >= a) & (x <= b), 1 / (b - a)).otherwise(0.0), "cdf": lambda x, a, b: F.least(F.greatest((x - a) / (b - a), F.lit(0.0)), F.lit(1.0)), "quantile": lambda p, a, b: a + p * (b - a)},
    "pareto": {"pdf": lambda x, m, a: F.when(x >= m, a * F.pow(m, a) / F.pow(x, a + 1)).otherwise(0.0), "cdf": lambda x, m, a: F.when(x > m, 1 - F.pow(m / x, a)).otherwise(0.0), "quantile": lambda p, m, a: m * F.pow(1 - p, -1 / a)},
    "cauchy": {"pdf": lambda x, a, b: 1 / (math.pi * b * (1 + F.pow((x - a) / b, F.lit(2)))), "cdf": lambda x, a, b: F.atan((x - a) / b) / math.pi + 0.5, "quantile": lambda p, a, b: a + b * F.tan(math.pi * (p - 0.5))},
    "rayleigh": {"pdf": lambda x, s: F.when(x > 0, x / (s * s) * F.exp(-x * x / (2 * s * s))).otherwise(0.0), "cdf": lambda x, s: F.when(x > 0, -F.expm1(-x * x / (2 * s * s))).otherwise(0.0), "quantile": lambda p, s: s * F.sqrt(-2 * F.log1p(-p))},
}


def express(what: str, x: Column, name: str, params: Column | Sequence[float]) -> Column | None:
    """``what`` at x as built-in expressions, for the closed families; none for others."""
    forms = EXPRESSIONS.get(name)
    if not forms:
        return None
    n = len(FAMILIES[name].names)
    p = [F.element_at(params, i + 1) for i in range(n)] if isinstance(params, Column) else [F.lit(float(v)) for v in params]
    if what in forms:
        return forms[what](x, *p)
    survive = 1 - forms["cdf"](x, *p)
    log = lambda y: F.when(y > 0, F.ln(y)).otherwise(F.lit(-math.inf))
    return {"log_pdf": lambda: log(forms["pdf"](x, *p)), "log_cdf": lambda: log(forms["cdf"](x, *p)), "ccdf": lambda: survive, "log_ccdf": lambda: log(survive), "hazard": lambda: forms["pdf"](x, *p) / survive}[what]()


def apply(what: str, x: Column, name: str | Column, params: Sequence[float] | Column) -> Column:
    """A column of ``what`` at x: one distribution for all rows, or a name and an array of parameters for each. Closed families given by name stay in built-in expressions."""
    if isinstance(name, str):
        built_in = express(what, x, name, params)
        if built_in is not None:
            return built_in
        if isinstance(params, Column):
            name = F.lit(name)
    if isinstance(name, str):
        fixed = [float(v) for v in params]

        @F.pandas_udf("double")
        def one(x: pd.Series) -> pd.Series:
            return pd.Series(evaluate(name, what, x.to_numpy(float), fixed), dtype=float)

        return one(x)

    @F.pandas_udf("double")
    def each(x: pd.Series, n: pd.Series, p: pd.Series) -> pd.Series:
        out = np.full(len(x), np.nan)
        groups: dict = {}
        for i, key in enumerate(zip(n, map(tuple, p), strict=True)):
            groups.setdefault(key, []).append(i)
        for (family, values), at in groups.items():
            out[at] = evaluate(family, what, x.to_numpy(float)[at], values)
        return pd.Series(out)

    return each(x, name, params)


def from_l_moments(name: str, l1: Column, l2: Column, t3: Column, t4: Column | None = None) -> Column:
    """Parameters (array) of a family with closed L-moment estimators; stays in built-in expressions where gamma is not needed."""
    if name == "normal":
        return F.array(l1, l2 * math.sqrt(math.pi))
    if name == "exponential":
        return F.array(l1 - 2 * l2, 2 * l2)
    if name == "gumbel":
        return F.array(l1 - l2 / math.log(2) * EULER, l2 / math.log(2))
    if name == "logistic":
        return F.array(l1, l2)
    if name == "generalized_logistic":
        k = -t3
        a = F.when(F.abs(k) < 1e-8, l2).otherwise(l2 * F.sin(k * math.pi) / (k * math.pi))
        return F.array(l1 - F.when(F.abs(k) < 1e-8, 0.0).otherwise(a * (1 / k - math.pi / F.sin(k * math.pi))), a, k)
    if name == "generalized_pareto":
        k = (1 - 3 * t3) / (1 + t3)
        return F.array(l1 - (2 + k) * l2, (1 + k) * (2 + k) * l2, k)

    @F.pandas_udf("array<double>")
    def kernel(a: pd.Series, b: pd.Series, c: pd.Series) -> pd.Series:
        return pd.Series([l_moment_parameters(name, *v) for v in zip(a, b, c, strict=True)])

    return kernel(l1, l2, t3)


def l_moment_parameters(name: str, l1: float, l2: float, t3: float) -> list[float]:
    """The families whose estimators need gamma functions."""
    if name == "gev":
        c = 2 / (3 + t3) - math.log(2) / math.log(3)
        k = 7.8590 * c + 2.9554 * c * c  # Hosking, Wallis and Wood (1985), good for |t3| <= 0.5
        if abs(t3) > 0.5:
            k = float(S.bisect(lambda k: t3 - (2 * (1 - 3.0**-k) / (1 - 2.0**-k) - 3), np.array(-0.99), np.array(20.0)))
        g = math.gamma(1 + k)
        a = l2 * k / ((1 - 2**-k) * g) if abs(k) > 1e-9 else l2 / math.log(2)
        return [l1 - (a * (1 - g) / k if abs(k) > 1e-9 else a * EULER), a, k]
    if name == "pearson3":  # Hosking and Wallis (1997)
        if abs(t3) < 1 / 3:
            z = 3 * math.pi * t3 * t3
            al = (1 + 0.2906 * z) / (z + 0.1882 * z**2 + 0.0442 * z**3) if z > 0 else math.inf
        else:
            z = 1 - abs(t3)
            al = (0.36067 * z - 0.59567 * z**2 + 0.25361 * z**3) / (1 - 2.78861 * z + 2.56096 * z**2 - 0.77045 * z**3)
        if not math.isfinite(al):
            return [l1, l2 * math.sqrt(math.pi), 0.0]
        return [l1, l2 * math.sqrt(math.pi * al) * math.exp(math.lgamma(al) - math.lgamma(al + 0.5)), math.copysign(2 / math.sqrt(al), t3)]
    if name == "generalized_normal":  # rational fit of Hosking (1996)
        t = t3 * t3
        k = -t3 * (2.0466534 - 3.6544371 * t + 1.8396733 * t**2 - 0.20360244 * t**3) / (1 - 2.0182173 * t + 1.2420401 * t**2 - 0.21741801 * t**3)
        if abs(k) < 1e-9:
            return [l1, l2 * math.sqrt(math.pi), 0.0]
        a = l2 * k * math.exp(-k * k / 2) / (1 - 2 * float(S.normal_cdf(-k / math.sqrt(2))))
        return [l1 - a / k * (1 - math.exp(k * k / 2)), a, k]
    if name == "gamma":
        r = l2 / l1
        if r < 0.5:
            z = math.pi * r * r
            kappa = (1 - 0.3080 * z) / (z - 0.05812 * z * z + 0.01765 * z**3)
        else:
            z = 1 - r
            kappa = (0.7213 * z - 0.5947 * z * z) / (1 - 2.1817 * z + 1.2113 * z * z)
        return [l1 / kappa, kappa]
    raise ValueError(f"no L-moment estimator for {name}")


def moment_parameters(name: str, n: Column, mean: Column, sd: Column, skew: Column) -> Column:
    """Method of moments for the families with closed forms."""
    if name == "normal":
        return F.array(mean, sd)
    if name == "exponential":
        return F.array(mean - sd, sd)
    if name == "gumbel":
        return F.array(mean - EULER * math.sqrt(6) / math.pi * sd, math.sqrt(6) / math.pi * sd)
    if name == "logistic":
        return F.array(mean, sd * math.sqrt(3) / math.pi)
    if name == "gamma":
        return F.array(sd * sd / mean, mean * mean / (sd * sd))
    if name == "pearson3":
        return F.array(mean, sd, skew)
    if name == "uniform":
        return F.array(mean - sd * math.sqrt(3), mean + sd * math.sqrt(3))
    if name == "rayleigh":
        return F.array(mean / math.sqrt(math.pi / 2))
    if name == "poisson":
        return F.array(mean)
    raise ValueError(f"no moment estimator for {name}")


#: Start values for likelihood searches, from sample mean and deviation.
_STARTS: dict[str, Callable] = {
    "normal": lambda x: [x.mean(), x.std()], "ln_normal": lambda x: [np.log(x).mean(), np.log(x).std()], "log_normal": lambda x: [np.log10(x).mean(), np.log10(x).std()],
    "gumbel": lambda x: [x.mean() - 0.45 * x.std(), 0.78 * x.std()], "logistic": lambda x: [x.mean(), 0.55 * x.std()], "gev": lambda x: [x.mean() - 0.45 * x.std(), 0.78 * x.std(), 0.01],
    "generalized_logistic": lambda x: [x.mean(), 0.55 * x.std(), 0.01], "generalized_normal": lambda x: [x.mean(), x.std(), 0.01], "generalized_pareto": lambda x: [x.min() - 0.01 * x.std(), x.std(), 0.01],
    "gamma": lambda x: [x.var() / x.mean(), x.mean() ** 2 / x.var()], "weibull": lambda x: [x.mean(), 1.2], "pearson3": lambda x: [x.mean(), x.std(), 0.1], "log_pearson3": lambda x: [np.log10(x).mean(), np.log10(x).std(), 0.1],
    "exponential": lambda x: [x.min() - 1e-6, x.mean() - x.min()], "von_mises": lambda x: [math.atan2(np.sin(x).mean(), np.cos(x).mean()), 1.0], "triangular": lambda x: [x.min() - 0.1 * x.std(), float(np.median(x)), x.max() + 0.1 * x.std()],
    "pert": lambda x: [x.min() - 0.1 * x.std(), float(np.median(x)), x.max() + 0.1 * x.std()], "kappa4": lambda x: [x.mean() - 0.45 * x.std(), 0.78 * x.std(), 0.01, 0.01], "cauchy": lambda x: [float(np.median(x)), float(np.subtract(*np.percentile(x, [75, 25])) / 2)],
}


def maximum_likelihood(name: str, x: np.ndarray) -> list[float]:
    """Nelder-Mead on the negative log-likelihood, in steps scaled by the start."""
    from .optimize import nelder_mead

    x = np.asarray(x, float)
    x = x[np.isfinite(x)]
    start = np.array(_STARTS[name](x), float)

    def cost(p: np.ndarray) -> float:
        with np.errstate(all="ignore"):
            ll = float(np.sum(evaluate(name, "log_pdf", x, p)))
        return -ll if math.isfinite(ll) else 1e300

    return nelder_mead(cost, start, 0.1 * np.maximum(np.abs(start), 0.1)).x.tolist()


def fit_groups(df: DataFrame, v: str, keys: Sequence[str], name: str) -> DataFrame:
    """Maximum likelihood of each group (a group must fit one task): keys, dist, params, loglik, n."""
    schema = ", ".join(f"`{k}` {t}" for k, t in df.select(*keys).dtypes) + ", dist string, params array<double>, loglik double, n long"

    def one(key, pdf):
        x = pdf[v].to_numpy(float)
        x = x[np.isfinite(x)]
        p = maximum_likelihood(name, x) if len(x) > 3 else [math.nan] * len(FAMILIES[name].names)
        ll = float(np.sum(evaluate(name, "log_pdf", x, p))) if len(x) > 3 else math.nan
        return pd.DataFrame([[*key, name, p, ll, len(x)]], columns=[*keys, "dist", "params", "loglik", "n"])

    return df.select(*keys, v).groupBy(*keys).applyInPandas(one, schema)


def empirical_cdf(x, points: Sequence[float], probs: Sequence[float]) -> np.ndarray:
    return np.interp(x, points, probs, left=0.0, right=1.0)


def kernel_density(x, sample: np.ndarray, bandwidth: float | None = None, kernel: str = "gaussian") -> np.ndarray:
    """Density at x; Silverman's bandwidth by default."""
    sample = np.asarray(sample, float)
    h = bandwidth or sample.std(ddof=1) * (4 / (3 * len(sample))) ** 0.2
    u = (np.asarray(x, float)[:, None] - sample) / h
    k = {"gaussian": S.normal_pdf, "epanechnikov": lambda t: 0.75 * np.clip(1 - t * t, 0, None), "triangular": lambda t: np.clip(1 - np.abs(t), 0, None), "uniform": lambda t: 0.5 * (np.abs(t) <= 1)}[kernel]
    return k(u).mean(1) / h


def mixture_cdf(x, weights: Sequence[float], parts: Sequence[tuple[str, Sequence[float]]]) -> np.ndarray:
    return sum(w * evaluate(n, "cdf", x, p) for w, (n, p) in zip(weights, parts, strict=True))


def competing_risks_cdf(x, parts: Sequence[tuple[str, Sequence[float]]], largest: bool = False) -> np.ndarray:
    """Of the smallest (or largest) of independent risks."""
    f = np.stack([evaluate(n, "cdf", x, p) for n, p in parts])
    return f.prod(0) if largest else 1 - (1 - f).prod(0)


def truncated_cdf(x, name: str, params: Sequence[float], lo: float, hi: float) -> np.ndarray:
    a, b = evaluate(name, "cdf", [lo, hi], params)
    return np.clip((evaluate(name, "cdf", np.clip(x, lo, hi), params) - a) / (b - a), 0, 1)


def moments(name: str, params: Sequence[float], points: int = 4000) -> tuple[float, float, float, float]:
    """Mean, deviation, skewness and kurtosis by the quantile function at midpoints."""
    x = evaluate(name, "quantile", (np.arange(points) + 0.5) / points, params)
    m, s = x.mean(), x.std()
    return float(m), float(s), float(((x - m) ** 3).mean() / s**3), float(((x - m) ** 4).mean() / s**4)


def log_likelihood(name: str, params: Sequence[float], exact=(), left=(), right=(), between=()) -> float:
    """Of exact values, values known to be below or above a limit, and values between two limits; minus infinity where undefined."""
    total = 0.0
    for what, values in (("log_pdf", exact), ("log_cdf", left), ("log_ccdf", right)):
        if len(values):
            total += float(np.sum(evaluate(name, what, values, params)))
    if len(between):
        lo, hi = np.asarray(between, float).T
        mass = evaluate(name, "cdf", hi, params) - evaluate(name, "cdf", lo, params)
        with np.errstate(divide="ignore"):
            total += float(np.sum(np.log(np.maximum(mass, 0))))
    return total if math.isfinite(total) else -math.inf


def censored_log_likelihood(df: DataFrame, v: str, kind: str, name: str, params: Sequence[float], keys: Sequence[str] = ()) -> DataFrame:
    """Log-likelihood by key; ``kind`` is a column of exact, left or right."""
    x, k = F.col(v).cast("double"), F.col(kind)
    ll = F.when(k == "left", apply("log_cdf", x, name, params)).when(k == "right", apply("log_ccdf", x, name, params)).otherwise(apply("log_pdf", x, name, params))
    return df.groupBy(*keys).agg(F.sum(ll).alias("loglik"))


def validate(name: str, params: Sequence[float]) -> str:
    """What is wrong with the parameters; empty if nothing is."""
    if name not in FAMILIES:
        return f"no distribution {name}"
    names = FAMILIES[name].names
    if len(params) != len(names):
        return f"{name} takes {', '.join(names)}"
    p = dict(zip(names, map(float, params), strict=True))
    if not all(math.isfinite(v) for v in p.values()):
        return "all parameters must be finite"
    for k in ("sigma", "alpha", "theta", "kappa", "beta", "nu", "lambda", "xm"):
        shape = k == "kappa" and name in ("gev", "generalized_logistic", "generalized_pareto", "generalized_normal", "kappa4")
        if k in p and not shape and p[k] <= 0:
            return f"{k} must be positive"
    if {"min", "max"} <= p.keys() and p["min"] >= p["max"]:
        return "min must be below max"
    if "mode" in p and not p["min"] <= p["mode"] <= p["max"]:
        return "the mode must lie between min and max"
    if "p" in p and not 0 <= p["p"] <= 1:
        return "p must lie between 0 and 1"
    return ""


def create(name: str, params: Sequence[float]) -> tuple[str, list[float]]:
    """A distribution by its tag; raises ValueError for parameters out of range."""
    problem = validate(name, params)
    if problem:
        raise ValueError(problem)
    return name, [float(v) for v in params]


def graph(name: str, params: Sequence[float], what: str = "cdf", points: int = 1000, lo: float = 0.0005, hi: float = 0.9995) -> np.ndarray:
    """Rows (x, value) between two quantiles; for what = quantile, (probability, x)."""
    p = np.linspace(lo, hi, points)
    if what == "quantile":
        return np.column_stack([p, evaluate(name, "quantile", p, params)])
    ends = evaluate(name, "quantile", [lo, hi], params)
    x = np.linspace(ends[0], ends[1], points)
    return np.column_stack([x, evaluate(name, what, x, params)])


def conditional_moments(name: str, params: Sequence[float], lo: float, hi: float, points: int = 200) -> tuple[float, float, float, float]:
    """Mean, deviation, skewness and kurtosis given that the value lies between two limits, by Gauss's rule over its probability."""
    a, b = evaluate(name, "cdf", [lo, hi], params)
    nodes, w = np.polynomial.legendre.leggauss(points)
    x = evaluate(name, "quantile", a + (b - a) * (nodes + 1) / 2, params)
    w = w / 2
    m = float((w * x).sum())
    s = math.sqrt(float((w * (x - m) ** 2).sum()))
    return m, s, float((w * (x - m) ** 3).sum()) / s**3, float((w * (x - m) ** 4).sum()) / s**4


def expected_shortfall(name: str, params: Sequence[float], p: float) -> float:
    """Mean of the values beyond the quantile of p."""
    nodes, w = np.polynomial.legendre.leggauss(200)
    t = (nodes + 1) / 2
    u = np.minimum(1 - (1 - p) * (1 - t) ** 4, 1 - 1e-15)  # denser towards the tail
    return float((w / 2 * evaluate(name, "quantile", u, params) * 4 * (1 - t) ** 3).sum())


def empirical_quantile(p, points: Sequence[float], probs: Sequence[float]) -> np.ndarray:
    return np.interp(p, probs, points)


def empirical_pdf(x, points: Sequence[float], probs: Sequence[float]) -> np.ndarray:
    """Slope of the tabulated probability; 0 outside."""
    x, v, p = (np.asarray(a, float) for a in (x, points, probs))
    i = np.clip(np.searchsorted(v, x, "right") - 1, 0, len(v) - 2)
    return np.where((x >= v[0]) & (x <= v[-1]), (p[i + 1] - p[i]) / (v[i + 1] - v[i]), 0.0)


def mixture_pdf(x, weights: Sequence[float], parts: Sequence[tuple[str, Sequence[float]]]) -> np.ndarray:
    return sum(w * evaluate(n, "pdf", x, p) for w, (n, p) in zip(weights, parts, strict=True))


def _ends(parts: Sequence[tuple[str, Sequence[float]]]) -> tuple[float, float]:
    q = np.concatenate([evaluate(n, "quantile", [1e-12, 1 - 1e-12], p) for n, p in parts])
    return float(q.min()), float(q.max())


def mixture_quantile(p, weights: Sequence[float], parts: Sequence[tuple[str, Sequence[float]]]) -> np.ndarray:
    p = np.asarray(p, float)
    lo, hi = _ends(parts)
    return S.bisect(lambda x: mixture_cdf(x, weights, parts) - p, np.full(p.shape, lo), np.full(p.shape, hi))


def fit_normal_mixture(x, k: int, seed: int = 1) -> tuple[list[float], list[tuple[str, list[float]]]]:
    """Weights and normal parts by expectation and maximisation."""
    from ..operators.learning import gaussian_mixture

    w, means, cov, _ = gaussian_mixture(np.asarray(x, float), k, seed)
    order = np.argsort(means[:, 0], kind="stable")
    return w[order].tolist(), [("normal", [float(means[i, 0]), float(math.sqrt(cov[i, 0, 0]))]) for i in order]


def fit_mixture(x, parts: Sequence[tuple[str, Sequence[float]]], weights: Sequence[float]) -> tuple[list[float], list[tuple[str, list[float]]]]:
    """Maximum likelihood of weights and parts together, from given ones."""
    return _fit_parts(x, parts, weights, lambda v, w, parts: mixture_pdf(v, w, parts))


def competing_risks_pdf(x, parts: Sequence[tuple[str, Sequence[float]]], largest: bool = False) -> np.ndarray:
    """Density of the smallest (or largest) of independent risks."""
    f = np.stack([evaluate(n, "cdf", x, p) for n, p in parts])
    d = np.stack([evaluate(n, "pdf", x, p) for n, p in parts])
    other = f if largest else 1 - f
    return sum(d[i] * np.delete(other, i, 0).prod(0) for i in range(len(parts)))


def competing_risks_quantile(p, parts: Sequence[tuple[str, Sequence[float]]], largest: bool = False) -> np.ndarray:
    p = np.asarray(p, float)
    lo, hi = _ends(parts)
    return S.bisect(lambda x: competing_risks_cdf(x, parts, largest) - p, np.full(p.shape, lo), np.full(p.shape, hi))


def competing_risks_dependent_cdf(x: float, parts: Sequence[tuple[str, Sequence[float]]], corr, largest: bool = False) -> float:
    """The same for risks that are normal scores with a correlation; 1 or -1 instead of a matrix stands for full dependence."""
    from ..operators.probability import multivariate_normal_cdf

    f = np.array([float(evaluate(n, "cdf", [x], p)[0]) for n, p in parts])
    if np.ndim(corr) == 0:
        if corr > 0:
            return float(f.min() if largest else f.max())
        return float(max(0.0, f.sum() - len(f) + 1) if largest else min(1.0, f.sum()))
    z = S.normal_quantile(np.clip(f, 1e-12, 1 - 1e-12))
    return multivariate_normal_cdf(z, np.asarray(corr)) if largest else 1 - multivariate_normal_cdf(-z, np.asarray(corr))


def fit_competing_risks(x, parts: Sequence[tuple[str, Sequence[float]]], largest: bool = False) -> list[tuple[str, list[float]]]:
    """Maximum likelihood of all risks' parameters, from given ones."""
    return _fit_parts(x, parts, None, lambda v, w, parts: competing_risks_pdf(v, parts, largest))[1]


def _fit_parts(x, parts, weights, density) -> tuple[list[float], list[tuple[str, list[float]]]]:
    from .optimize import nelder_mead

    x = np.asarray(x, float)
    sizes = [len(p) for _, p in parts]
    k = len(parts) - 1 if weights is not None else 0

    def unpacked(t):
        e = np.exp(np.append(t[:k], 0.0) - max(0.0, *t[:k])) if k else np.ones(len(parts))
        cut = np.split(t[k:], np.cumsum(sizes)[:-1])
        return (e / e.sum()).tolist(), [(n, c.tolist()) for (n, _), c in zip(parts, cut, strict=True)]

    def cost(t):
        w, own = unpacked(t)
        if any(validate(n, p) for n, p in own):
            return 1e300
        with np.errstate(all="ignore"):
            ll = float(np.log(np.maximum(density(x, w, own), 1e-300)).sum())
        return -ll if math.isfinite(ll) else 1e300

    start = np.concatenate([np.log(np.asarray(weights[:-1], float) / weights[-1]) if k else np.empty(0), *(np.asarray(p, float) for _, p in parts)])
    return unpacked(nelder_mead(cost, start, 0.1 * np.maximum(np.abs(start), 0.1), most=8000).x)


def truncated_pdf(x, name: str, params: Sequence[float], lo: float, hi: float) -> np.ndarray:
    x = np.asarray(x, float)
    a, b = evaluate(name, "cdf", [lo, hi], params)
    return np.where((x >= lo) & (x <= hi), evaluate(name, "pdf", x, params) / (b - a), 0.0)


def truncated_quantile(p, name: str, params: Sequence[float], lo: float, hi: float) -> np.ndarray:
    a, b = evaluate(name, "cdf", [lo, hi], params)
    return evaluate(name, "quantile", a + np.asarray(p, float) * (b - a), params)


def pert_from_percentiles(low: float, middle: float, high: float) -> list[float]:
    """Min, mode and max of the PERT distribution whose 5, 50 and 95 % quantiles are given, by simplex search on their probabilities."""
    from .optimize import nelder_mead

    goal, span = np.array([low, middle, high], float), high - low

    def shaped(t):  # steps below, at and above the middle, so the order always holds
        a, c = low - span * math.exp(t[0]), low + span / (1 + math.exp(-t[1]))
        return [a, c, max(high, c) + span * math.exp(t[2])]

    def cost(t):
        f = evaluate("pert", "cdf", goal, shaped(np.clip(t, -8, 8)))
        return float(((f - np.array([0.05, 0.5, 0.95])) ** 2).sum())

    best = min((nelder_mead(cost, np.array([-1.5, s, -1.5]), 0.5, 1e-14) for s in (-1.0, 0.0, 1.0)), key=lambda r: r.fun)
    return [float(v) for v in shaped(np.clip(best.x, -8, 8))]


def pert_percentile(what: str, x, low: float, middle: float, high: float, normal_scores: bool = False) -> np.ndarray:
    """pdf, cdf or quantile of the PERT of three percentiles; with ``normal_scores`` these are probabilities, and the PERT is of their normal quantiles."""
    if not normal_scores:
        return evaluate("pert", what, x, pert_from_percentiles(low, middle, high))
    params = pert_from_percentiles(*S.normal_quantile(np.array([low, middle, high])).tolist())
    if what == "quantile":
        return S.normal_cdf(evaluate("pert", "quantile", x, params))
    z = S.normal_quantile(np.asarray(x, float))
    f = evaluate("pert", what, z, params)
    return f if what == "cdf" else f / S.normal_pdf(z)
