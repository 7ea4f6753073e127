"""Special functions on numpy arrays (no compiled library beyond numpy)."""

from __future__ import annotations

import math

import numpy as np


def _each(f, x):
    return np.frompyfunc(f, 1, 1)(x)


def _f(x) -> np.ndarray:
    return np.asarray(x, float)


def erf(x):
    return _f(_each(math.erf, _f(x)))


def erfc(x):
    return _f(_each(math.erfc, _f(x)))


def log_gamma(x):
    x = _f(x)
    ok = np.isfinite(x) & ((x > 0) | (x != np.floor(x)))
    out = np.where(x > 0, np.inf, np.nan)
    return np.where(ok, _f(_each(math.lgamma, np.where(ok, x, 1.0))), out)


def gamma(x):
    x = _f(x)
    sign = np.where((x < 0) & (np.floor(x) % 2 != 0), -1.0, 1.0)
    return sign * np.exp(log_gamma(x))


def digamma(x):
    """By recurrence to x >= 10, then the asymptotic series; reflection below 0."""
    x = _f(x).copy()
    reflect = x <= 0
    y = np.where(reflect, 1 - x, x)
    out = np.zeros_like(y)
    for _ in range(10):
        low = y < 10
        out -= np.where(low, 1 / y, 0)
        y = np.where(low, y + 1, y)
    r = 1 / (y * y)
    out += np.log(y) - 0.5 / y - r * (1 / 12 - r * (1 / 120 - r * (1 / 252 - r * (1 / 240 - r / 132))))
    return np.where(reflect, out - np.pi / np.tan(np.pi * np.where(reflect, x, 0.5)), out)


def trigamma(x):
    y = _f(x).copy()
    out = np.zeros_like(y)
    for _ in range(10):
        low = y < 10
        out += np.where(low, 1 / (y * y), 0)
        y = np.where(low, y + 1, y)
    r = 1 / (y * y)
    return out + 1 / y + r / 2 + r / y * (1 / 6 - r * (1 / 30 - r * (1 / 42 - r / 30)))


def gamma_p(a, x):
    """Regularised lower incomplete gamma: series below a + 1, continued fraction above."""
    a, x = np.broadcast_arrays(_f(a), _f(x))
    shape = a.shape
    a, x = a.ravel(), x.ravel()
    out = np.where(np.isnan(a) | np.isnan(x) | (a <= 0), np.nan, np.where(x <= 0, 0.0, 1.0))
    go = np.isfinite(x) & (x > 0) & (a > 0)
    front = np.exp(np.where(go, a * np.log(np.where(go, x, 1)) - x - log_gamma(np.where(go, a, 1)), -np.inf))
    low = go & (x < a + 1)
    if low.any():
        aa, xx = a[low], x[low]
        term = total = 1 / aa
        for n in range(1, 2000):
            term = term * xx / (aa + n)
            total = total + term
            if (np.abs(term) <= np.abs(total) * 1e-17).all():
                break
        out[low] = total * front[low]
    high = go & ~low
    if high.any():
        aa, xx = a[high], x[high]
        b = xx + 1 - aa
        c, d = np.full_like(b, 1e300), 1 / b
        h = d
        for n in range(1, 2000):
            an = -n * (n - aa)
            b = b + 2
            d = 1 / np.where(np.abs(an * d + b) < 1e-300, 1e-300, an * d + b)
            c = np.where(np.abs(b + an / c) < 1e-300, 1e-300, b + an / c)
            step = d * c
            h = h * step
            if (np.abs(step - 1) < 4e-16).all():
                break
        out[high] = 1 - front[high] * h
    return out.reshape(shape)


def gamma_q(a, x):
    return 1 - gamma_p(a, x)


def beta_i(a, b, x):
    """Regularised incomplete beta by Lentz's continued fraction."""
    a, b, x = (v.ravel() for v in np.broadcast_arrays(_f(a), _f(b), _f(x)))
    bad = np.isnan(a) | np.isnan(b) | np.isnan(x) | (a <= 0) | (b <= 0)
    inside = ~bad & (x > 0) & (x < 1)
    out = np.where(bad, np.nan, np.where(x >= 1, 1.0, 0.0))
    if inside.any():
        aa, bb, xx = a[inside], b[inside], x[inside]
        swap = xx > (aa + 1) / (aa + bb + 2)
        p, q, y = np.where(swap, bb, aa), np.where(swap, aa, bb), np.where(swap, 1 - xx, xx)
        front = np.exp(log_gamma(p + q) - log_gamma(p) - log_gamma(q) + p * np.log(y) + q * np.log1p(-y)) / p
        c, d = np.ones_like(p), 1 - (p + q) * y / (p + 1)
        d = 1 / np.where(np.abs(d) < 1e-300, 1e-300, d)
        h = d
        for m in range(1, 1000):
            for an in (m * (q - m) * y / ((p + 2 * m - 1) * (p + 2 * m)), -(p + m) * (p + q + m) * y / ((p + 2 * m) * (p + 2 * m + 1))):
                d = 1 + an * d
                d = 1 / np.where(np.abs(d) < 1e-300, 1e-300, d)
                c = 1 + an / c
                c = np.where(np.abs(c) < 1e-300, 1e-300, c)
                h = h * d * c
            if (np.abs(d * c - 1) < 4e-16).all():
                break
        value = front * h
        out[inside] = np.where(swap, 1 - value, value)
    return out


def log_beta(a, b):
    return log_gamma(a) + log_gamma(b) - log_gamma(_f(a) + _f(b))


def beta(a, b):
    return np.exp(log_beta(a, b))


def bisect(f, lo, hi, steps: int = 200):
    """Root of an increasing vectorised function on [lo, hi]."""
    lo, hi = (v.copy() for v in np.broadcast_arrays(_f(lo), _f(hi)))
    for _ in range(steps):
        mid = (lo + hi) / 2
        up = f(mid) < 0
        lo, hi = np.where(up, mid, lo), np.where(up, hi, mid)
        if (hi - lo <= 1e-15 * np.maximum(np.abs(mid), 1e-300)).all():
            break
    return (lo + hi) / 2


def gamma_p_inverse(a, p):
    a, p = np.broadcast_arrays(_f(a), _f(p))
    hi = a + 40 * np.sqrt(a) + 100
    x = bisect(lambda t: gamma_p(a, t) - p, np.zeros_like(p), hi)
    return np.where(p <= 0, 0.0, np.where(p >= 1, np.inf, x))


def beta_i_inverse(a, b, p):
    p = _f(p)
    x = bisect(lambda t: beta_i(a, b, t).reshape(p.shape) - p, np.zeros_like(p), np.ones_like(p))
    return np.where(p <= 0, 0.0, np.where(p >= 1, 1.0, x))


def normal_cdf(z):
    return 0.5 * erfc(-_f(z) / math.sqrt(2))


def normal_pdf(z):
    return np.exp(-0.5 * _f(z) ** 2) / math.sqrt(2 * math.pi)


def normal_quantile(p):
    """A rational start (Odeh and Evans, 1974), sharpened by Newton steps with Halley's correction."""
    p = _f(p)
    inner = np.clip(p, 1e-300, 1 - 1e-16)
    t = np.sqrt(-2 * np.log(np.minimum(inner, 1 - inner)))
    # fixed values of the published approximation
    top = -0.322232431088 - t * (1 + t * (0.342242088547 + t * (0.0204231210245 + t * 0.453642210148e-4)))
    low = 0.0993484626060 + t * (0.588581570495 + t * (0.531103462366 + t * (0.103537752850 + t * 0.38560700634e-2)))
    x = -(t + top / low)
    half = np.minimum(inner, 1 - inner)
    for _ in range(3):
        e = (normal_cdf(x) - half) / np.maximum(normal_pdf(x), 1e-300)
        x = x - e / (1 + x * e / 2)
    x = np.where(inner > 0.5, -x, x)
    return np.where(p <= 0, -np.inf, np.where(p >= 1, np.inf, x))


def erf_inverse(y):
    return normal_quantile((_f(y) + 1) / 2) / math.sqrt(2)


def erfc_inverse(y):
    return -normal_quantile(_f(y) / 2) / math.sqrt(2)


def t_cdf(t, df):
    t, df = _f(t), _f(df)
    tail = 0.5 * beta_i(df / 2, 0.5, df / (df + t * t)).reshape(np.broadcast(t, df).shape)
    return np.where(t > 0, 1 - tail, tail)


def t_two_sided(t, df):
    t, df = _f(t), _f(df)
    return beta_i(df / 2, 0.5, df / (df + t * t)).reshape(np.broadcast(t, df).shape)


def t_quantile(p, df):
    p = _f(p)
    x = beta_i_inverse(_f(df) / 2, 0.5, 2 * np.minimum(p, 1 - p))
    t = np.sqrt(df * (1 - x) / np.maximum(x, 1e-300))
    return np.where(p < 0.5, -t, t)


def log_factorial(n):
    return log_gamma(_f(n) + 1)


def binomial_coefficient(n, k):
    return np.round(np.exp(log_factorial(n) - log_factorial(k) - log_factorial(_f(n) - _f(k))))


def polynomial(coefficients, x):
    """c0 + c1 x + c2 x^2 + ..."""
    out = np.zeros_like(_f(x))
    for c in reversed(list(coefficients)):
        out = out * x + c
    return out


_NODES, _WEIGHTS = np.polynomial.legendre.leggauss(200)


def _integral(f, lo: float, hi: float):
    x = (hi - lo) / 2 * _NODES + (hi + lo) / 2
    return (hi - lo) / 2 * (f(x) * _WEIGHTS).sum(-1)


def bessel_i(n: int, x):
    """From the integral (1 / pi) of exp(x cos t) cos(n t) over 0..pi."""
    x = _f(x)[..., None]
    return _integral(lambda t: np.exp(x * np.cos(t)) * np.cos(n * t), 0, math.pi) / math.pi


def bessel_j(n: int, x):
    x = _f(x)[..., None]
    return _integral(lambda t: np.cos(n * t - x * np.sin(t)), 0, math.pi) / math.pi


def bessel_k(n: int, x):
    x = _f(x)[..., None]
    return _integral(lambda t: np.exp(-x * np.cosh(t)) * np.cosh(n * t), 0, 12.0)


def bessel_y(n: int, x):
    x = _f(x)[..., None]
    first = _integral(lambda t: np.sin(x * np.sin(t) - n * t), 0, math.pi) / math.pi
    second = _integral(lambda t: (np.exp(n * t) + (-1) ** n * np.exp(-n * t)) * np.exp(-x * np.sinh(t)), 0, 10.0) / math.pi
    return first - second


def debye(x):
    """(1 / x) times the integral of t / (e^t - 1) over 0..x."""
    x = _f(x)
    half = x[..., None] / 2
    t = half * (_NODES + 1)
    with np.errstate(invalid="ignore", divide="ignore"):
        y = np.where(np.abs(t) < 1e-12, 1.0, t / np.expm1(t))
    return (y * _WEIGHTS).sum(-1) / 2
