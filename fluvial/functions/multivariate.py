"""Multivariate distributions and copulas (numpy kernels)."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np

from . import special as S
from .optimize import golden, nelder_mead


def mahalanobis(x, mean, cov) -> np.ndarray:
    d = np.atleast_2d(x) - mean
    return (d * np.linalg.solve(cov, d.T).T).sum(1)


def normal_log_pdf(x, mean, cov) -> np.ndarray:
    return -0.5 * (mahalanobis(x, mean, cov) + len(mean) * math.log(2 * math.pi) + np.linalg.slogdet(cov)[1])


def t_log_pdf(x, mean, scale, nu: float) -> np.ndarray:
    d = len(mean)
    return S.log_gamma((nu + d) / 2) - S.log_gamma(nu / 2) - d / 2 * math.log(nu * math.pi) - 0.5 * np.linalg.slogdet(scale)[1] - (nu + d) / 2 * np.log1p(mahalanobis(x, mean, scale) / nu)


def normal_sample(mean, cov, n: int, seed: int = 1) -> np.ndarray:
    return np.asarray(mean) + np.random.default_rng(seed).normal(size=(n, len(mean))) @ np.linalg.cholesky(cov).T


def t_sample(mean, scale, nu: float, n: int, seed: int = 1) -> np.ndarray:
    z = normal_sample(np.zeros(len(mean)), scale, n, seed)
    return np.asarray(mean) + z / np.sqrt(np.random.default_rng([seed, 1]).chisquare(nu, n) / nu)[:, None]


def conditional(mean, cov, known: Sequence[int], values) -> tuple[np.ndarray, np.ndarray]:
    """Mean and covariance of the other axes, given some."""
    mean, cov = np.asarray(mean, float), np.asarray(cov, float)
    k = list(known)
    o = [i for i in range(len(mean)) if i not in k]
    g = np.linalg.solve(cov[np.ix_(k, k)], cov[np.ix_(k, o)]).T
    return mean[o] + g @ (np.asarray(values) - mean[k]), cov[np.ix_(o, o)] - g @ cov[np.ix_(k, o)]


def dirichlet_log_pdf(x, a) -> np.ndarray:
    x, a = np.atleast_2d(x), np.asarray(a, float)
    return ((a - 1) * np.log(x)).sum(1) + S.log_gamma(a.sum()) - S.log_gamma(a).sum()


def dirichlet_covariance(a) -> np.ndarray:
    a = np.asarray(a, float)
    s = a.sum()
    m = a / s
    return (np.diag(m) - np.outer(m, m)) / (s + 1)


def multinomial_log_pmf(x, p) -> np.ndarray:
    x = np.atleast_2d(x)
    return S.log_factorial(x.sum(1)) - S.log_factorial(x).sum(1) + (x * np.log(p)).sum(1)


# --- copulas: C(u, v), with the inverse of dC/du in v for sampling ---------------


def _clayton(u, v, t):
    return np.maximum(u**-t + v**-t - 1, 0) ** (-1 / t)


def _frank(u, v, t):
    return -np.log1p(np.expm1(-t * u) * np.expm1(-t * v) / math.expm1(-t)) / t


def _gumbel(u, v, t):
    return np.exp(-(((-np.log(u)) ** t + (-np.log(v)) ** t) ** (1 / t)))


def _joe(u, v, t):
    a, b = (1 - u) ** t, (1 - v) ** t
    return 1 - (a + b - a * b) ** (1 / t)


def _amh(u, v, t):
    return u * v / (1 - t * (1 - u) * (1 - v))


def _gaussian(u, v, r):
    from ..operators.probability import bivariate_normal

    return np.vectorize(lambda a, b: bivariate_normal(a, b, r))(S.normal_quantile(u), S.normal_quantile(v))


COPULAS: dict[str, tuple[Callable, tuple[float, float]]] = {"clayton": (_clayton, (1e-3, 40)), "frank": (_frank, (-40, 40)), "gumbel": (_gumbel, (1.0001, 40)), "joe": (_joe, (1.0001, 40)), "ali_mikhail_haq": (_amh, (-1, 0.9999)), "normal": (_gaussian, (-0.999, 0.999))}


def copula_cdf(name: str, u, v, theta: float) -> np.ndarray:
    u, v = np.asarray(u, float), np.asarray(v, float)
    return u * v if name == "frank" and abs(theta) < 1e-9 else COPULAS[name][0](u, v, theta)


def copula_log_pdf(name: str, u, v, theta: float, nu: float = 4.0) -> np.ndarray:
    u, v = (np.clip(np.asarray(a, float), 1e-10, 1 - 1e-10) for a in (u, v))
    if name in ("normal", "student_t"):
        r = theta
        if name == "normal":
            x, y = S.normal_quantile(u), S.normal_quantile(v)
            return -0.5 * math.log(1 - r * r) - (r * r * (x * x + y * y) - 2 * r * x * y) / (2 * (1 - r * r))
        x, y = S.t_quantile(u, nu), S.t_quantile(v, nu)
        one = lambda z: S.log_gamma((nu + 1) / 2) - S.log_gamma(nu / 2) - 0.5 * math.log(nu * math.pi) - (nu + 1) / 2 * np.log1p(z * z / nu)
        return t_log_pdf(np.column_stack([x.ravel(), y.ravel()]), np.zeros(2), np.array([[1, r], [r, 1]]), nu).reshape(x.shape) - one(x) - one(y)
    if name == "clayton":
        return math.log1p(theta) - (theta + 1) * (np.log(u) + np.log(v)) - (2 + 1 / theta) * np.log(u**-theta + v**-theta - 1)
    if name == "frank":
        e = -math.expm1(-theta)
        return np.log(theta * e) - theta * (u + v) - 2 * np.log(np.abs(e - -np.expm1(-theta * u) * -np.expm1(-theta * v)))
    h = 1e-4
    a, b, c, d = (np.clip(z, 1e-9, 1 - 1e-9) for z in (u + h, u - h, v + h, v - h))
    f = COPULAS[name][0]
    return np.log(np.maximum((f(a, c, theta) - f(a, d, theta) - f(b, c, theta) + f(b, d, theta)) / ((a - b) * (c - d)), 1e-300))


def copula_sample(name: str, theta: float, n: int, seed: int = 1, nu: float = 4.0) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    if name in ("normal", "student_t"):
        cov = np.array([[1, theta], [theta, 1]])
        z = normal_sample(np.zeros(2), cov, n, seed) if name == "normal" else t_sample(np.zeros(2), cov, nu, n, seed)
        return tuple((S.normal_cdf(z) if name == "normal" else S.t_cdf(z, np.full(z.shape, nu))).T)
    u, w = rng.random(n), rng.random(n)
    h = 1e-6
    a, b = np.minimum(u + h, 1 - 1e-12), np.maximum(u - h, 1e-12)
    return u, S.bisect(lambda v: (copula_cdf(name, a, v, theta) - copula_cdf(name, b, v, theta)) / (a - b) - w, np.full(n, 1e-12), np.full(n, 1 - 1e-12), 60)


def theta_from_tau(name: str, tau: float) -> float:
    if name == "clayton":
        return 2 * tau / (1 - tau)
    if name == "gumbel":
        return 1 / (1 - tau)
    if name in ("normal", "student_t"):
        return math.sin(math.pi / 2 * tau)
    if name == "ali_mikhail_haq":
        f = lambda t: 1 - 2 * (t + (1 - t) ** 2 * math.log1p(-t)) / (3 * t * t) - tau
    elif name == "frank":
        f = lambda t: 1 - 4 / t * (1 - float(S.debye(np.array(t)))) - tau
    else:
        raise ValueError(name)
    from .optimize import bisection

    lo, hi = ((1e-6, 40.0) if tau > 0 else (-40.0, -1e-6)) if name == "frank" else ((1e-6, 0.9999) if tau > 0 else (-0.9999, -1e-6))
    return bisection(f, lo, hi)


def tail_dependence(name: str, theta: float, nu: float = 4.0) -> tuple[float, float]:
    """Lower and upper coefficients."""
    if name == "clayton":
        return (2 ** (-1 / theta) if theta > 0 else 0.0), 0.0
    if name in ("gumbel", "joe"):
        return 0.0, 2 - 2 ** (1 / theta)
    if name == "student_t":
        t = 2 * float(S.t_cdf(np.array(-math.sqrt((nu + 1) * (1 - theta) / (1 + theta))), np.array(nu + 1)))
        return t, t
    return 0.0, 0.0


def joint_exceedance(name: str, u: float, v: float, theta: float) -> tuple[float, float]:
    """P(U > u or V > v) and P(U > u and V > v)."""
    c = float(copula_cdf(name, u, v, theta))
    return 1 - c, 1 - u - v + c


def fit_copula(name: str, u, v) -> float:
    """Maximum pseudo-likelihood of the dependence parameter."""
    lo, hi = COPULAS.get(name, (None, (-0.999, 0.999)))[1]
    return golden(lambda t: -float(copula_log_pdf(name, u, v, t if abs(t) > 1e-6 else 1e-6).sum()), lo, hi, 1e-8)


def fit_copula_full(name: str, start: Sequence[float], loglik: Callable) -> np.ndarray:
    """Dependence and margins together, by simplex search."""
    return nelder_mead(lambda p: -loglik(name, p), np.asarray(start, float)).x


def t_cdf(z, corr: np.ndarray, nu: float, points: int = 64, n: int = 8000, seed: int = 1) -> float:
    """P(all T <= z) of a standard multivariate t: normal probabilities at z times the quantiles of sqrt(chi-squared / nu)."""
    from ..operators.probability import multivariate_normal_cdf

    nodes, weights = np.polynomial.legendre.leggauss(points)
    s = np.sqrt(2 * S.gamma_p_inverse(np.full(points, nu / 2), (nodes + 1) / 2) / nu)
    return float(sum(w / 2 * multivariate_normal_cdf(np.asarray(z, float) * c, corr, n, seed) for w, c in zip(weights, s, strict=True)))


def normal_inverse_cdf(p, mean, cov) -> np.ndarray:
    """A point from probabilities, axis by axis: each one given the axes before it (Cholesky's factor)."""
    return np.asarray(mean, float) + S.normal_quantile(np.atleast_2d(p)) @ np.linalg.cholesky(cov).T


def normal_interval(lo, hi, mean, cov) -> float:
    """Probability of a box, by inclusion and exclusion of its corners."""
    from itertools import product

    from ..operators.probability import multivariate_normal_cdf

    mean, cov = np.asarray(mean, float), np.asarray(cov, float)
    sd = np.sqrt(np.diag(cov))
    corr = cov / np.outer(sd, sd)
    a, b = (np.asarray(lo, float) - mean) / sd, (np.asarray(hi, float) - mean) / sd
    total = 0.0
    for pick in product((0, 1), repeat=len(mean)):
        z = np.where(pick, a, b)
        total += (-1) ** sum(pick) * (float(S.normal_cdf(z[0])) if len(z) == 1 else multivariate_normal_cdf(z, corr))
    return total


def marginal(mean, cov, axes: Sequence[int]) -> tuple[np.ndarray, np.ndarray]:
    """Mean and covariance of some axes."""
    k = list(axes)
    return np.asarray(mean, float)[k], np.asarray(cov, float)[np.ix_(k, k)]


def validate_normal(mean, cov) -> str:
    """What is wrong with the parameters; empty if nothing is."""
    mean, cov = np.asarray(mean, float), np.asarray(cov, float)
    if cov.shape != (len(mean), len(mean)):
        return "the covariance must have as many rows and columns as the mean"
    if not np.isfinite(mean).all() or not np.isfinite(cov).all():
        return "all parameters must be finite"
    if not np.allclose(cov, cov.T):
        return "the covariance must be symmetric"
    try:
        np.linalg.cholesky(cov)
    except np.linalg.LinAlgError:
        return "the covariance must be positive definite"
    return ""


def normal_latin_hypercube(mean, cov, n: int, seed: int = 1) -> np.ndarray:
    """Samples whose uniforms fall one into each of n strata of every axis."""
    from ..operators.sampling import latin_hypercube

    return normal_inverse_cdf(latin_hypercube(n, len(mean), seed), mean, cov)


def log_survival(cdf: float) -> tuple[float, float, float]:
    """Logarithm of a probability, its complement, and that one's logarithm; minus infinity at 0."""
    safe = lambda p: math.log(p) if p > 0 else -math.inf
    return safe(cdf), 1 - cdf, safe(1 - cdf)


def bivariate_empirical_cdf(x: Sequence[float], y: Sequence[float], table, u, v) -> np.ndarray:
    """Joint probability from a table on a grid, by bilinear lookup; clamped at the edges."""
    from ..operators.curves import bilinear

    return np.clip(bilinear(x, y, table, u, v), 0, 1)


def bivariate_empirical_pdf(x: Sequence[float], y: Sequence[float], table, u: float, v: float) -> float:
    """Mass of the cell around a point over the cell's area; 0 outside."""
    x, y, t = (np.asarray(a, float) for a in (x, y, table))
    if not (x[0] <= u <= x[-1] and y[0] <= v <= y[-1]):
        return 0.0
    i, j = (int(np.clip(np.searchsorted(a, w, "right") - 1, 0, len(a) - 2)) for a, w in ((x, u), (y, v)))
    return float((t[i + 1, j + 1] - t[i, j + 1] - t[i + 1, j] + t[i, j]) / ((x[i + 1] - x[i]) * (y[j + 1] - y[j])))


def multinomial_covariance(n: int, p) -> np.ndarray:
    p = np.asarray(p, float)
    return n * (np.diag(p) - np.outer(p, p))


def multinomial_sample(n: int, p, size: int, seed: int = 1) -> np.ndarray:
    return np.random.default_rng(seed).multinomial(n, p, size)


def dirichlet_sample(a, size: int, seed: int = 1) -> np.ndarray:
    return np.random.default_rng(seed).dirichlet(a, size)


#: Generators of Archimedean copulas and their inverses.
GENERATORS: dict[str, tuple[Callable, Callable]] = {
    "clayton": (lambda t, a: (t**-a - 1) / a, lambda s, a: (1 + a * s) ** (-1 / a)),
    "gumbel": (lambda t, a: (-np.log(t)) ** a, lambda s, a: np.exp(-(s ** (1 / a)))),
    "frank": (lambda t, a: -np.log(np.expm1(-a * t) / np.expm1(-a)), lambda s, a: -np.log1p(np.exp(-s) * np.expm1(-a)) / a),
    "joe": (lambda t, a: -np.log1p(-((1 - t) ** a)), lambda s, a: 1 - (-np.expm1(-s)) ** (1 / a)),
    "ali_mikhail_haq": (lambda t, a: np.log((1 - a * (1 - t)) / t), lambda s, a: (1 - a) / (np.exp(s) - a)),
}


def generator(name: str, t, theta: float) -> np.ndarray:
    return GENERATORS[name][0](np.asarray(t, float), theta)


def generator_inverse(name: str, s, theta: float) -> np.ndarray:
    return GENERATORS[name][1](np.asarray(s, float), theta)


def generator_slopes(name: str, t, theta: float, h: float = 1e-5) -> tuple[np.ndarray, np.ndarray]:
    """First and second derivative of the generator."""
    t = np.asarray(t, float)
    f = GENERATORS[name][0]
    return (f(t + h, theta) - f(t - h, theta)) / (2 * h), (f(t + h, theta) - 2 * f(t, theta) + f(t - h, theta)) / (h * h)


def archimedean_cdf(name: str, u, v, theta: float) -> np.ndarray:
    """The copula from its generator alone."""
    return generator_inverse(name, generator(name, u, theta) + generator(name, v, theta), theta)


def copula_inverse(name: str, u, w, theta: float, nu: float = 4.0) -> np.ndarray:
    """The v whose probability given u is w."""
    u, w = np.asarray(u, float), np.asarray(w, float)
    if name == "normal":
        return S.normal_cdf(theta * S.normal_quantile(u) + math.sqrt(1 - theta * theta) * S.normal_quantile(w))
    if name == "student_t":
        x = S.t_quantile(u, nu)
        spread = np.sqrt((nu + x * x) * (1 - theta * theta) / (nu + 1))
        return S.t_cdf(theta * x + spread * S.t_quantile(w, nu + 1), np.full(np.shape(u), nu))
    if name == "clayton":
        return (u**-theta * (w ** (-theta / (1 + theta)) - 1) + 1) ** (-1 / theta)
    h = 1e-6
    a, b = np.minimum(u + h, 1 - 1e-12), np.maximum(u - h, 1e-12)
    return S.bisect(lambda v: (copula_cdf(name, a, v, theta) - copula_cdf(name, b, v, theta)) / (a - b) - w, np.full(np.shape(u), 1e-12), np.full(np.shape(u), 1 - 1e-12), 60)


def student_copula_cdf(u: float, v: float, rho: float, nu: float) -> float:
    z = S.t_quantile(np.array([u, v]), nu)
    return t_cdf(z, np.array([[1, rho], [rho, 1]]), nu)


def pseudo_observations(x) -> np.ndarray:
    """Ranks over n + 1, ties at their mean rank."""
    x = np.asarray(x, float)
    _, at, n = np.unique(x, return_inverse=True, return_counts=True)
    last = np.cumsum(n)
    return ((last - (n - 1) / 2)[at]) / (len(x) + 1)


def pseudo_log_likelihood(name: str, x, y, theta: float, nu: float = 4.0) -> float:
    return float(copula_log_pdf(name, pseudo_observations(x), pseudo_observations(y), theta, nu).sum())


def margins_log_likelihood(name: str, x, y, theta: float, first: tuple[str, Sequence[float]], second: tuple[str, Sequence[float]], full: bool = False) -> float:
    """Copula likelihood at fitted margins; ``full`` adds the margins' own densities."""
    from .distributions import evaluate

    u, v = evaluate(first[0], "cdf", x, first[1]), evaluate(second[0], "cdf", y, second[1])
    total = float(copula_log_pdf(name, u, v, theta).sum())
    if full:
        total += float(evaluate(first[0], "log_pdf", x, first[1]).sum() + evaluate(second[0], "log_pdf", y, second[1]).sum())
    return total
