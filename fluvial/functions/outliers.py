"""Low outliers by the multiple Grubbs-Beck test.

After T. A. Cohn, J. F. England, C. E. Berenbrock, R. R. Mason, J. R. Stedinger
and J. R. Lamontagne, "A generalized Grubbs-Beck test statistic for detecting
multiple potentially influential low outliers in flood series", Water Resources
Research 49 (2013), 5047-5058.
"""

from __future__ import annotations

from math import comb

import numpy as np

from . import special as S

#: Fixed values of the test: levels of the outward sweep, of the inward sweep from its result and of the inward sweep from the smallest value; the largest share tested; the least sample.
OUTWARD, INWARD, FROM_ZERO, SHARE, LEAST = 0.005, 0.0, 0.1, 0.5, 10
#: Logarithms are taken of values no smaller than this.
TINY = 1e-88


def moments_above(z: np.ndarray) -> np.ndarray:
    """Mean and second to fourth central moments of a normal value given that it is over z (first axis of four).

    Integration by parts gives E[X^k] = (k - 1) E[X^(k-2)] + z^(k-1) h(z) with
    the hazard h; central moments are their binomial transform.
    """
    hazard = S.normal_pdf(z) / S.normal_cdf(-z)
    raw = [np.ones_like(z), hazard]
    for k in (2, 3, 4):
        raw.append((k - 1) * raw[k - 2] + z ** (k - 1) * hazard)
    central = [sum(comb(k, j) * raw[j] * (-hazard) ** (k - j) for j in range(k + 1)) for k in (2, 3, 4)]
    return np.array([hazard, *central])


def noncentral_t_tail(q: np.ndarray, df: np.ndarray, shift: np.ndarray, points: int = 80) -> np.ndarray:
    """P(T > q) of noncentral t values: the normal tail given the scale s = sqrt(chi2 / df), integrated where s has its mass (9 deviations)."""
    nodes, weights = np.polynomial.legendre.leggauss(points)
    reach = 9 / np.sqrt(2 * df)
    low, high = np.maximum(0.0, 1 - reach), 1 + reach + 4 / df
    s = (low + high)[..., None] / 2 + (high - low)[..., None] / 2 * nodes
    half = df[..., None] / 2
    density = np.exp(np.log(2.0) + half * np.log(half) - S.log_gamma(half) + (2 * half - 1) * np.log(s) - half * s**2)
    mass = weights * density
    return (mass * S.normal_cdf(shift[..., None] - q[..., None] * s)).sum(-1) / mass.sum(-1)


def p_values(omega: np.ndarray, n: int, points: int = 200) -> np.ndarray:
    """P(the statistic of the r-th smallest of n normal values is below omega[r - 1]), r = 1, 2, ...

    Given the r-th value z, whose probability is Beta(r, n + 1 - r), the m =
    n - r values above it are independent truncated normal ones. Their mean M
    and variance have a covariance matrix C by the moments; the deviation D is
    a scaled chi of that mean and variance. M less its regression on D is taken
    for normal and independent of D, so (z - M) / D is a shifted noncentral t.
    """
    r = np.arange(1, len(omega) + 1)[:, None]
    m = n - r
    nodes, weights = np.polynomial.legendre.leggauss(points)
    centre, width = r / (n + 1), 12 * np.sqrt(r * m + r) / ((n + 1) * np.sqrt(n + 2))
    low, high = np.maximum(centre - width, 0.0), np.minimum(centre + width, 1.0)
    share = low + (high - low) * (nodes + 1) / 2
    mass = weights * np.exp((r - 1) * np.log(share) + m * np.log1p(-share) - np.array([[S.log_beta(float(k), float(n + 1 - k))] for k in r.ravel()]))
    z = S.normal_quantile(share)

    mean, mu2, mu3, mu4 = moments_above(z)
    cov = np.array([[mu2 / m, mu3 / np.sqrt(m * (m - 1))], [mu3 / np.sqrt(m * (m - 1)), (mu4 - mu2**2 * (m - 3) / (m - 1)) / m]])
    half_df = mu2**2 / cov[1, 1]
    deviation = np.sqrt(mu2 / half_df) * np.exp(S.log_gamma(half_df + 0.5) - S.log_gamma(half_df))
    joint = cov[0] * np.array([np.ones_like(z), 0.5 / deviation])  # Var(M) and Cov(M, D), as the variance changes by 2 D for each unit of D
    slope = joint[1] / (mu2 - deviation**2)
    rest = joint[0] - slope * joint[1]
    tail = noncentral_t_tail(-(omega[:, None] + slope) * np.sqrt(mu2 / rest), 2 * half_df, (mean - slope * deviation - z) / np.sqrt(rest))
    return (mass * tail).sum(1) / mass.sum(1)


def statistics(z: np.ndarray, most: int) -> np.ndarray:
    """(value - mean) / deviation of the values above it, for the ``most`` smallest of a sorted sample; above a run of equal values it is infinite."""
    count = np.arange(len(z), 0, -1.0)
    total, square = np.cumsum((z - z.mean())[::-1])[::-1], np.cumsum((z - z.mean())[::-1] ** 2)[::-1]
    m, s, q = count[1 : most + 1], total[1 : most + 1], square[1 : most + 1]
    var = (q - s * s / m) / (m - 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(var > 1e-14 * max(float(z.var()), 1e-300), (z[:most] - z.mean() - s / m) / np.sqrt(var), np.inf)


def multiple_grubbs_beck(x: np.ndarray) -> int:
    """How many of the smallest values are outliers: the largest result of three sweeps over the p-values of the lower half."""
    z = np.sort(np.log10(np.maximum(np.asarray(x, float), TINY)))
    most = int(len(z) * SHARE)
    if len(z) < LEAST:
        return 0
    omega = statistics(z, most)
    p = np.where(np.isfinite(omega), p_values(np.where(np.isfinite(omega), omega, 0.0), len(z)), 1.0)
    run = lambda start, level: start + int(np.argmax(np.append(p[start:] >= level, True)))  # noqa: E731  places below the level from there on
    outward = int(np.flatnonzero(p < OUTWARD).max(initial=-1)) + 1
    return max(outward, run(outward, INWARD), run(0, FROM_ZERO))
