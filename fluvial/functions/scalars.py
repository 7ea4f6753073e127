"""Scalar and array helpers as Column expressions; everything stays in generated code."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import columns as C

#: Values below it count as it in logarithms.
SMALL = 1e-16


def copy_sign(x: Column, y: Column) -> Column:
    """|x| with the sign of y; 0 counts as positive."""
    return F.when(y < 0, -F.abs(x)).otherwise(F.abs(x))


def is_finite(x: Column) -> Column:
    """Neither null, NaN nor infinite."""
    return F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))


def is_power_of_two(n: Column) -> Column:
    return (n > 0) & (F.bit_count(n) == 1)


def next_power_of_two(n: Column) -> Column:
    """The smallest power of two that is n or more."""
    return F.pow(F.lit(2.0), F.ceil(F.log2(F.greatest(n, F.lit(1)).cast("double")))).cast("long")


def clamp(x: Column, lo: float, hi: float) -> Column:
    return F.least(F.greatest(x, F.lit(lo)), F.lit(hi))


def floored_log(x: Column, base: float | None = None) -> Column:
    """Logarithm; values from 0 to 1e-16 count as 1e-16, negative ones give null."""
    inner = F.when(x >= 0, F.greatest(x, F.lit(SMALL)))
    return F.ln(inner) if base is None else F.log10(inner) if base == 10 else F.ln(inner) / math.log(base)


def almost_equals(a: Column, b: Column, eps: float = 1e-15) -> Column:
    return F.abs(a - b) <= eps


def add(a: Column, b: Column) -> Column:
    """Element by element; arrays must be of one length."""
    return F.zip_with(a, b, lambda x, y: x + y)


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def scale(a: Column, c: float) -> Column:
    return F.transform(a, lambda x: x * c)


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def subset(a: Column, start: int, end: int) -> Column:
    """Elements start .. end, both counted from 0 and included."""
    return F.slice(a, start + 1, end - start + 1)


def fill(c: float, n: int) -> Column:
    return F.array_repeat(F.lit(float(c)), n)


def distance(a: Column, b: Column) -> Column:
    """Euclidean distance of two arrays."""
    return F.sqrt(total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y))))


def weighted_distance(a: Column, b: Column, w: Column) -> Column:
    return F.sqrt(total(F.zip_with(w, F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), lambda u, d: u * d)))


def normalised_distance(a: Column, b: Column, lo: Column, hi: Column) -> Column:
    """Each axis divided by its range; an axis without range counts nothing."""
    part = F.zip_with(F.zip_with(a, b, lambda x, y: x - y), F.zip_with(lo, hi, lambda x, y: y - x), lambda d, r: F.when(r != 0, (d / r) * (d / r)).otherwise(0.0))
    return F.sqrt(total(part))


def log_sum_exp(a: Column) -> Column:
    """Stable logarithm of the sum of exponentials of an array."""
    top = F.array_max(a)
    return top + F.ln(F.aggregate(a, F.lit(0.0), lambda s, x: s + F.exp(x - top)))


def linear_function(x: Column, alpha: float, beta: float, sigma: float = 0.0, level: float | None = None, lo: float = -math.inf, hi: float = math.inf) -> Column:
    """alpha + beta x, moved by a normal error's quantile at ``level``, clamped."""
    from .special import normal_quantile

    shift = sigma * float(normal_quantile(level)) if level is not None and sigma > 0 else 0.0
    return F.greatest(F.least(alpha + beta * x + shift, F.lit(hi)), F.lit(lo))


def linear_inverse(y: Column, alpha: float, beta: float, sigma: float = 0.0, level: float | None = None) -> Column:
    from .special import normal_quantile

    shift = sigma * float(normal_quantile(level)) if level is not None and sigma > 0 else 0.0
    return (y - alpha - shift) / beta


def power_function(x: Column, alpha: float, beta: float, xi: float = 0.0, sigma: float = 0.0, level: float | None = None) -> Column:
    """alpha (x - xi)**beta with a normal error of its logarithm; x at or below xi counts as just above it."""
    from .special import normal_quantile

    shift = sigma * float(normal_quantile(level)) if level is not None and sigma > 0 else 0.0
    return F.exp(math.log(alpha) + beta * F.ln(F.greatest(x - xi, F.lit(SMALL))) + shift)


def power_inverse(y: Column, alpha: float, beta: float, xi: float = 0.0, sigma: float = 0.0, level: float | None = None) -> Column:
    from .special import normal_quantile

    shift = sigma * float(normal_quantile(level)) if level is not None and sigma > 0 else 0.0
    return F.exp((F.ln(y) - math.log(alpha) - shift) / beta) + xi


def yeo_johnson_derivative(x: Column, lam: float) -> Column:
    return F.when(x >= 0, F.pow(x + 1, F.lit(lam - 1))).otherwise(F.pow(1 - x, F.lit(1 - lam)))


def yeo_johnson_link(lam: float) -> tuple[Callable, Callable, Callable]:
    """Link, inverse and derivative for a power between -5 and 5."""
    if not -5 <= lam <= 5:
        raise ValueError("the power must be between -5 and 5")
    return lambda x: C.yeo_johnson(x, lam), lambda e: C.yeo_johnson_inverse(e, lam), lambda x: yeo_johnson_derivative(x, lam)


def link(name: str, lam: float | None = None) -> tuple[Callable, Callable, Callable]:
    """Link, inverse and derivative by name; yeo_johnson takes its power."""
    if name == "yeo_johnson":
        return yeo_johnson_link(1.0 if lam is None else lam)
    return C.LINKS[name]


class LinkController:
    """One link for each parameter of a vector; parameters beyond the list keep theirs."""

    def __init__(self, links: Sequence[str | tuple[Callable, Callable, Callable]]):
        self.links = [link(x) if isinstance(x, str) else x for x in links]

    @classmethod
    def for_location_scale_shape(cls) -> LinkController:
        return cls(["identity", "log", "identity"])

    def _map(self, v: Column, size: int, k: int, identity: Callable) -> Column:
        return F.array(*((self.links[i][k] if i < len(self.links) else identity)(F.element_at(v, i + 1)) for i in range(size)))

    def forward(self, v: Column, size: int) -> Column:
        return self._map(v, size, 0, lambda x: x)

    def inverse(self, v: Column, size: int) -> Column:
        return self._map(v, size, 1, lambda x: x)

    def jacobian(self, v: Column, size: int) -> Column:
        """Diagonal of the derivatives of the links."""
        return self._map(v, size, 2, lambda x: F.lit(1.0))

    def log_determinant(self, v: Column, size: int) -> Column:
        return F.aggregate(self.jacobian(v, size), F.lit(0.0), lambda s, x: s + F.ln(F.abs(x)))
