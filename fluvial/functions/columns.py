"""Special functions as Column expressions, and p-values as Arrow-batched kernels."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import special

# Rational approximation of the normal tail by J. F. Hart, as published by G. West (2005).
_TAIL_P = (0.0352624965998911, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376)
_TAIL_Q = (0.0883883476483184, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752)


def _horner(x: Column, coefficients) -> Column:
    out = F.lit(coefficients[0])
    for c in coefficients[1:]:
        out = out * x + c
    return out


def normal_cdf(z: Column) -> Column:
    """Standard normal probability, to double precision within 7 of zero; stays in generated code."""
    a = F.abs(z)
    e = F.exp(-a * a / 2)
    near = e * _horner(a, _TAIL_P) / _horner(a, _TAIL_Q)
    far = e / (a + 1 / (a + 2 / (a + 3 / (a + 4 / (a + 0.65))))) / 2.506628274631
    tail = F.when(a > 37, 0.0).when(a < 7.07106781186547, near).otherwise(far)
    return F.when(z > 0, 1 - tail).otherwise(tail)


def normal_pdf(z: Column) -> Column:
    return F.exp(-z * z / 2) / 2.5066282746310002


# Coefficients of algorithm AS 241 (M. J. Wichura, 1988), highest power first.
_A = (2509.0809287301226727, 33430.575583588128105, 67265.770927008700853, 45921.953931549871457, 13731.693765509461125, 1971.5909503065514427, 133.14166789178437745, 3.387132872796366608)
_B = (5226.495278852545925, 28729.085735721942674, 39307.89580009271061, 21213.794301586595867, 5394.1960214247511077, 687.1870074920579083, 42.313330701600911252, 1.0)
_C = (7.7454501427834140764e-4, 0.0227238449892691845833, 0.24178072517745061177, 1.27045825245236838258, 3.64784832476320460504, 5.7694972214606914055, 4.6303378461565452959, 1.42343711074968357734)
_D = (1.05075007164441684324e-9, 5.475938084995344946e-4, 0.0151986665636164571966, 0.14810397642748007459, 0.68976733498510000455, 1.6763848301838038494, 2.05319162663775882187, 1.0)
_E = (2.01033439929228813265e-7, 2.71155556874348757815e-5, 0.0012426609473880784386, 0.026532189526576123093, 0.29656057182850489123, 1.7848265399172913358, 5.4637849111641143699, 6.6579046435011037772)
_F = (2.04426310338993978564e-15, 1.4215117583164458887e-7, 1.8463183175100546818e-5, 7.868691311456132591e-4, 0.0148753612908506148525, 0.13692988092273580531, 0.59983220655588793769, 1.0)


def normal_quantile(p: Column) -> Column:
    """Standard normal quantile; null outside (0, 1)."""
    q = p - 0.5
    r = 0.180625 - q * q
    mid = q * _horner(r, _A) / _horner(r, _B)
    t = F.sqrt(-F.ln(F.least(p, 1 - p)))
    near, far = t - 1.6, t - 5.0
    tail = F.when(t <= 5, _horner(near, _C) / _horner(near, _D)).otherwise(_horner(far, _E) / _horner(far, _F))
    return F.when((p <= 0) | (p >= 1), None).when(F.abs(q) <= 0.425, mid).otherwise(F.when(q < 0, -tail).otherwise(tail))


def _kernel(f):
    @F.pandas_udf("double")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(f(a.to_numpy(float), b.to_numpy(float)))

    return run


def t_two_sided(t: Column, df: Column) -> Column:
    """Two-sided p of Student's t."""
    return _kernel(special.t_two_sided)(t, df.cast("double"))


def chi_squared_upper(x: Column, df: Column) -> Column:
    """Upper tail of chi-squared."""
    return _kernel(lambda x, k: special.gamma_q(k / 2, x / 2))(x, df.cast("double"))


def f_two_sided(f: Column, dfn: Column, dfd: Column) -> Column:
    """Two-sided p of a variance ratio."""

    @F.pandas_udf("double")
    def run(f: pd.Series, n: pd.Series, d: pd.Series) -> pd.Series:
        x, a, b = f.to_numpy(float), n.to_numpy(float), d.to_numpy(float)
        upper = special.beta_i(b / 2, a / 2, b / (b + a * x))
        return pd.Series(2 * special.np.minimum(upper, 1 - upper))

    return run(f, dfn, dfd)


def f_upper(f: Column, dfn: Column, dfd: Column) -> Column:
    """Upper tail of a variance ratio."""

    @F.pandas_udf("double")
    def run(f: pd.Series, n: pd.Series, d: pd.Series) -> pd.Series:
        x, a, b = f.to_numpy(float), n.to_numpy(float), d.to_numpy(float)
        return pd.Series(special.beta_i(b / 2, a / 2, b / (b + a * x)))

    return run(f, dfn.cast("double"), dfd.cast("double"))


def box_cox(x: Column, lam: float) -> Column:
    return F.ln(x) if lam == 0 else (F.pow(x, F.lit(lam)) - 1) / lam


def box_cox_inverse(y: Column, lam: float) -> Column:
    return F.exp(y) if lam == 0 else F.pow(y * lam + 1, F.lit(1 / lam))


def yeo_johnson(x: Column, lam: float) -> Column:
    up = F.log1p(x) if lam == 0 else (F.pow(x + 1, F.lit(lam)) - 1) / lam
    down = -F.log1p(-x) if lam == 2 else -(F.pow(1 - x, F.lit(2 - lam)) - 1) / (2 - lam)
    return F.when(x >= 0, up).otherwise(down)


def yeo_johnson_inverse(y: Column, lam: float) -> Column:
    up = F.expm1(y) if lam == 0 else F.pow(y * lam + 1, F.lit(1 / lam)) - 1
    down = -F.expm1(-y) if lam == 2 else 1 - F.pow(1 - (2 - lam) * y, F.lit(1 / (2 - lam)))
    return F.when(y >= 0, up).otherwise(down)


#: Link functions: name -> (link, inverse, derivative of the link).
LINKS = {
    "identity": (lambda x: x, lambda e: e, lambda x: F.lit(1.0)),
    "log": (lambda x: F.ln(F.greatest(x, F.lit(1e-12))), F.exp, lambda x: 1 / x),
    "logit": (lambda x: F.ln(x / (1 - x)), lambda e: F.when(e >= 0, 1 / (1 + F.exp(-e))).otherwise(F.exp(e) / (1 + F.exp(e))), lambda x: 1 / (x * (1 - x))),
    "probit": (normal_quantile, normal_cdf, lambda x: 1 / normal_pdf(normal_quantile(x))),
    "cloglog": (lambda x: F.ln(-F.ln(1 - x)), lambda e: 1 - F.exp(-F.exp(e)), lambda x: -1 / ((1 - x) * F.ln(1 - x))),
    "fisher_z": (F.atanh, F.tanh, lambda x: 1 / (1 - x * x)),
}
