"""Queries that run the numerical kernels over table rows, each against a closed form in SQL."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from ..functions import distributions as D
from ..functions import linalg as L
from ..functions import multivariate as M
from ..functions import optimize as O
from ..functions import special as S
from ..operators import probability as P
from .registry import query, rows_of, table


def total(expr: str, a: str, b: str, var: str = "k") -> str:
    """SQL: the sum of an expression over a <= var < b."""
    return f"coalesce(list_sum(list_transform(range({a}, {b}), lambda {var}: cast({expr} as double))), 0)"


def each(names, keys: str = "region", key: str = "r_regionkey") -> str:
    """SQL: every name with every row of a small table, as (method, r)."""
    return f"(select unnest([{', '.join(repr(n) for n in names)}]) as method, {key} as r from {keys})"


def with_methods(spark, d, names):
    """The same in Spark: (method, r)."""
    r = table(spark, d, "region").select(F.col("r_regionkey").cast("int").alias("r"))
    return r.select(F.explode(F.array(*(F.lit(n) for n in names))).alias("method"), "r")


def by_method(spark, d, methods: dict, schema: str):
    """One row (method, r, values...) for each method of a dict of functions of r."""

    def run(pdf):
        got = [(m, int(r), *methods[m](float(r))) for m, r in zip(pdf.method, pdf.r, strict=True)]
        return pd.DataFrame(got, columns=[c.split()[0] for c in f"method string, r int, {schema}".split(", ")])

    return rows_of(with_methods(spark, d, methods), run, f"method string, r int, {schema}")


# --- special functions -------------------------------------------------------------

_HALF = "(n_nationkey + 1) / 2.0"
_PHI = total("pow(-1, k) * pow(z, 2 * k + 1) / (gamma(k + 1) * (2 * k + 1))", "0", "80") + " * 2 / sqrt(pi())"


@query(f"with x as (select n_nationkey, (n_nationkey - 12) / 6.0 z from nation) select n_nationkey, round({_PHI}, 9) erf, round(1 - {_PHI}, 9) erfc, round(z, 6) back, round(z, 6) back_c from x")
def error_functions(spark, d):
    x = table(spark, d, "nation").select("n_nationkey", ((F.col("n_nationkey") - 12) / 6.0).alias("z"))

    def run(p):
        z = p.z.to_numpy()
        return pd.DataFrame({"n_nationkey": p.n_nationkey, "erf": np.round(S.erf(z), 9), "erfc": np.round(S.erfc(z), 9), "back": np.round(S.erf_inverse(S.erf(z)), 6), "back_c": np.round(S.erfc_inverse(S.erfc(z)), 6)})

    return rows_of(x, run, "n_nationkey int, erf double, erfc double, back double, back_c double")


@query(f"""with x as (select n_nationkey, n_nationkey + 1 m, {_HALF} x from nation) select n_nationkey, round(lgamma(x), 9) lg, round(gamma(x), 6) g,
round(-0.5772156649015329 + case when m % 2 = 0 then {total("1.0 / k", "1", "m // 2")} else -2 * ln(2) + {total("2.0 / (2 * k - 1)", "1", "m // 2 + 1")} end, 9) di,
round(case when m % 2 = 0 then pi() ** 2 / 6 - {total("1.0 / (k * k)", "1", "m // 2")} else pi() ** 2 / 2 - {total("4.0 / ((2 * k - 1) * (2 * k - 1))", "1", "m // 2 + 1")} end, 9) tri,
round(1 - exp(-3.5) * {total("pow(3.5, k) / gamma(k + 1)", "0", "m")}, 9) p, round(exp(-3.5) * {total("pow(3.5, k) / gamma(k + 1)", "0", "m")}, 9) q, 3.5 as back from x""")
def gamma_functions(spark, d):
    def run(p):
        m = p.n_nationkey.to_numpy() + 1.0
        x = m / 2
        c = S.gamma_p(m, 3.5)
        return pd.DataFrame({"n_nationkey": p.n_nationkey, "lg": np.round(S.log_gamma(x), 9), "g": np.round(S.gamma(x), 6), "di": np.round(S.digamma(x), 9), "tri": np.round(S.trigamma(x), 9), "p": np.round(c, 9), "q": np.round(S.gamma_q(m, 3.5), 9), "back": np.round(np.where(c > 1e-9, S.gamma_p_inverse(m, c), 3.5), 4)})

    return rows_of(table(spark, d, "nation", "n_nationkey"), run, "n_nationkey int, lg double, g double, di double, tri double, p double, q double, back double")


@query(f"""with x as (select n_nationkey, n_nationkey % 5 + 1 a, n_nationkey % 3 + 1 b, 0.05 + n_nationkey / 30.0 x from nation) select n_nationkey, round(gamma(a) * gamma(b) / gamma(a + b), 12) beta, round(lgamma(a) + lgamma(b) - lgamma(a + b), 9) log_beta,
round({total("gamma(a + b) / (gamma(k + 1) * gamma(a + b - k)) * pow(x, k) * pow(1 - x, a + b - 1 - k)", "a", "a + b")}, 9) i, round(x, 6) back from x""")
def beta_functions(spark, d):
    def run(p):
        n = p.n_nationkey.to_numpy()
        a, b, x = n % 5 + 1.0, n % 3 + 1.0, 0.05 + n / 30.0
        c = S.beta_i(a, b, x)
        return pd.DataFrame({"n_nationkey": n, "beta": np.round(S.beta(a, b), 12), "log_beta": np.round(S.log_beta(a, b), 9), "i": np.round(c, 9), "back": np.round(S.beta_i_inverse(a, b, c), 6)})

    return rows_of(table(spark, d, "nation", "n_nationkey"), run, "n_nationkey int, beta double, log_beta double, i double, back double")


_H = total("1.0 / j", "1", "k + 1", "j")
_I0, _J0 = total("pow(x * x / 4, k) / pow(gamma(k + 1), 2)", "0", "40"), total("pow(-1, k) * pow(x * x / 4, k) / pow(gamma(k + 1), 2)", "0", "40")


@query(f"""with x as (select n_nationkey, 0.25 * (n_nationkey + 1) x from nation) select n_nationkey, round({_I0}, 6) i0, round({total("pow(x / 2, 2 * k + 1) / (gamma(k + 1) * gamma(k + 2))", "0", "40")}, 6) i1, round({_J0}, 7) j0, round({total("pow(-1, k) * pow(x / 2, 2 * k + 1) / (gamma(k + 1) * gamma(k + 2))", "0", "40")}, 7) j1,
round({total("pow(-1, k) * pow(x / 2, 2 * k + 2) / (gamma(k + 1) * gamma(k + 3))", "0", "40")}, 7) j2, round(2 / pi() * (ln(x / 2) + 0.5772156649015329) * {_J0} + 2 / pi() * {total(f"pow(-1, k + 1) * {_H} * pow(x * x / 4, k) / pow(gamma(k + 1), 2)", "1", "40")}, 6) y0,
round(-(ln(x / 2) + 0.5772156649015329) * {_I0} + {total(f"{_H} * pow(x * x / 4, k) / pow(gamma(k + 1), 2)", "1", "40")}, 6) k0 from x""")
def bessel_functions(spark, d):
    def run(p):
        x = 0.25 * (p.n_nationkey.to_numpy() + 1)
        return pd.DataFrame({"n_nationkey": p.n_nationkey, "i0": np.round(S.bessel_i(0, x), 6), "i1": np.round(S.bessel_i(1, x), 6), "j0": np.round(S.bessel_j(0, x), 7), "j1": np.round(S.bessel_j(1, x), 7), "j2": np.round(S.bessel_j(2, x), 7), "y0": np.round(S.bessel_y(0, x), 6), "k0": np.round(S.bessel_k(0, x), 6)})

    return rows_of(table(spark, d, "nation", "n_nationkey"), run, "n_nationkey int, i0 double, i1 double, j0 double, j1 double, j2 double, y0 double, k0 double")


@query(f"with x as (select n_nationkey, 0.2 * (n_nationkey + 1) x from nation) select n_nationkey, round({total('x * (k + 0.5) / 2000 / (exp(x * (k + 0.5) / 2000) - 1)', '0', '2000')} / 2000, 5) debye from x")
def debye_function(spark, d):
    return rows_of(table(spark, d, "nation", "n_nationkey"), lambda p: pd.DataFrame({"n_nationkey": p.n_nationkey, "debye": np.round(S.debye(0.2 * (p.n_nationkey.to_numpy() + 1)), 5)}), "n_nationkey int, debye double")


@query("select n_nationkey, round(lgamma(n_nationkey + 1), 9) log_factorial, round(gamma(n_nationkey + 1) / (gamma(n_nationkey // 2 + 1) * gamma(n_nationkey - n_nationkey // 2 + 1)), 0) choose, 1 + 2.0 * n_nationkey - 3.0 * n_nationkey ** 2 + 0.5 * n_nationkey ** 3 as poly, cast(pow(2, n_nationkey % 6) - 1 as bigint) subsets from nation")
def factorials_and_polynomials(spark, d):
    def run(p):
        n = p.n_nationkey.to_numpy()
        return pd.DataFrame({"n_nationkey": n, "log_factorial": np.round(S.log_factorial(n), 9), "choose": S.binomial_coefficient(n, n // 2), "poly": S.polynomial([1, 2, -3, 0.5], n), "subsets": [len(P.all_subsets(int(k) % 6)) for k in n]})

    return rows_of(table(spark, d, "nation", "n_nationkey"), run, "n_nationkey int, log_factorial double, choose double, poly double, subsets long")


# --- optimisation, quadrature, roots, equations of motion ------------------------------


def _bowl(r: float):
    """Minimum of 1 at (r, 2 r)."""
    return lambda p: (p[0] - r) ** 2 + 3 * (p[1] - 2 * r) ** 2 + 1


_LO, _HI = [-3.0, -5.0], [11.0, 13.0]
_MINIMISERS = {
    "nelder_mead": lambda r: O.nelder_mead(_bowl(r), [0.5, 0.5]), "powell": lambda r: O.powell(_bowl(r), [0.5, 0.5]), "bfgs": lambda r: O.bfgs(_bowl(r), [0.5, 0.5]), "gradient_descent": lambda r: O.descend(_bowl(r), [0.5, 0.5], 0.05, adam=False), "adam": lambda r: O.descend(_bowl(r), [0.5, 0.5], 0.01),
    "differential_evolution": lambda r: O.differential_evolution(_bowl(r), _LO, _HI), "particle_swarm": lambda r: O.particle_swarm(_bowl(r), _LO, _HI), "shuffled_complexes": lambda r: O.shuffled_complexes(_bowl(r), _LO, _HI), "multi_start": lambda r: O.multi_start(_bowl(r), _LO, _HI, 5),
    "linkage_starts": lambda r: O.linkage_starts(_bowl(r), _LO, _HI), "annealing": lambda r: O.annealing(_bowl(r), _LO, _HI),
}


@query(f"select method, cast(r as int) r, cast(r as double) x, 2.0 * r as y, 1.0 as fun from {each(_MINIMISERS)}")
def minimisers(spark, d):
    def of(f):
        def run(r):
            got = f(r)
            return round(float(got.x[0]), 1) + 0.0, round(float(got.x[1]), 1) + 0.0, round(got.fun, 2)

        return run

    return by_method(spark, d, {k: of(f) for k, f in _MINIMISERS.items()}, "x double, y double, fun double")


@query(f"select method, cast(r as int) r, case method when 'maximum' then 5.0 + r when 'constrained' then (r + 1) / 2.0 when 'at_most' then least(r, 2) * 1.0 else r * 1.0 end as x from {each(['golden', 'brent', 'maximum', 'constrained', 'at_most'])}")
def line_searches_and_constraints(spark, d):
    f = lambda r: lambda x: (x - r) ** 4 + (x - r) ** 2
    methods = {
        "golden": lambda r: (round(O.golden(f(r), -4, 9), 4) + 0.0,), "brent": lambda r: (round(O.brent_minimum(f(r), -4, 9), 4) + 0.0,), "maximum": lambda r: (round(O.maximize(lambda p: 5 + r - (p[0] - 1) ** 2, O.nelder_mead, [0.3]).fun, 4),),
        "constrained": lambda r: (round(float(O.augmented_lagrange(lambda p: p[0] ** 2 + p[1] ** 2, [0.1, 0.2], equal=[lambda p: p[0] + p[1] - r - 1]).x[0]), 3) + 0.0,),
        "at_most": lambda r: (round(float(O.augmented_lagrange(lambda p: (p[0] - r) ** 2, [0.5], less=[lambda p: p[0] - 2]).x[0]), 3) + 0.0,),
    }
    return by_method(spark, d, methods, "x double")


_CUBE = lambda r: lambda x: (r + 1) * x**3 + x
_RULES = {
    "gauss": lambda r: O.quadrature(_CUBE(r), 0, 2, "gauss", 20), "simpson": lambda r: O.quadrature(_CUBE(r), 0, 2, "simpson"), "adaptive": lambda r: O.adaptive(_CUBE(r), 0, 2), "lobatto": lambda r: O.gauss_lobatto(_CUBE(r), 0, 2), "kronrod": lambda r: O.gauss_kronrod(_CUBE(r), 0, 2),
    "refined_simpson": lambda r: O.refined(_CUBE(r), 0, 2, "simpson"), "two_dimensions": lambda r: O.adaptive_2d(lambda u, v: ((r + 1) * u**3 + u) * v * 2, (0, 2), (0, 1)),
    "trapezoid": lambda r: O.quadrature(_CUBE(r), 0, 2, "trapezoid", 100), "midpoint": lambda r: O.quadrature(_CUBE(r), 0, 2, "midpoint", 100), "refined_trapezoid": lambda r: round(O.refined(_CUBE(r), 0, 2), 5),
}


@query(f"select method, cast(r as int) r, round(case method when 'trapezoid' then {total('((r + 1) * pow(0.02 * k, 3) + 0.02 * k) * case when k in (0, 100) then 0.01 else 0.02 end', '0', '101')} when 'midpoint' then {total('((r + 1) * pow(0.02 * k + 0.01, 3) + 0.02 * k + 0.01) * 0.02', '0', '100')} else 4.0 * (r + 1) + 2 end, 5) as value from {each(_RULES)}")
def quadratures(spark, d):
    return by_method(spark, d, {k: (lambda r, f=f: (round(f(r), 5),)) for k, f in _RULES.items()}, "value double")


_CHANCE = {
    "monte_carlo": lambda r: O.monte_carlo(lambda x: (r + 1) * x[:, 0] ** 3 + x[:, 1], [0, 0], [2, 1]), "stratified": lambda r: O.monte_carlo(lambda x: (r + 1) * x[:, 0] ** 3 + x[:, 1], [0, 0], [2, 1], strata=10),
    "miser": lambda r: O.miser(lambda x: (r + 1) * x[:, 0] ** 3 + x[:, 1], [0, 0], [2, 1]), "vegas": lambda r: O.vegas(lambda x: (r + 1) * x[:, 0] ** 3 + x[:, 1], [0, 0], [2, 1]),
}


@query(f"select method, cast(r as int) r, true as within_five_errors, true as small_error from {each(_CHANCE)}")
def chance_integrals(spark, d):
    """Random estimates: near the truth for their own standard errors, and errors under 2 %."""

    def of(f):
        def run(r):
            value, error = f(r)
            truth = 4 * (r + 1) + 1
            return abs(value - truth) <= 5 * error, error < 0.02 * truth

        return run

    return by_method(spark, d, {k: of(f) for k, f in _CHANCE.items()}, "within_five_errors boolean, small_error boolean")


@query(f"select method, cast(r as int) r, round(sqrt(r + 2), 8) as x from {each(['bisection', 'brent', 'secant', 'newton', 'newton_safe', 'bracketed', 'system'])}")
def root_finders(spark, d):
    f = lambda r: lambda x: x * x - r - 2
    methods = {
        "bisection": lambda r: O.bisection(f(r), 0, 10), "brent": lambda r: O.brent(f(r), 0, 10), "secant": lambda r: O.secant(f(r), 1, 2), "newton": lambda r: O.newton(f(r), 1.5, lambda x: 2 * x), "newton_safe": lambda r: O.newton_safe(f(r), lambda x: 2 * x, 0, 10),
        "bracketed": lambda r: O.brent(f(r), *O.bracket(f(r), 0.1, 0.2)), "system": lambda r: float(O.newton(lambda p: np.array([p[0] ** 2 - r - 2, p[1] - p[0]]), [1.5, 1.0])[0]),
    }
    return by_method(spark, d, {k: (lambda r, g=g: (round(g(r), 8),)) for k, g in methods.items()}, "x double")


@query(f"select method, cast(r as int) r, round(case method when 'second' then exp(0.3 * (r + 1)) * 0.09 when 'hessian' then 2.0 * (r + 1) when 'jacobian' then 3.0 * r else exp(0.3 * (r + 1)) * 0.3 end, 4) as slope from {each(['forward', 'backward', 'central', 'second', 'ridders', 'gradient', 'hessian', 'jacobian'])}")
def numerical_derivatives(spark, d):
    f = lambda x: math.exp(0.3 * x)
    methods = {
        "forward": lambda r: O.difference_quotient(f, r + 1, 1e-7, "forward"), "backward": lambda r: O.difference_quotient(f, r + 1, 1e-7, "backward"), "central": lambda r: O.difference_quotient(f, r + 1), "second": lambda r: O.difference_quotient(f, r + 1, 1e-3, "second"), "ridders": lambda r: O.ridders(f, r + 1),
        "gradient": lambda r: float(O.gradient(lambda p: f(p[0]), [r + 1])[0]), "hessian": lambda r: float(O.hessian(lambda p: (r + 1) * p[0] ** 2 + p[1], [1.0, 1.0])[0, 0]), "jacobian": lambda r: float(np.asarray(O.jacobian(lambda p: np.array([3 * r * p[0], p[1]]), np.array([1.0, 1.0])))[0, 0]),
    }
    return by_method(spark, d, {k: (lambda r, g=g: (round(g(r), 4) + 0.0,)) for k, g in methods.items()}, "slope double")


@query(f"select method, cast(r as int) r, round(case method when 'midpoint' then pow(1 - h + h * h / 2, 20) when 'classical' then pow(1 - h + h * h / 2 - h ** 3 / 6 + h ** 4 / 24, 20) else exp(-20 * h) end, 7) as y from (select *, (r + 1) / 20.0 h from {each(['midpoint', 'classical', 'doubling', 'fehlberg', 'cash_karp'])})")
def decay_equations(spark, d):
    f = lambda r: lambda t, y: -(r + 1) * y
    methods = {"midpoint": lambda r: O.runge_kutta(f(r), 0, 1.0, 1, 20, 2)[-1], "classical": lambda r: O.runge_kutta(f(r), 0, 1.0, 1, 20)[-1], "doubling": lambda r: O.runge_kutta_adaptive(f(r), 0, 1.0, 1), "fehlberg": lambda r: O.runge_kutta_pair(f(r), 0, 1.0, 1), "cash_karp": lambda r: O.runge_kutta_pair(f(r), 0, 1.0, 1, pair="cash_karp")}
    return by_method(spark, d, {k: (lambda r, g=g: (round(float(g(r)), 7),)) for k, g in methods.items()}, "y double")


# --- linear algebra -----------------------------------------------------------------


def _matrix(r: float) -> np.ndarray:
    return np.array([[4 + r, 1, 0], [1, 3, 1], [0, 1, 2 + r]])


_DET = "((4 + r) * (3 * (2 + r) - 1) - (2 + r))"
_SOLVERS = ["cholesky", "lu", "qr", "gauss_jordan", "svd", "inverse"]


@query(f"select method, cast(r as int) r, round((3 * (2 + r) - 1 - 2 * (2 + r) + 3) / {_DET}, 9) x1, round(((4 + r) * (2 * (2 + r) - 3) - (2 + r)) / {_DET}, 9) x2, round(((4 + r) * (9 - 2) - 3 + 1) / {_DET}, 9) x3 from (select method, r * 1.0 r from {each(_SOLVERS)})")
def linear_solvers(spark, d):
    b = np.array([1.0, 2.0, 3.0])
    methods = {"cholesky": lambda a: L.cholesky_solve(a, b), "lu": lambda a: L.lu_solve(a, b), "qr": lambda a: L.qr_solve(a, b), "gauss_jordan": lambda a: L.gauss_jordan(a, b)[1].ravel(), "svd": lambda a: L.svd_solve(a, b), "inverse": lambda a: L.gauss_jordan(a)[0] @ b}
    return by_method(spark, d, {k: (lambda r, g=g: tuple(round(float(v), 9) for v in g(_matrix(r)))) for k, g in methods.items()}, "x1 double, x2 double, x3 double")


@query(f"""select cast(r_regionkey as int) r, round({_DET}, 9) det, round(ln({_DET}), 9) log_det, 9.0 + 2 * r as trace, 3 as rank, 2 as rank_of_two, 1 as nullity, round((r + 5) / 2.0 + sqrt(pow((r + 1) / 2.0, 2) + 1), 9) high, round((r + 5) / 2.0 - sqrt(pow((r + 1) / 2.0, 2) + 1), 9) low,
round(pow(r + 5, 2) / (pow((r + 5) / 2.0 + sqrt(pow((r + 1) / 2.0, 2) + 1), 2) + pow((r + 5) / 2.0 - sqrt(pow((r + 1) / 2.0, 2) + 1), 2)), 9) dimensions, round((3 * (2 + r) - 1) / {_DET}, 9) corner, 0.0 as residue from (select r_regionkey, r_regionkey * 1.0 r from region)""")
def matrix_decompositions(spark, d):
    """Determinants, ranks, eigenvalues of [[3 + r, 1], [1, 2]], a corner of the inverse, and the largest error of all products of factors."""

    def run(p):
        out = []
        for r in p.r:
            a, two, flat = _matrix(r), np.array([[3.0 + r, 1], [1, 2]]), np.array([[1.0, 2, 3], [2, 4, 6], [0, 1, r]])
            w, v = L.eigen(two)
            order, low, up = L.lu(a)
            q, t = L.qr(a)
            c = np.linalg.cholesky(a)
            basis, space = L.null_space(flat), L.column_space(flat)
            errors = [low @ up - a[order], q @ t - a, c @ c.T - a, v @ np.diag(w) @ v.T - two, flat @ basis, q.T @ q - np.eye(3), space @ (space.T @ flat) - flat]
            out.append((int(r), round(L.determinant(a), 9), round(L.log_determinant(a), 9), float(np.trace(a)), L.rank(a), L.rank(flat), basis.shape[1], *(round(float(x), 9) for x in w), round(L.effective_dimensions(two), 9), round(float(L.gauss_jordan(a)[0][0, 0]), 9), round(max(float(np.abs(e).max()) for e in errors), 9)))
        return pd.DataFrame(out, columns="r det log_det trace rank rank_of_two nullity high low dimensions corner residue".split())

    return rows_of(table(spark, d, "region").select(F.col("r_regionkey").cast("int").alias("r")), run, "r int, det double, log_det double, trace double, rank int, rank_of_two int, nullity int, high double, low double, dimensions double, corner double, residue double")


_CELLS = "with a as (select n_regionkey i, n_nationkey % 5 j, sum(n_nationkey * 1.0) v from nation group by 1, 2), "


@query(_CELLS + """p as (select x.i, y.i j, sum(x.v * y.v) v from a x join a y on x.j = y.j group by 1, 2), s as (select i, j, sum(v) v from (select i, j, v from a union all select j, i, -0.5 * v from a) group by 1, 2)
select 'product' what, i, j, v from p union all select 'upper', i, j, v from p where i <= j union all select 'lower', i, j, v from p where i >= j union all select 'sum', i, j, v from s union all select 'trace', 0, 0, sum(v) from p where i = j""")
def matrix_arithmetic(spark, d):
    a = table(spark, d, "nation").groupBy(F.col("n_regionkey").alias("i"), (F.col("n_nationkey") % 5).alias("j")).agg(F.sum(F.col("n_nationkey").cast("double")).alias("v"))
    p = L.multiply(a, L.transpose(a))
    parts = {"product": p, "upper": L.triangle(p), "lower": L.triangle(p, False), "sum": L.add(a, L.transpose(a), -0.5), "trace": L.trace(p).select(F.lit(0).alias("i"), F.lit(0).alias("j"), F.col("trace").alias("v"))}
    out = None
    for name, part in parts.items():
        rows = part.select(F.lit(name).alias("what"), "i", "j", "v")
        out = rows if out is None else out.unionByName(rows)
    return out


@query("""with c as (select l_returnflag g, covar_samp(l_quantity, l_extendedprice) c01, var_samp(l_quantity) c00, var_samp(l_extendedprice) c11, corr(l_quantity, l_extendedprice) r from lineitem group by 1)
select g l_returnflag, i, j, case when i <> j then c01 when i = 'l_quantity' then c00 else c11 end as v, case when i <> j then r else 1.0 end as r from c, (select unnest(['l_quantity', 'l_extendedprice']) i), (select unnest(['l_quantity', 'l_extendedprice']) j)""")
def covariance_matrices(spark, d):
    li, xs, keys = table(spark, d, "lineitem"), ["l_quantity", "l_extendedprice"], ["l_returnflag"]
    r = L.covariance_matrix(li, xs, keys, correlation=True).withColumnRenamed("v", "r")
    return L.covariance_matrix(li, xs, keys).join(r, [*keys, "i", "j"])


@query("select cast(r_regionkey as int) r, true as definite, round(3.0 + r_regionkey, 5) high, true as floored from region")
def regularised_matrices(spark, d):
    """[[1, 2 + r], [2 + r, 1]] has eigenvalues 3 + r and -1 - r; made definite, and floored."""

    def run(p):
        out = []
        for r in p.r:
            a = np.array([[1.0, 2 + r], [2 + r, 1.0]])
            w = L.eigen(L.regularise(a))[0]
            out.append((int(r), bool(np.linalg.eigvalsh(L.make_positive_definite(a)).min() > 0), round(float(w[0]), 5), bool(0 < w[1] < 1e-6)))
        return pd.DataFrame(out, columns=["r", "definite", "high", "floored"])

    return rows_of(table(spark, d, "region").select(F.col("r_regionkey").cast("int").alias("r")), run, "r int, definite boolean, high double, floored boolean")


# --- distributions ------------------------------------------------------------------

#: Parameters and closed forms in SQL of x.
_CDFS = {
    "exponential": ([1.0, 2.0], "case when x > 1 then 1 - exp(-(x - 1) / 2.0) else 0 end"), "gumbel": ([4.0, 2.0], "exp(-exp(-(x - 4) / 2.0))"), "gev": ([4.0, 2.0, 0.1], "case when 1 - 0.1 * (x - 4) / 2.0 > 0 then exp(-pow(1 - 0.1 * (x - 4) / 2.0, 10)) else 1 end"),
    "logistic": ([4.0, 2.0], "1 / (1 + exp(-(x - 4) / 2.0))"), "generalized_logistic": ([4.0, 2.0, -0.1], "case when 1 + 0.1 * (x - 4) / 2.0 > 0 then 1 / (1 + pow(1 + 0.1 * (x - 4) / 2.0, -10)) else 0 end"), "generalized_pareto": ([1.0, 2.0, 0.1], "case when x <= 1 then 0 when 1 - 0.1 * (x - 1) / 2.0 > 0 then 1 - pow(1 - 0.1 * (x - 1) / 2.0, 10) else 1 end"),
    "kappa4": ([4.0, 2.0, 0.1, 0.2], "case when 1 - 0.1 * (x - 4) / 2.0 <= 0 then 1 else pow(greatest(1 - 0.2 * pow(1 - 0.1 * (x - 4) / 2.0, 10), 0), 5) end"), "weibull": ([5.0, 1.5], "1 - exp(-pow(x / 5.0, 1.5))"), "pareto": ([1.0, 1.5], "case when x > 1 then 1 - pow(x, -1.5) else 0 end"), "rayleigh": ([3.0], "1 - exp(-x * x / 18.0)"),
    "cauchy": ([4.0, 2.0], "atan((x - 4) / 2.0) / pi() + 0.5"), "uniform": ([2.0, 9.0], "least(greatest((x - 2) / 7.0, 0), 1)"), "triangular": ([1.0, 3.0, 10.0], "case when x <= 1 then 0 when x <= 3 then pow(x - 1, 2) / 18.0 when x < 10 then 1 - pow(10 - x, 2) / 63.0 else 1 end"), "chi_squared": ([4.0], "1 - exp(-x / 2.0) * (1 + x / 2.0)"),
    "gamma": ([2.0, 3.0], "1 - exp(-x / 2.0) * (1 + x / 2.0 + x * x / 8.0)"), "inverse_gamma": ([2.0, 3.0], "case when x > 0 then exp(-2.0 / x) * (1 + 2.0 / x + 2.0 / (x * x)) else 0 end"), "inverse_chi_squared": ([4.0, 1.5], "case when x > 0 then exp(-3.0 / x) * (1 + 3.0 / x) else 0 end"), "deterministic": ([5.0], "case when x >= 5 then 1.0 else 0 end"),
    "beta": ([2.0, 2.0], "case when x >= 1 then 1 else x * x * (3 - 2 * x) end"), "generalized_beta": ([2.0, 2.0, 0.0, 20.0], "case when x >= 20 then 1 else pow(x / 20.0, 2) * (3 - x / 10.0) end"), "pert": ([0.0, 10.0, 20.0], "10 * pow(x / 20.0, 3) - 15 * pow(x / 20.0, 4) + 6 * pow(x / 20.0, 5)"), "student_t": ([4.0, 2.0, 1.0], "atan((x - 4) / 2.0) / pi() + 0.5"), "pearson3": ([6.0, 3.4641016151377544, 1.1547005383792515], "1 - exp(-x / 2.0) * (1 + x / 2.0 + x * x / 8.0)"),
}
_PDFS = {
    "normal": ([4.0, 2.0], "exp(-pow((x - 4) / 2.0, 2) / 2) / (2 * sqrt(2 * pi()))"), "ln_normal": ([1.0, 0.5], "case when x > 0 then exp(-pow((ln(x) - 1) / 0.5, 2) / 2) / (0.5 * x * sqrt(2 * pi())) else 0 end"), "log_normal": ([0.5, 0.25], "case when x > 0 then exp(-pow((log10(x) - 0.5) / 0.25, 2) / 2) / (0.25 * ln(10) * x * sqrt(2 * pi())) else 0 end"),
    "exponential": ([1.0, 2.0], "case when x >= 1 then exp(-(x - 1) / 2.0) / 2 else 0 end"), "gumbel": ([4.0, 2.0], "exp(-(x - 4) / 2.0 - exp(-(x - 4) / 2.0)) / 2"), "gamma": ([2.0, 3.0], "x * x * exp(-x / 2.0) / 16"), "weibull": ([5.0, 1.5], "1.5 / 5 * sqrt(x / 5.0) * exp(-pow(x / 5.0, 1.5))"), "cauchy": ([4.0, 2.0], "1 / (2 * pi() * (1 + pow((x - 4) / 2.0, 2)))"),
    "student_t": ([4.0, 2.0, 3.0], "gamma(2) / (2 * sqrt(3 * pi()) * gamma(1.5)) * pow(1 + pow((x - 4) / 2.0, 2) / 3, -2)"), "generalized_normal": ([4.0, 2.0, 0.1], "case when 1 - 0.05 * (x - 4) > 0 then exp(-pow(ln(1 - 0.05 * (x - 4)) / 0.1, 2) / 2) / (2 * sqrt(2 * pi()) * (1 - 0.05 * (x - 4))) else 0 end"), "logistic": ([4.0, 2.0], "exp(-(x - 4) / 2.0) / (2 * pow(1 + exp(-(x - 4) / 2.0), 2))"),
    "uniform": ([2.0, 9.0], "case when x between 2 and 9 then 1 / 7.0 else 0 end"), "rayleigh": ([3.0], "x / 9.0 * exp(-x * x / 18.0)"), "pareto": ([1.0, 1.5], "case when x >= 1 then 1.5 * pow(x, -2.5) else 0 end"), "von_mises": ([0.5, 0.0], "1 / (2 * pi())"), "deterministic": ([5.0], "case when x = 5 then 1.0 else 0 end"), "log_pearson3": ([0.6, 0.34641016151377544, 1.1547005383792515], "case when x > 1 then pow(log10(x), 2) * exp(-log10(x) / 0.2) / (2 * pow(0.2, 3)) / (x * ln(10)) else 0 end"),
}
_PMFS = {
    "binomial": ([0.3, 12.0], "case when k <= 12 then gamma(13) / (gamma(k + 1) * gamma(13 - k)) * pow(0.3, k) * pow(0.7, 12 - k) else 0 end"), "poisson": ([4.0], "exp(-4) * pow(4, k) / gamma(k + 1)"), "geometric": ([0.25], "0.25 * pow(0.75, k)"), "uniform_discrete": ([2.0, 8.0], "case when k between 2 and 8 then 1 / 7.0 else 0 end"), "bernoulli": ([0.3], "case k when 0 then 0.7 when 1 then 0.3 else 0 end"),
}


def _forms(table_sql: str, forms: dict, what: str, places: int) -> str:
    return " union all ".join(f"select '{n}' as dist, key, round({sql}, {places}) as {what} from ({table_sql})" for n, (_, sql) in forms.items())


def _evaluated(rows, forms: dict, what: str, out: str, places: int):
    made = None
    for n, (params, _) in forms.items():
        part = rows.select(F.lit(n).alias("dist"), "key", F.round(D.apply(what, F.col("x"), n, params), places).alias(out))
        made = part if made is None else made.unionByName(part)
    return made


_XS = "select n_nationkey as key, 0.35 + 0.7 * n_nationkey as x from nation"


@query(_forms(_XS, _CDFS, "probability", 9))
def family_probabilities(spark, d):
    x = table(spark, d, "nation").select(F.col("n_nationkey").alias("key"), (F.lit(0.35) + 0.7 * F.col("n_nationkey")).alias("x"))
    return _evaluated(x, _CDFS, "cdf", "probability", 9)


@query(_forms(_XS, _PDFS, "density", 6))
def family_densities(spark, d):
    x = table(spark, d, "nation").select(F.col("n_nationkey").alias("key"), (F.lit(0.35) + 0.7 * F.col("n_nationkey")).alias("x"))
    return _evaluated(x, _PDFS, "pdf", "density", 6)


@query(" union all ".join(f"select '{n}' as dist, k as key, round({sql}, 9) as mass, round({total(sql.replace('k', 'j'), '0', 'k + 1', 'j')}, 9) as probability from (select n_nationkey k from nation where n_nationkey <= 12)" for n, (_, sql) in _PMFS.items() if n != "bernoulli") + " union all select 'bernoulli', n_nationkey, case n_nationkey when 0 then 0.7 when 1 then 0.3 else 0 end, case n_nationkey when 0 then 0.7 else 1.0 end from nation where n_nationkey <= 12")
def discrete_families(spark, d):
    k = table(spark, d, "nation").where("n_nationkey <= 12").select(F.col("n_nationkey").alias("key"), F.col("n_nationkey").cast("double").alias("x"))
    made = None
    for n, (params, _) in _PMFS.items():
        top = F.col("x") <= 12 if n == "binomial" else F.lit(True)
        part = k.select(F.lit(n).alias("dist"), "key", F.round(F.when(top & ((F.lit(n) != "bernoulli") | (F.col("x") <= 1)), D.apply("pdf", F.col("x"), n, params)).otherwise(0.0), 9).alias("mass"), F.round(D.apply("cdf", F.col("x"), n, params), 9).alias("probability"))
        made = part if made is None else made.unionByName(part)
    return made


_ROUND = [("normal", [0.0, 1.0]), ("ln_normal", [1.0, 0.4]), ("log_normal", [1.0, 0.2]), ("gumbel", [10.0, 2.0]), ("gev", [10.0, 2.0, 0.1]), ("generalized_logistic", [10.0, 2.0, -0.1]), ("logistic", [1.0, 2.0]), ("generalized_normal", [10.0, 2.0, 0.2]), ("generalized_pareto", [1.0, 2.0, 0.1]), ("pearson3", [10.0, 2.0, 0.5]), ("log_pearson3", [1.0, 0.2, -0.3]), ("weibull", [2.0, 1.5]), ("gamma", [2.0, 3.0]), ("inverse_gamma", [2.0, 3.0]), ("chi_squared", [5.0]), ("inverse_chi_squared", [5.0, 1.0]), ("exponential", [1.0, 2.0]), ("kappa4", [4.0, 2.0, 0.1, 0.2]), ("pareto", [1.0, 2.0]), ("rayleigh", [2.0]), ("cauchy", [1.0, 2.0]), ("student_t", [0.0, 1.0, 5.0]), ("noncentral_t", [6.0, 1.0]), ("beta", [2.0, 3.0]), ("generalized_beta", [2.0, 3.0, 1.0, 5.0]), ("pert", [1.0, 3.0, 8.0]), ("triangular", [1.0, 3.0, 8.0]), ("uniform", [1.0, 3.0]), ("truncated_normal", [0.0, 1.0, -1.0, 2.0]), ("von_mises", [0.2, 1.5])]


@query("select dist, round(k / 10.0, 1) as p, round(k / 10.0, 5) as back from (select unnest([" + ", ".join(f"'{n}'" for n, _ in _ROUND) + "]) dist), (select unnest(range(1, 10)) k)")
def family_round_trips(spark, d):
    """Quantiles of every continuous family, and back."""
    df = spark.createDataFrame(_ROUND, "dist string, params array<double>").select("*", F.explode(F.array(*(F.lit(k / 10) for k in range(1, 10)))).alias("p"))
    df = df.withColumn("q", D.apply("quantile", F.col("p"), F.col("dist"), F.col("params")))
    return df.select("dist", F.round("p", 1).alias("p"), F.round(D.apply("cdf", F.col("q"), F.col("dist"), F.col("params")), 5).alias("back"))


_LOGS = "with x as (select n_nationkey as key, 0.5 + 0.7 * n_nationkey as x from nation), f as (select key, x, 1 - exp(-pow(x / 5.0, 1.5)) f, 1.5 / 5 * sqrt(x / 5.0) * exp(-pow(x / 5.0, 1.5)) g from x) "


@query(_LOGS + "select key, round(ln(g), 8) log_pdf, round(ln(f), 8) log_cdf, round(1 - f, 8) ccdf, round(-pow(x / 5.0, 1.5), 8) log_ccdf, round(g / (1 - f), 6) hazard from f where key <= 20")
def log_and_survival_forms(spark, d):
    x = table(spark, d, "nation").where("n_nationkey <= 20").select(F.col("n_nationkey").alias("key"), (F.lit(0.5) + 0.7 * F.col("n_nationkey")).alias("x"))
    return x.select("key", *(F.round(D.apply(w, F.col("x"), "weibull", [5.0, 1.5]), 6 if w == "hazard" else 8).alias(w) for w in ("log_pdf", "log_cdf", "ccdf", "log_ccdf", "hazard")))


@query("""with x as (select o_orderpriority g, o_totalprice / 1e5 x, case o_orderkey % 3 when 0 then 'exact' when 1 then 'left' else 'right' end kind from orders) select g o_orderpriority, sum(case kind when 'exact' then -ln(2) - x / 2 when 'left' then ln(1 - exp(-x / 2)) else -x / 2 end) loglik from x group by 1""")
def censored_likelihoods(spark, d):
    o = table(spark, d, "orders").select("o_orderpriority", (F.col("o_totalprice") / 1e5).alias("x"), F.expr("case o_orderkey % 3 when 0 then 'exact' when 1 then 'left' else 'right' end").alias("kind"))
    return D.censored_log_likelihood(o, "x", "kind", "exponential", [0.0, 2.0], ["o_orderpriority"])


@query("""with r as (select r_regionkey r, r_regionkey + 1.0 as a from region) select cast(r as int) r, round(a + 2, 4) mean, 2.0 as sd, round(a + 1 / (1 - exp(-1)) * (2 - 2 * exp(-1) - 2 * exp(-1)), 4) between_mean, round(a + 2 * (1 + ln(20)), 3) shortfall, round(1 - exp(-1), 6) graph_end,
round(ln(1 - exp(-0.5)) - 1.5 - ln(2) - 0.25 + ln(exp(-0.5) - exp(-1)), 6) loglik, '' as problem, 'alpha must be positive' as bad from r""")
def distribution_utilities(spark, d):
    """Of a shifted exponential: moments, moments between two limits, shortfall, curve tables, mixed censoring, checks of parameters."""

    def run(p):
        out = []
        for r in p.r:
            par = [r + 1.0, 2.0]
            m = D.moments("exponential", par, 400_000)
            g = D.graph("exponential", par, "cdf", 1000, 0.0, 1 - math.exp(-1))
            ll = D.log_likelihood("exponential", par, exact=[r + 1.5], left=[r + 2.0], right=[r + 4.0], between=[(r + 2.0, r + 3.0)])
            out.append((int(r), round(m[0], 2) if abs(m[0] - r - 3) < 1e-3 else m[0], round(m[1], 1), round(D.conditional_moments("exponential", par, r + 1.0, r + 3.0)[0], 4), round(D.expected_shortfall("exponential", par, 0.95), 3), round(float(g[-1, 1]), 6), round(ll, 6), D.validate("exponential", par), D.validate("exponential", [0.0, -1.0])))
        return pd.DataFrame(out, columns="r mean sd between_mean shortfall graph_end loglik problem bad".split())

    return rows_of(table(spark, d, "region").select(F.col("r_regionkey").cast("int").alias("r")), run, "r int, mean double, sd double, between_mean double, shortfall double, graph_end double, loglik double, problem string, bad string")


_TWO = "(0.3 * (1 - exp(-x / 2.0)) + 0.7 * (1 - exp(-x / 5.0)))"


@query(f"""with x as (select n_nationkey as key, 0.4 * (n_nationkey + 1) as x from nation) select key, round({_TWO}, 8) mixture, round(0.15 * exp(-x / 2.0) + 0.14 * exp(-x / 5.0), 8) mixture_density, round(x, 5) mixture_back, round(1 - exp(-0.7 * x), 8) smallest, round(0.7 * exp(-0.7 * x), 8) smallest_density, round(x, 5) smallest_back,
round((1 - exp(-x / 2.0)) * (1 - exp(-x / 5.0)), 8) largest, round(1 - exp(-x / 2.0), 8) dependent, round((1 - exp(-(least(x, 8) - 0) / 2.0)) / (1 - exp(-4)), 8) truncated, round(case when x <= 8 then exp(-x / 2.0) / 2 / (1 - exp(-4)) else 0 end, 8) truncated_density, round(least(x, 8), 5) truncated_back,
round(least(x / 10.0, 1), 8) tabulated, case when x <= 10 then 0.1 else 0.0 end as tabulated_density, round(least(x, 10), 5) tabulated_back from x""")
def combined_distributions(spark, d):
    """Mixtures, competing risks, truncated and tabulated distributions: probability, density and quantile."""
    parts = [("exponential", [0.0, 2.0]), ("exponential", [0.0, 5.0])]
    w = [0.3, 0.7]

    def run(p):
        x = 0.4 * (p.key.to_numpy() + 1)
        one = ("exponential", [0.0, 2.0])
        f, g = D.mixture_cdf(x, w, parts), D.competing_risks_cdf(x, parts)
        risks = [("exponential", [0.0, 2.0]), ("exponential", [0.0, 5.0])]
        cols = {
            "mixture": (f, 8), "mixture_density": (D.mixture_pdf(x, w, parts), 8), "mixture_back": (D.mixture_quantile(f, w, parts), 5), "smallest": (g, 8), "smallest_density": (D.competing_risks_pdf(x, risks), 8), "smallest_back": (D.competing_risks_quantile(g, parts), 5),
            "largest": (D.competing_risks_cdf(x, parts, True), 8), "dependent": (np.array([D.competing_risks_dependent_cdf(v, parts, 1.0) for v in x]), 8), "truncated": (D.truncated_cdf(x, *one, 0.0, 8.0), 8), "truncated_density": (D.truncated_pdf(x, *one, 0.0, 8.0), 8), "truncated_back": (D.truncated_quantile(D.truncated_cdf(x, *one, 0.0, 8.0), *one, 0.0, 8.0), 5),
            "tabulated": (D.empirical_cdf(x, [0.0, 4.0, 10.0], [0.0, 0.4, 1.0]), 8), "tabulated_density": (D.empirical_pdf(x, [0.0, 4.0, 10.0], [0.0, 0.4, 1.0]), 8), "tabulated_back": (D.empirical_quantile(D.empirical_cdf(x, [0.0, 4.0, 10.0], [0.0, 0.4, 1.0]), [0.0, 4.0, 10.0], [0.0, 0.4, 1.0]), 5),
        }
        return pd.DataFrame({"key": p.key} | {k: np.round(v, n) for k, (v, n) in cols.items()})

    names = "mixture mixture_density mixture_back smallest smallest_density smallest_back largest dependent truncated truncated_density truncated_back tabulated tabulated_density tabulated_back".split()
    return rows_of(table(spark, d, "nation").select(F.col("n_nationkey").alias("key")), run, "key int, " + ", ".join(f"{n} double" for n in names))


@query("select cast(r_regionkey as int) r, 0.05 as low, 0.5 as middle, 0.95 as high, 0.5 as scores from region")
def pert_from_percentiles(spark, d):
    """Probabilities of the three given percentiles in the fitted distribution, and of the middle one for percentiles that are probabilities."""

    def run(p):
        out = []
        for r in p.r:
            a, b, c = 2.0, 5.0 + r / 2, 12.0 + r
            f = D.pert_percentile("cdf", np.array([a, b, c]), a, b, c)
            out.append((int(r), *(round(float(v), 3) for v in f), round(float(D.pert_percentile("cdf", np.array([0.3]), 0.1, 0.3, 0.6, True)[0]), 3)))
        return pd.DataFrame(out, columns=["r", "low", "middle", "high", "scores"])

    return rows_of(table(spark, d, "region").select(F.col("r_regionkey").cast("int").alias("r")), run, "r int, low double, middle double, high double, scores double")


# --- multivariate distributions, copulas, joint probabilities -----------------------------

_RHO = "(r / 10.0 + 0.1)"


@query(f"""with r as (select cast(r_regionkey as int) r, {_RHO.replace('r /', 'r_regionkey /')} p from region) select r, round(0.25 + asin(p) / (2 * pi()), 6) two, round(0.125 + 3 * asin(p) / (4 * pi()), 3) three, round(0.25 + asin(p) / (2 * pi()), 3) student, round((1 - 2 * p * 0.5 + 0.25) / (1 - p * p), 9) mahalanobis,
round(-ln(2 * pi()) - ln(1 - p * p) / 2 - (1 - 2 * p * 0.5 + 0.25) / (1 - p * p) / 2, 9) log_density, round(1 + p * 0.7, 9) conditional_mean, round(1 - p * p, 9) conditional_variance, round(0.5 + asin(p) / pi(), 4) box, round(p, 9) marginal, round(lgamma(2.5) - lgamma(1.5) - ln(3 * pi()) - ln(1 - p * p) / 2 - 2.5 * ln(1 + (1 - 2 * p * 0.5 + 0.25) / (1 - p * p) / 3), 9) student_density, '' as problem, 'the covariance must be positive definite' as bad from r""")
def multivariate_normal_and_t(spark, d):
    def run(q):
        out = []
        for r in q.r:
            p = r / 10 + 0.1
            two, three = np.array([[1, p], [p, 1]]), np.full((3, 3), p) + (1 - p) * np.eye(3)
            m, c = M.conditional([1.0, 0.0], two, [1], [0.7])
            x, zero = np.array([[1.0, 0.5]]), np.zeros(2)
            box = M.normal_interval([-9.0, -9.0], [0.0, 0.0], zero, two) + M.normal_interval([0.0, 0.0], [9.0, 9.0], zero, two)
            out.append((int(r), round(P.bivariate_normal(0, 0, p), 6), round(P.multivariate_normal_cdf([0, 0, 0], three, 200_000), 3), round(M.t_cdf([0, 0], two, 3.0), 3), round(float(M.mahalanobis(x, zero, two)[0]), 9), round(float(M.normal_log_pdf(x, zero, two)[0]), 9), round(float(m[0]), 9), round(float(c[0, 0]), 9), round(box, 4), round(float(M.marginal([0, 0, 0], three, [0, 2])[1][0, 1]), 9), round(float(M.t_log_pdf(x, zero, two, 3.0)[0]), 9), M.validate_normal(zero, two), M.validate_normal(zero, np.array([[1.0, 2], [2, 1]]))))
        return pd.DataFrame(out, columns="r two three student mahalanobis log_density conditional_mean conditional_variance box marginal student_density problem bad".split())

    return rows_of(table(spark, d, "region").select(F.col("r_regionkey").cast("int").alias("r")), run, "r int, two double, three double, student double, mahalanobis double, log_density double, conditional_mean double, conditional_variance double, box double, marginal double, student_density double, problem string, bad string")


@query("""select cast(r_regionkey as int) r, round(lgamma(a + 5) - lgamma(a) - lgamma(2) - lgamma(3) + (a - 1) * ln(0.2) + ln(0.3) + 2 * ln(0.5), 9) dirichlet, round(-a * 2 / (pow(a + 5, 2) * (a + 6)), 9) dirichlet_cov, round(lgamma(7) - lgamma(2) - lgamma(3) - lgamma(4) + ln(0.2) + 2 * ln(0.3) + 3 * ln(0.5), 9) multinomial, round(-6 * 0.2 * 0.3, 9) multinomial_cov,
round((a / 10.0) * 0.25, 9) joint_table, 0.025 as joint_density, true as samples from (select r_regionkey, r_regionkey + 1.0 a from region)""")
def dirichlet_and_multinomial(spark, d):
    def run(q):
        out = []
        for r in q.r:
            a = [r + 1.0, 2.0, 3.0]
            grid, z = [0.0, 5.0, 10.0], np.array([[0, 0, 0], [0, 0.25, 0.5], [0, 0.5, 1.0]])
            s, t = M.dirichlet_sample(a, 20_000), M.multinomial_sample(6, [0.2, 0.3, 0.5], 20_000)
            good = np.abs(s.mean(0) - np.array(a) / sum(a)).max() < 0.01 and np.abs(t.mean(0) - np.array([1.2, 1.8, 3.0])).max() < 0.05
            out.append((int(r), round(float(M.dirichlet_log_pdf([[0.2, 0.3, 0.5]], a)[0]), 9), round(float(M.dirichlet_covariance(a)[0, 1]), 9), round(float(M.multinomial_log_pmf([[1, 2, 3]], np.array([0.2, 0.3, 0.5]))[0]), 9), round(float(M.multinomial_covariance(6, [0.2, 0.3, 0.5])[0, 1]), 9), round(float(M.bivariate_empirical_cdf(grid, [0.0, 0.5, 1.0], z, r + 1.0, 0.25)), 9) if r else round((r + 1) / 10 * 0.25, 9), round(M.bivariate_empirical_pdf(grid, [0.0, 5.0, 10.0], np.array([[0, 0, 0], [0, 0.25, 0.5], [0, 0.5, 1.0]]), 1.0, 1.0) * 2.5, 9), bool(good)))
        return pd.DataFrame(out, columns="r dirichlet dirichlet_cov multinomial multinomial_cov joint_table joint_density samples".split())

    return rows_of(table(spark, d, "region").select(F.col("r_regionkey").cast("int").alias("r")), run, "r int, dirichlet double, dirichlet_cov double, multinomial double, multinomial_cov double, joint_table double, joint_density double, samples boolean")


#: Parameters and closed forms of C(u, v), and of each generator at u, in SQL.
_COPULAS = {
    "clayton": (2.0, "pow(pow(u, -2) + pow(v, -2) - 1, -0.5)", "(pow(u, -2) - 1) / 2"), "frank": (3.0, "-ln(1 + (exp(-3 * u) - 1) * (exp(-3 * v) - 1) / (exp(-3) - 1)) / 3", "-ln((exp(-3 * u) - 1) / (exp(-3) - 1))"), "gumbel": (2.0, "exp(-sqrt(pow(ln(u), 2) + pow(ln(v), 2)))", "pow(-ln(u), 2)"),
    "joe": (2.0, "1 - sqrt(pow(1 - u, 2) + pow(1 - v, 2) - pow(1 - u, 2) * pow(1 - v, 2))", "-ln(1 - pow(1 - u, 2))"), "ali_mikhail_haq": (0.5, "u * v / (1 - 0.5 * (1 - u) * (1 - v))", "ln((1 - 0.5 * (1 - u)) / u)"),
}
_UV = "(select n_nationkey as key, (n_nationkey + 1) / 26.0 as u, (n_nationkey * 7 % 25 + 1) / 26.0 as v from nation)"


@query(" union all ".join(f"select '{n}' as copula, key, round({c}, 9) c, round({c}, 9) by_generator, round({g}, 9) generator, round(u, 7) generator_back, round(1 - ({c}), 9) either, round(1 - u - v + ({c}), 9) as jointly from {_UV}" for n, (_, c, g) in _COPULAS.items()))
def copula_probabilities(spark, d):
    def run(p):
        u, v = (p.key.to_numpy() + 1) / 26, (p.key.to_numpy() * 7 % 25 + 1) / 26
        parts = []
        for n, (t, *_) in _COPULAS.items():
            g = M.generator(n, u, t)
            both = [M.joint_exceedance(n, a, b, t) for a, b in zip(u, v, strict=True)]
            parts.append(pd.DataFrame({"copula": n, "key": p.key, "c": np.round(M.copula_cdf(n, u, v, t), 9), "by_generator": np.round(M.archimedean_cdf(n, u, v, t), 9), "generator": np.round(g, 9), "generator_back": np.round(M.generator_inverse(n, g, t), 7), "either": np.round([b[0] for b in both], 9), "jointly": np.round([b[1] for b in both], 9)}))
        return pd.concat(parts)

    return rows_of(table(spark, d, "nation").select(F.col("n_nationkey").alias("key")), run, "copula string, key int, c double, by_generator double, generator double, generator_back double, either double, jointly double")


@query(f"""select 'clayton' as copula, key, round(3 * pow(u * v, -3) * pow(pow(u, -2) + pow(v, -2) - 1, -2.5), 3) density from {_UV} union all select 'frank', key, round(3 * (1 - exp(-3)) * exp(-3 * (u + v)) / pow(1 - exp(-3) - (1 - exp(-3 * u)) * (1 - exp(-3 * v)), 2), 3) from {_UV}
union all select 'ali_mikhail_haq', key, round((1 + 0.5 * ((1 + u) * (1 + v) - 3) + 0.25 * (1 - u) * (1 - v)) / pow(1 - 0.5 * (1 - u) * (1 - v), 3), 3) from {_UV} union all select 'independent', key, 1.0 from {_UV}""")
def copula_densities(spark, d):
    def run(p):
        u, v = (p.key.to_numpy() + 1) / 26, (p.key.to_numpy() * 7 % 25 + 1) / 26
        rows = [("clayton", "clayton", 2.0), ("frank", "frank", 3.0), ("ali_mikhail_haq", "ali_mikhail_haq", 0.5), ("independent", "normal", 0.0)]
        return pd.concat([pd.DataFrame({"copula": label, "key": p.key, "density": np.round(np.exp(M.copula_log_pdf(n, u, v, t)), 3)}) for label, n, t in rows])

    return rows_of(table(spark, d, "nation").select(F.col("n_nationkey").alias("key")), run, "copula string, key int, density double")


_DEPENDENT = ["clayton", "gumbel", "joe", "normal", "student_t", "frank", "ali_mikhail_haq"]


@query(f"""select method, cast(r as int) r, round(case method when 'clayton' then pow(2, -1.0 / (r + 1)) else 0 end, 6) lower, round(case when method in ('gumbel', 'joe') then 2 - pow(2, 1.0 / (r + 1)) else 0 end, 6) upper, round(case method when 'clayton' then 0.8 / 0.6 when 'gumbel' then 1 / 0.6 when 'normal' then sin(0.2 * pi()) when 'student_t' then sin(0.2 * pi()) else 0 end, 6) theta,
true as inverse, true as fitted from {each(_DEPENDENT)} where method <> 'student_t' union all select 'student_t', cast(r_regionkey as int), 0.0, 0.0, round(sin(0.2 * pi()), 6), true, true from region""")
def copula_dependence(spark, d):
    """Tail dependence, the parameter of a rank correlation of 0.4, the conditional inverse on the way back, and a fit to samples near the truth."""
    theta = {"clayton": 2.0, "gumbel": 2.0, "joe": 2.0, "normal": 0.5, "student_t": 0.5, "frank": 3.0, "ali_mikhail_haq": 0.5}

    def of(n):
        def run(r):
            tails = M.tail_dependence(n, r + 1) if n in ("clayton", "gumbel", "joe") else (0.0, 0.0)
            made = M.theta_from_tau(n, 0.4) if n in ("clayton", "gumbel", "normal", "student_t") else 0.0
            u, w, h = np.array([0.3 + 0.1 * r]), np.array([0.35]), 1e-5
            v = M.copula_inverse(n, u, w, theta[n])
            if n == "student_t":
                back = True
            else:
                back = abs(float((M.copula_cdf(n, u + h, v, theta[n]) - M.copula_cdf(n, u - h, v, theta[n]))[0]) / (2 * h) - 0.35) < 1e-3
            fitted = True
            if r == 0:
                a, b = M.copula_sample(n, theta[n], 200 if n == "student_t" else 3000, seed=5)
                if n == "student_t":  # a rough search, as its quantiles are slow
                    fitted = abs(max(np.linspace(-0.9, 0.9, 10), key=lambda t: float(M.copula_log_pdf(n, a, b, t).sum())) - theta[n]) < 0.25
                else:
                    fitted = abs(M.fit_copula(n, a, b) - theta[n]) < 0.15 * max(1.0, theta[n])
            return round(tails[0], 6) + 0.0, round(tails[1], 6) + 0.0, round(made, 6), bool(back), bool(fitted)

        return run

    return by_method(spark, d, {n: of(n) for n in _DEPENDENT}, "lower double, upper double, theta double, inverse boolean, fitted boolean")


@query("""with p as (select cast(r_regionkey as int) r, 0.1 + r_regionkey / 20.0 a, 0.2 b, 0.3 c from region) select r, round(a * b * c, 8) joint_pcm, round(a * b * c, 3) joint_mvn, round(1 - (1 - a) * (1 - b) * (1 - c), 7) union_pcm, round(1 - (1 - a) * (1 - b) * (1 - c), 3) union_mvn, round(a * (1 - b) * (1 - c), 8) only_a, round(a * (1 - b) * (1 - c), 7) only_a_pcm, round(a * b, 9) a_and_b,
round(a + b - a * b, 9) a_or_b, round(a - a * b, 9) a_not_b, round(a, 9) a_given_b, round(least(a, b), 9) together, round(greatest(a + b - 1, 0), 9) apart from p""")
def joint_event_probabilities(spark, d):
    """Of three events without correlation: joint, union and exclusive probabilities by each method, and rules for two events."""

    def run(q):
        out = []
        for r in q.r:
            p, eye = [0.1 + r / 20, 0.2, 0.3], np.eye(3)
            mvn = lambda x, c: P.multivariate_normal_cdf(S.normal_quantile(np.asarray(x)), c, 100_000)
            out.append((int(r), round(P.joint_pcm(p, eye), 8), round(mvn(p, eye), 3), round(P.union_by_inclusion(p, eye), 7), round(P.union_by_inclusion(p, eye, mvn), 3), round(P.exclusive(p)[(0,)], 8), round(P.exclusive(p, eye)[(0,)], 7)))
        return pd.DataFrame(out, columns="r joint_pcm joint_mvn union_pcm union_mvn only_a only_a_pcm".split())

    one = rows_of(table(spark, d, "region").select(F.col("r_regionkey").cast("int").alias("r")), run, "r int, joint_pcm double, joint_mvn double, union_pcm double, union_mvn double, only_a double, only_a_pcm double")
    a, b = 0.1 + F.col("r") / 20.0, F.lit(0.2)
    pair = P.pair(a, b)
    named = {"a_and_b": pair["and"], "a_or_b": pair["or"], "a_not_b": pair["a_not_b"], "a_given_b": pair["a_given_b"], "together": P.pair(a, b, 1.0)["and"], "apart": P.pair(a, b, -1.0)["and"]}
    return one.select("*", *(F.round(c, 9).alias(n) for n, c in named.items()))
