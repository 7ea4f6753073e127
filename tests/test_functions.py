"""Kernels against published or closed values."""

import math

import numpy as np
import pytest

from fluvial.functions import distributions as D
from fluvial.functions import linalg, multivariate
from fluvial.functions import optimize as O
from fluvial.functions import special as S
from fluvial.operators import curves, learning, probability, sampling


def test_special_values():
    assert np.allclose(S.normal_quantile([0.975, 0.5]), [1.959963984540054, 0], atol=1e-12)
    assert np.allclose(S.gamma_p(2.5, 3.0), 0.6937810815867216)
    assert np.allclose(S.beta_i(2, 3, 0.4), 0.5248)
    assert np.allclose([S.digamma(1.0), S.trigamma(1.0)], [-0.5772156649015329, math.pi**2 / 6])
    assert np.allclose([S.bessel_i(0, 1.0), S.bessel_j(1, 2.0), S.bessel_k(0, 1.0), S.bessel_y(0, 1.0)], [1.2660658777520084, 0.5767248077568734, 0.42102443824070834, 0.08825696421567698])
    assert np.allclose(S.debye(1.0), 0.7775046341122482)
    assert np.allclose(S.erf_inverse(S.erf(0.3)), 0.3)


@pytest.mark.parametrize(("name", "params"), [("normal", [1, 2]), ("gev", [10, 2, 0.1]), ("gumbel", [10, 2]), ("generalized_logistic", [10, 2, -0.1]), ("generalized_normal", [10, 2, 0.1]), ("generalized_pareto", [1, 2, 0.1]), ("kappa4", [10, 2, 0.1, 0.2]), ("pearson3", [10, 2, -0.5]), ("log_pearson3", [1, 0.2, 0.3]), ("weibull", [2, 1.5]), ("gamma", [2, 3]), ("student_t", [0, 1, 5]), ("pert", [1, 2, 5]), ("truncated_normal", [1, 2, 0, 4]), ("von_mises", [0, 2]), ("noncentral_t", [5, 1])])
def test_quantile_inverts_probability(name, params):
    p = np.array([0.05, 0.3, 0.5, 0.9])
    assert np.allclose(D.evaluate(name, "cdf", D.evaluate(name, "quantile", p, params), params), p, atol=1e-5)


def test_density_integrates():
    for name, params in (("gumbel", [10, 2]), ("gamma", [2, 3]), ("gev", [10, 2, 0.1])):
        assert math.isclose(O.quadrature(lambda x, n=name, q=params: D.evaluate(n, "pdf", x, q), -20, 80, "simpson", 4000), 1, abs_tol=1e-4)


def test_l_moment_estimators_recover_parameters():
    p = (np.arange(200_000) + 0.5) / 200_000
    for name, params in (("gev", [10, 2, 0.1]), ("gumbel", [10, 2]), ("generalized_logistic", [10, 2, -0.1]), ("generalized_pareto", [1, 2, 0.1]), ("pearson3", [10, 2, 0.5]), ("generalized_normal", [10, 2, 0.2]), ("normal", [1, 2])):
        assert np.allclose(sampling.estimate(name, D.evaluate(name, "quantile", p, params)), params, atol=0.02), name


def test_maximum_likelihood_of_normal():
    x = np.random.default_rng(1).normal(5, 2, 500)
    assert np.allclose(D.maximum_likelihood("normal", x), [x.mean(), x.std()], atol=1e-3)


def test_optimisers_roots_and_integrals():
    bowl = lambda x: (1 - x[0]) ** 2 + 100 * (x[1] - x[0] ** 2) ** 2
    for run in (O.nelder_mead(bowl, [-1, 1.0]), O.bfgs(bowl, [-1, 1.0]), O.differential_evolution(bowl, [-3, -3], [3, 3]), O.shuffled_complexes(bowl, [-3, -3], [3, 3])):
        assert np.allclose(run.x, 1, atol=1e-3)
    box = lambda x: ((x - 0.5) ** 2).sum()
    for run in (O.particle_swarm(box, [-1, -1], [1, 1], most=100), O.annealing(box, [-1, -1], [1, 1]), O.powell(box, [0, 0.0]), O.multi_start(box, [-1, -1], [1, 1], 3), O.descend(box, [0, 0.0], 0.05)):
        assert np.allclose(run.x, 0.5, atol=0.05)
    low = O.augmented_lagrange(lambda x: x[0] ** 2 + x[1] ** 2, [1, 1.0], equal=[lambda x: x[0] + x[1] - 1])
    assert np.allclose(low.x, 0.5, atol=1e-3)
    for root in (O.bisection, O.brent):
        assert math.isclose(root(lambda x: x * x - 2, 0, 2), math.sqrt(2), rel_tol=1e-9)
    assert math.isclose(O.secant(lambda x: x * x - 2, 1, 2), math.sqrt(2)) and math.isclose(O.newton(lambda x: x * x - 2, 1.0), math.sqrt(2))
    assert math.isclose(O.adaptive(np.sin, 0, math.pi), 2) and math.isclose(O.golden(lambda x: (x - 1) ** 2, -3, 4), 1, abs_tol=1e-6)
    assert abs(O.vegas(lambda x: x.prod(1), [0, 0], [1, 1])[0] - 0.25) < 1e-3 and abs(O.monte_carlo(lambda x: x.prod(1), [0, 0], [1, 1], strata=10)[0] - 0.25) < 1e-2
    assert math.isclose(O.runge_kutta_adaptive(lambda t, y: -y, 0, 1, 1), math.exp(-1), rel_tol=1e-6)


def test_linear_algebra():
    a = np.array([[4.0, 1, 2], [1, 3, 0], [2, 0, 5]])
    order, low, up = linalg.lu(a)
    assert np.allclose(low @ up, a[order]) and np.allclose(a @ linalg.cholesky_solve(a, np.ones(3)), 1)
    assert math.isclose(linalg.log_determinant(a), math.log(np.linalg.det(a))) and linalg.rank(np.ones((3, 3))) == 1
    assert np.allclose(np.ones((3, 3)) @ linalg.null_space(np.ones((3, 3))), 0)
    np.linalg.cholesky(linalg.make_positive_definite(np.array([[1, 2.0], [2, 1]])))


def test_copulas():
    for name, theta in (("clayton", 2.0), ("gumbel", 2.0), ("frank", 5.0), ("normal", 0.6)):
        u, v = multivariate.copula_sample(name, theta, 2000)
        assert abs(multivariate.fit_copula(name, u, v) - theta) < 0.15 * theta
    assert math.isclose(multivariate.theta_from_tau("clayton", 0.5), 2) and math.isclose(multivariate.tail_dependence("gumbel", 2)[1], 2 - math.sqrt(2))
    assert abs(multivariate.theta_from_tau("frank", 0.4567) - 5.0) < 0.01


def test_event_probabilities():
    c = np.array([[1, 0.5], [0.5, 1]])
    assert math.isclose(probability.bivariate_normal(0, 0, 0.5), 1 / 3, rel_tol=1e-9)
    assert math.isclose(probability.joint_pcm([0.5, 0.5], c), 1 / 3, abs_tol=0.02)
    assert math.isclose(sum(probability.exclusive([0.2, 0.3]).values()), 1 - 0.8 * 0.7)
    assert math.isclose(probability.multivariate_normal_cdf([0, 0, 0], np.eye(3)), 0.125, abs_tol=1e-3)
    assert math.isclose(probability.union_by_inclusion([0.2, 0.3], np.eye(2)), 0.44)


def test_curves():
    x = np.linspace(0, 3, 31)
    assert np.allclose(curves.spline(x, np.sin(x), [1.05, 2.02]), np.sin([1.05, 2.02]), atol=1e-4)
    assert math.isclose(curves.neville(x, x**3, 1.234), 1.234**3, rel_tol=1e-9)
    assert math.isclose(float(curves.bilinear([0, 1], [0, 1], [[0, 1], [2, 3]], 0.5, 0.5)), 1.5)
    line = np.arange(5.0)
    assert curves.peucker(line, line * 2, 0.1).tolist() == [True, False, False, False, True]
    assert curves.visvalingam(line, np.array([0, 0, 5, 0, 0.0]), 3)[2] and curves.lang(line, line, 0.1, 10).sum() == 2


def test_learning_and_sampling():
    ends, fit = learning.natural_breaks([1, 2, 3, 100, 101, 102, 200, 201], 3)
    assert ends == [3.0, 102.0, 201.0] and fit > 0.99
    x = np.concatenate([np.random.default_rng(1).normal(m, 0.3, (50, 2)) for m in (0, 5)])
    assert np.allclose(sorted(learning.gaussian_mixture(x, 2)[1][:, 0]), [0, 5], atol=0.3)
    rng = np.random.default_rng(1)
    assert (learning.grow_tree(x, (x[:, 0] > 2).astype(float), rng, classify=True).predict(x) == (x[:, 0] > 2)).all()
    s = sampling.sobol(1024, 5)
    assert np.allclose(s.mean(0), 0.5, atol=0.01) and len(np.unique(s[:, 4])) == 1024
    h = sampling.latin_hypercube(20, 3)
    assert all((np.sort((h[:, j] * 20).astype(int)) == np.arange(20)).all() for j in range(3))
    assert math.isclose(sum(w for *_, w in sampling.stratify_probability(0.01, 0.99, 10, "normal")), 1)
    assert math.isclose(sampling.jackknife(np.arange(10.0), np.mean)[0], np.arange(10.0).std(ddof=1) / math.sqrt(10))


@pytest.mark.parametrize("sampler", sorted(sampling.SAMPLERS))
def test_samplers_find_a_normal(sampler):
    f = lambda x: float(-0.5 * ((x - [1, 2]) ** 2).sum())
    got = np.array([s for s, _ in sampling.SAMPLERS[sampler](np.random.default_rng(3), f, np.array([0.0, 0.0]), 600, 300, 2)])
    assert np.allclose(got.mean(0), [1, 2], atol=0.4) and np.allclose(got.std(0), 1, atol=0.4)
