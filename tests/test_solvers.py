"""Driver solvers against optimality conditions and brute force; no Spark."""

import math

import numpy as np
import pytest

from ridgeline.functions.glm import Binomial, Gaussian, Multinomial, MultiGaussian, Poisson, family
from ridgeline.functions.special import normal_cdf
from ridgeline.plans import bcd, constraint, css, path, qp

RNG = np.random.default_rng(0)


def psd(d, n=None):
    x = RNG.standard_normal((n or d + 5, d))
    return x.T @ x / len(x)


@pytest.mark.parametrize("d", [1, 2, 5, 20])
@pytest.mark.parametrize("solver", bcd.SOLVERS)
def test_group_solution_is_stationary(d, solver):
    quad, v = RNG.random(d) + 0.1, RNG.standard_normal(d)
    l1, l2 = 0.3 * np.linalg.norm(v), 0.2
    x = bcd.solve(quad, v, l1, l2, solver)
    assert np.allclose(quad * x + l2 * x + l1 * x / np.linalg.norm(x), v, atol=1e-6)
    assert np.allclose(bcd.solve(quad, v, np.linalg.norm(v), l2, solver), 0)
    h = bcd.root(quad + l2, v, l1)
    assert bcd.root_lower_bound(quad + l2, v, l1) <= h * (1 + 1e-9) and h <= bcd.root_upper_bound(quad + l2, v, l1) * (1 + 1e-9)
    assert abs(bcd.root_function(h, quad + l2, v, l1)) < 1e-9
    assert bcd.objective(x, quad, v, l1, l2) <= bcd.objective(x + 1e-3, quad, v, l1, l2)


def test_root_has_no_solution_where_there_is_none():
    assert bcd.root([1.0], [0.5], 1.0) is None
    assert bcd.root([0.0], [2.0], 1.0) is None


@pytest.mark.parametrize("d", [1, 3, 8])
def test_quadratic_programs(d):
    Q, v = psd(d), RNG.standard_normal(d)
    x = qp.lasso_full(Q, v, 0.1)
    g = v - Q @ x
    assert (np.abs(g) <= 0.1 + 1e-7).all() and np.allclose(g[x != 0], 0.1 * np.sign(x[x != 0]), atol=1e-7)
    x = qp.nnqp_full(Q, v)
    assert (x >= 0).all() and (v - Q @ x <= 1e-7).all() and np.allclose((v - Q @ x)[x > 0], 0, atol=1e-7)
    neg, pos = RNG.random(d), RNG.random(d)
    x = qp.pinball_full(Q, v, neg, pos)
    g = v - Q @ x
    assert (g <= pos + 1e-7).all() and (g >= -neg - 1e-7).all() and np.allclose(g[x > 0], pos[x > 0], atol=1e-7) and np.allclose(g[x < 0], -neg[x < 0], atol=1e-7)
    A = RNG.standard_normal((d + 2, d))
    x = qp.linqp_full(Q, v, A, -0.3, 0.2)
    a = A @ x
    assert (a <= 0.2 + 1e-9).all() and (a >= -0.3 - 1e-9).all()
    for _ in range(50):
        z = x + 1e-3 * RNG.standard_normal(d)
        if (A @ z <= 0.2).all() and (A @ z >= -0.3).all():
            assert 0.5 * x @ Q @ x - v @ x <= 0.5 * z @ Q @ z - v @ z + 1e-6
    X, y = RNG.standard_normal((20, d)), RNG.standard_normal(20)
    b = qp.nnls(X, y)
    assert (b >= 0).all() and (X.T @ (y - X @ b) <= 1e-6).all()
    S = psd(d)
    b = qp.pinball(A, S, v, 0.2, 0.3)
    g = A @ (v - S @ A.T @ b)
    assert (g <= 0.3 + 1e-6).all() and (g >= -0.2 - 1e-6).all()


def test_one_dimensional_searches():
    assert qp.brent(lambda x: x**3 - 2, 0, 2) == pytest.approx(2 ** (1 / 3))
    assert qp.newton_root_find(lambda x: (x * x - 2, 2 * x), 1.0) == pytest.approx(math.sqrt(2))
    y = np.concatenate([np.arange(10.0), np.full(10, 9.0)])
    assert qp.search_pivot(np.arange(20), y)[0] == 9
    knots = RNG.standard_normal(9)
    for alpha in (0.0, 0.3, 0.7, 1.0):
        f = lambda t: np.sum(alpha * np.abs(t - knots) + (1 - alpha) / 2 * (t - knots) ** 2)  # noqa: E731, B023
        t = qp.symmetric_penalty(knots, alpha)
        assert all(f(t) <= f(s) + 1e-9 for s in np.linspace(-3, 3, 2001))


@pytest.mark.parametrize("d", [1, 2, 5])
def test_constraints(d):
    quad, v = RNG.random(d) + 0.2, 2 * RNG.standard_normal(d)
    Q = np.linalg.qr(RNG.standard_normal((d, d)))[0]
    sets = [
        constraint.Box(-0.1 * np.ones(d), 0.2 * np.ones(d)), constraint.lower(-0.1 * np.ones(d)), constraint.upper(np.zeros(d)), constraint.OneSided(np.ones(d), 0.1 * np.ones(d), method="admm"),
        constraint.Linear(RNG.standard_normal((2, d)), -0.1 * np.ones(2), 0.2 * np.ones(2)), constraint.Zero(d),
    ]
    for c in sets:
        x, mu = c.solve(quad, v, 0.05, 0.1, Q)
        z = Q @ x
        assert np.allclose(c.project(z), z, atol=1e-6)
        force = Q.T @ c.gradient(mu)
        left = v - quad * x - 0.1 * x - force
        if np.linalg.norm(x) > 1e-7:
            assert np.allclose(left, 0.05 * x / np.linalg.norm(x), atol=1e-4)
        else:
            assert np.linalg.norm(left) <= 0.05 + 1e-4
    with pytest.raises(ValueError):
        constraint.Box([0.1], [0.2])
    with pytest.raises(ValueError):
        constraint.OneSided([0.5], [1.0])
    assert constraint.upper(np.zeros(2)).solve_zero(np.array([1.0, -1.0]))[0] == pytest.approx(1.0)


@pytest.mark.parametrize("alpha", [1.0, 0.5, 0.0])
def test_gaussian_path_is_optimal(alpha):
    n, p = 60, 12
    x, y = RNG.standard_normal((n, p)), RNG.standard_normal(n)
    w = RNG.random(n)
    w /= w.sum()
    stats = {"xx": x.T @ (x * w[:, None]), "xy": (x.T @ (w * y))[:, None], "yy": np.array([[w @ (y * y)]]), "x": x.T @ w, "y": np.array([w @ y])}
    for starts, rule in (([0, 3, 4, 9], "pivot"), ([0, 1, 5], "strong")):
        o = path.Options(alpha=alpha, lmda_path_size=15, early_exit=False, screen_rule=rule, penalty=[0.0, *np.ones(len(starts) - 1)])
        fit = path.gaussian_from_statistics(stats, list("abcdefghijkl"), starts, o)
        assert not fit.error and len(fit.lmdas) == 15
        fit.check(1e-7)
        for b, a, lam in zip(fit.betas, fit.intercepts, fit.lmdas, strict=True):
            r = w * (y - x @ b - a[0])
            assert abs(r.sum()) < 1e-9
            g = x.T @ r
            for at, s, pen in zip(fit.starts, fit.sizes, fit.penalty, strict=True):
                left = g[at : at + s] - lam * (1 - alpha) * pen * b[at : at + s]
                assert np.linalg.norm(left) <= lam * alpha * pen + 1e-6
    warm = path.gaussian_from_statistics(stats, list("abcdefghijkl"), [0, 1, 5], path.Options(alpha=alpha, lmda_path=fit.lmdas[-1:], early_exit=False, penalty=o.penalty, warm_start=fit))
    assert np.allclose(warm.betas[-1], fit.betas[-1], atol=1e-6)


def test_error_keeps_the_valid_prefix():
    A, v = psd(6), RNG.standard_normal(6)
    fit = path.gaussian_cov(A, v, options=path.Options(intercept=False, early_exit=False, max_active_size=2))
    assert fit.error == "max active size reached" and max(fit.active_sizes) <= 2
    full = path.gaussian_cov(A, v, options=path.Options(intercept=False, early_exit=False))
    assert np.allclose(path.pin_solve(A, v, full.lmdas, range(6)), full.betas, atol=1e-6)
    with pytest.raises(ValueError):
        path.Options(screen_rule="x")


@pytest.mark.parametrize("f", [Gaussian(), Binomial(), Binomial(link="probit"), Poisson()])
def test_family_gradients_are_derivatives(f):
    y, eta, w = (RNG.random(9) > 0.5).astype(float), RNG.standard_normal(9), RNG.random(9)
    w[2] = 0
    e = 1e-5
    slope = -(f.loss(y, eta + e, w) - f.loss(y, eta - e, w)) / (2 * e)
    assert np.allclose(f.gradient(y, eta, w), slope, atol=1e-4)
    curve = -(f.gradient(y, eta + e, w) - f.gradient(y, eta - e, w)) / (2 * e)
    assert np.allclose(f.hessian(y, eta, w), curve, atol=1e-3)
    assert f.loss_full(y, w).sum() <= f.loss(y, eta, w).sum() + 1e-9
    assert f.inv_hessian_gradient(y, eta, w).shape == (9,)


@pytest.mark.parametrize("f", [MultiGaussian(), Multinomial()])
def test_multi_family_gradients(f):
    at = RNG.integers(0, 3, 7)
    ys, etas, w = [(at == k).astype(float) for k in range(3)], [RNG.standard_normal(7) for _ in range(3)], RNG.random(7)
    e = 1e-6
    for k in range(3):
        up, down = list(etas), list(etas)
        up[k], down[k] = etas[k] + e, etas[k] - e
        assert np.allclose(f.gradient(ys, etas, w)[k], -(f.loss(ys, up, w) - f.loss(ys, down, w)) / (2 * e), atol=1e-6)
    with pytest.raises(ValueError):
        family("nope")


def test_normal_distribution_function():
    x = np.linspace(-6, 6, 201)
    assert np.max(np.abs(normal_cdf(x) - [0.5 * math.erfc(-t / math.sqrt(2)) for t in x])) < 1e-7


@pytest.mark.parametrize("loss", css.LOSSES)
def test_column_subsets(loss):
    S = psd(6, 30)
    one = css.css_cov(S, 1, loss=loss)
    assert css.loss_of(S, one, loss) == pytest.approx(min(css.loss_of(S, [j], loss) for j in range(6)))
    got = css.css_cov(S, subset=[0, 1, 2], method="swapping", loss=loss)
    value = css.loss_of(S, got, loss)
    for k in range(3):  # no single swap is better
        for j in set(range(6)) - set(got):
            other = css.loss_of(S, [*got[:k], j, *got[k + 1 :]], loss)
            assert value <= other + 1e-9
    assert css.css_cov(S, 0, loss=loss) == []


def test_subset_model_selection():
    x = RNG.standard_normal((400, 2))
    full = np.column_stack([x, x @ RNG.standard_normal((2, 3)) + 0.3 * RNG.standard_normal((400, 3))])
    model = css.CSSModelSelection(alpha=0.05, n_inits=10, n_sims=2000, seed=1).fit_cov(full.T @ full / 400, 400)
    assert 1 <= len(model.subset_) <= 3


def test_css_starts_as_tasks_choose_alike(spark):
    r = np.random.default_rng(6)
    z = r.standard_normal((500, 3))
    full = np.hstack([z, z @ r.standard_normal((3, 5)) + 0.3 * r.standard_normal((500, 5))])
    S = full.T @ full / 500
    for alpha, starts, sims in ((0.05, 6, 2500), (0.5, 2, 300)):
        alone = css.CSSModelSelection(alpha, starts, sims, seed=3).fit_cov(S, 500)
        assert alone.subset_ == css.CSSModelSelection(alpha, starts, sims, seed=3).fit_cov(S, 500, spark).subset_
    assert sorted(alone.subset_) and css.search(S, 3, 3, 1) == css.search(S, 3, 3, 1)
    # residual variances of independent columns by growing regressions give the simulated law
    stats = [-np.linalg.slogdet(np.corrcoef(r.standard_normal((40, 4)).T))[1] for _ in range(4000)]
    drawn = np.concatenate([css.simulated(40, 4, 0, 1, b, 1000) for b in range(4)])
    assert np.quantile(stats, 0.9) == pytest.approx(np.quantile(drawn, 0.9), rel=0.06)
