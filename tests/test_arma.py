import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quillon.operators import arma, estimators, paths


def _simulated(n: int, phi, theta, seed: int, level: float = 0.0) -> np.ndarray:
    e = np.random.default_rng(seed).normal(size=n + 200)
    u = np.zeros_like(e)
    for t in range(len(e)):
        u[t] = e[t] + sum(a * u[t - k - 1] for k, a in enumerate(phi) if t > k) + sum(b * e[t - k - 1] for k, b in enumerate(theta) if t > k)
    return level + u[200:]


def dense(phi, theta, x: np.ndarray) -> tuple[float, np.ndarray]:
    """Log likelihood and coefficients by the covariance matrix of the whole series; its entries by summing the weights of the innovations."""
    n = len(x)
    weights = np.zeros(6000)
    for k in range(len(weights)):
        weights[k] = (k == 0) + (theta[k - 1] if 0 < k <= len(theta) else 0) + sum(a * weights[k - j - 1] for j, a in enumerate(phi) if k > j)
    auto = np.array([weights[: len(weights) - h] @ weights[h:] for h in range(n)])
    v = auto[np.abs(np.subtract.outer(np.arange(n), np.arange(n)))]
    root = np.linalg.cholesky(v)
    z = np.linalg.solve(root, x)
    beta = np.linalg.lstsq(z[:, 1:], z[:, 0], rcond=None)[0]
    rest = z[:, 0] - z[:, 1:] @ beta
    return -0.5 * (n * (math.log(2 * math.pi * (rest @ rest) / n) + 1) + 2 * np.log(np.diag(root)).sum()), beta


@pytest.mark.parametrize(("phi", "theta"), [((0.6,), (-0.3,)), ((0.5, -0.3), ()), ((), (0.4, 0.2)), ((0.9, -0.2), (0.5,)), ((), ())])
def test_likelihood_is_that_of_the_covariance_matrix(phi, theta):
    r = np.random.default_rng(3)
    n = 90
    x = np.column_stack([_simulated(n, phi, theta, 5), np.ones(n), r.normal(size=n)])
    padded = np.zeros((1, n + 20, 3))
    padded[0, :n] = x
    ll, beta, _, _, _ = arma.concentrated(np.array([phi], float).reshape(1, -1), np.array([theta], float).reshape(1, -1), padded, np.array([n]))
    want, coef = dense(phi, theta, x)
    assert ll[0] == pytest.approx(want, abs=1e-7)
    np.testing.assert_allclose(beta[0], coef, atol=1e-8)


@pytest.mark.parametrize(("p", "q", "phi", "theta"), [(1, 1, (0.7,), (0.3,)), (2, 0, (0.5, -0.3), ()), (0, 2, (), (0.5, 0.3)), (2, 1, (0.4, 0.2), (-0.5,))])
def test_fit_is_the_maximum_of_the_dense_likelihood(p, q, phi, theta):
    r = np.random.default_rng(11)
    n = 150
    driver = r.normal(size=n)
    y = _simulated(n, phi, theta, 21, 2.0) + 1.5 * driver
    fit = arma.fit_batch([np.column_stack([y, driver])], p, 0, q)[0]
    x = np.column_stack([y, np.ones(n), driver])
    value = lambda c: -dense(c[:p], c[p:], x)[0]
    best, _ = estimators.nelder_mead(value, np.array([*fit["phi"], *fit["theta"]]) + 0.01, 4000, 1e-15)
    np.testing.assert_allclose([*fit["phi"], *fit["theta"]], best, atol=2e-6)
    ll, beta = dense(best[:p], best[p:], x)
    assert fit["loglik"] == pytest.approx(ll, abs=1e-7) and fit["ok"]
    np.testing.assert_allclose([fit["const"], *fit["beta"]], beta, atol=2e-6)


def test_a_batch_gives_what_each_series_gives_alone():
    series = [np.column_stack([_simulated(n, (0.5,), (0.2,), n)]) for n in (40, 200, 77)]
    for i, fit in enumerate(arma.fit_batch(series, 1, 0, 1)):
        alone = arma.fit_batch([series[i]], 1, 0, 1)[0]
        assert fit["loglik"] == pytest.approx(alone["loglik"], abs=1e-6) and fit["phi"][0] == pytest.approx(alone["phi"][0], abs=1e-4)


def _table(spark, series: dict[str, np.ndarray]):
    rows = [(s, t, *map(float, np.atleast_1d(x))) for s, xs in series.items() for t, x in enumerate(xs)]
    width = len(rows[0]) - 2
    return spark.createDataFrame(pd.DataFrame(rows, columns=["s", "d", "y", *(f"x{k}" for k in range(1, width))]))


def test_first_step_of_a_path_is_the_forecast(spark):
    r = np.random.default_rng(2)
    x = r.normal(size=(260, 1)).cumsum(0) / 20
    y = 0.01 * _simulated(260, (0.6, 0.1), (0.3,), 8)[:, None] + 0.02 + 0.3 * x
    both = np.column_stack([y, x])
    df = _table(spark, {"a": both[:-1], "b": both[:200]})
    for order in ((2, 0, 1), (1, 1, 1)):
        fits = arma.fits(df, "y", ["x1"], [order])
        one = {f.s: f for f in fits.collect()}
        quiet = fits.withColumns({"omega": F.lit(1e-14), "alpha": F.lit(0.0), "garch_beta": F.lit(0.0), "s0": F.lit(50.0)})
        ahead = _table(spark, {"a": both[259:], "b": both[200:203]})
        got = {(g.s, g.t): g for g in paths.arma_garch_rows(quiet, ["s"], 2, 4, ahead, ["x1"]).filter("sim_id = 0").collect()}
        for s, n in (("a", 259), ("b", 200)):
            f, d = one[s], order[1]
            data = np.diff(both[: n + 1], n=d, axis=0)
            columns = data if d else np.column_stack([data[:, 0], np.ones(n + 1), data[:, 1]])
            z, roots, _, _ = arma.filtered(np.array([f.phi]), np.array([f.theta]), columns[None], np.array([len(columns)]))
            error = (z[0, -1] * roots[0, -1]) @ np.array([1, *([] if d else [-f.const]), *(-np.array(f.beta))])
            forecast = both[n, 0] - error
            assert got[s, 0].r == pytest.approx(forecast, abs=2e-6)
            assert got[s, 0].v == pytest.approx(50 * math.exp(got[s, 0].r), rel=1e-9)
    still = paths.arma_garch_rows(arma.fits(df, "y", ["x1"]), ["s"], 40, 30).groupBy("s").agg(F.count("*").alias("n"), F.stddev("r").alias("sd")).collect()
    assert all(x.n == 1200 and x.sd > 0 for x in still)


def test_orders_and_fallback(spark):
    df = _table(spark, {"a": _simulated(300, (0.7,), (), 4), "flat": np.full(60, 2.0), "short": np.zeros(10), "white": np.random.default_rng(6).normal(size=120)})
    orders = [(1, 0, 1), (0, 0, 0)]
    taken = {r.s: r for r in arma.first_of_orders(arma.fits(df, "y", (), orders), orders).collect()}
    assert set(taken) == {"a", "flat", "white"}  # too short a series has no fit
    assert (taken["a"].fallback, taken["a"].p) == (0, 1) and (taken["flat"].fallback, taken["flat"].p) == (1, 0)
    grid = arma.fits(df.filter("s in ('a', 'white')"), "y", (), [(p, 0, q) for p in (0, 1, 2) for q in (0, 1)], variance=None)
    best = {r.s: r for r in arma.best_orders(grid).collect()}
    assert best["a"].p >= 1 and min(r.aic for r in grid.filter("s = 'a'").collect()) == best["a"].aic


def test_drivers_that_depend_on_each_other_are_no_fit(spark):
    x = np.random.default_rng(1).normal(size=100)
    df = _table(spark, {"a": np.column_stack([x + _simulated(100, (), (), 3), x, 2 * x])})
    assert [r.ok for r in arma.fits(df, "y", ["x1", "x2"], variance=None).collect()] == [False]


@pytest.mark.parametrize("nu", [None, 5.5])
def test_garch_gradient(nu):
    r = np.random.default_rng(9)
    z = r.normal(size=150)
    a = np.column_stack([np.ones(149), z[:-1]])
    at = np.array([0.1, 0.2, 0.3, 0.1, 0.7, *([nu] if nu else [])])
    f = lambda v: arma.garch_likelihood(v[:2], *v[2:5], v[5] if nu else None, z[1:], a, 1.3)
    _, g = f(at)
    for k in range(len(at)):
        step = np.zeros(len(at))
        step[k] = 1e-6
        assert g[k] == pytest.approx((f(at + step)[0] - f(at - step)[0]) / 2e-6, rel=1e-5, abs=1e-5)


def test_joint_fit_finds_the_parameters_and_is_never_below_two_steps(spark):
    r = np.random.default_rng(12)
    n, z, s2, e = 6000, [0.0], 0.5, 0.0
    for _ in range(n):
        s2 = 0.05 + 0.1 * e * e + 0.85 * s2
        e = math.sqrt(s2) * r.normal()
        z.append(0.02 + 0.4 * z[-1] + e)
    df = _table(spark, {"a": np.array(z) / 100, "b": r.standard_t(4, 500) / 100, "c": np.zeros(50)})
    for lags, student in ((1, False), (0, True), (3, True)):
        rows = {x.s: x for x in arma.ar_garch(df, "y", lags, student).collect()}
        assert set(rows) == {"a", "b"} and all(x.loglik >= x.two_step - 1e-9 for x in rows.values())
        assert all(len(x.phi) == lags for x in rows.values())
    one = {x.s: x for x in arma.ar_garch(df, "y", 1).collect()}["a"]
    assert one.phi[0] == pytest.approx(0.4, abs=0.04) and one.alpha == pytest.approx(0.1, abs=0.03) and one.garch_beta == pytest.approx(0.85, abs=0.05)
    assert one.loglik > one.two_step
