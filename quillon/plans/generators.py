"""Queries of generators and of the models with drivers: every path table comes from fits of the series of orders.

Where the mean of a path has a closed form, a query gives it for each step, and whether the mean of
the simulated values lies within six standard errors of it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions import series
from quillon.operators import arma, estimators, metrics, paths
from quillon.plans.base import DAILY, daily, query, r
from quillon.plans.simulation import _OVER, W

N, STEPS = 1_000, 252

#: NAV: the mean of 20 days' values; its log returns r; interest y and its changes z; the last values s0, y0.
_NAV = (
    f"{DAILY}, nav AS (SELECT s, d, y, avg(x) OVER ({_OVER} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS n FROM daily), "
    f"nr AS (SELECT s, d, n, y, ln(n / lag(n) OVER ({_OVER})) AS r, lag(y) OVER ({_OVER}) AS l, y - lag(y) OVER ({_OVER}) AS z FROM nav), "
    "last AS (SELECT s, max_by(n, d) AS s0, max_by(y, d) AS y0 FROM nav GROUP BY 1), "
    f"steps AS (SELECT t FROM generate_series(0, {STEPS - 1}) x(t))"
)


def nav(spark, sf_dir) -> DataFrame:
    rows = daily(spark, sf_dir).withColumn("n", F.avg("x").over(W().rowsBetween(-19, 0)))
    return rows.withColumns({"r": series.log_return(F.col("n"), W()), "z": series.diff(F.col("y"), W())})


def _last(rows: DataFrame) -> DataFrame:
    return rows.groupBy("s").agg(F.max_by("n", "d").alias("s0"), F.max_by("y", "d").alias("x0"))


def _against(p: DataFrame, params: DataFrame, mean, digits: int = 3, value: str = "v") -> DataFrame:
    """(s, t, mean, within) of paths and the closed form of their mean, an expression of t and the parameters."""
    seen = p.groupBy("s", "t").agg(F.avg(value).alias("_a"), (F.stddev_samp(value) / F.sqrt(F.count("*"))).alias("_e"))
    rows = seen.join(params, "s").withColumn("_m", mean)
    near = F.abs(F.col("_a") - F.col("_m")) <= 6 * F.col("_e") + 1e-9 * F.abs("_m")
    return rows.select("s", F.col("t").cast("bigint").alias("t"), r("_m", digits).alias("mean"), near.alias("within"))


@query("mc_gbm", f"WITH {_NAV}, f AS (SELECT s, avg(r) AS m FROM nr GROUP BY 1) SELECT f.s, t, round(s0 * exp(m * t), 3) AS mean, TRUE AS within FROM f JOIN last ON f.s = last.s, steps")
def mc_gbm(spark, sf_dir):
    rows = nav(spark, sf_dir)
    params = estimators.gbm(rows, "r").join(_last(rows), "s")
    return _against(paths.gbm_rows(params, ["s"], N, STEPS), params, F.col("s0") * F.exp(F.col("mu") / 252 * F.col("t")))


@query("mc_heston", f"WITH {_NAV}, f AS (SELECT s, avg(r) AS m FROM nr GROUP BY 1) SELECT f.s, t, round(s0 * exp(m * t), 3) AS mean, TRUE AS within FROM f JOIN last ON f.s = last.s, steps")
def mc_heston(spark, sf_dir):
    rows = nav(spark, sf_dir)
    params = estimators.heston_moments(rows, "r").join(_last(rows), "s")
    return _against(paths.heston_rows(params, ["s"], N, STEPS), params, F.col("s0") * F.exp(F.col("mu") / 252 * F.col("t")))


@query(
    "mc_merton",
    f"WITH {_NAV}, q AS (SELECT s, quantile_cont(abs(r), 0.95) AS q FROM nr WHERE r IS NOT NULL GROUP BY 1), f AS (SELECT nr.s, avg(r) FILTER (abs(r) < q) AS m FROM nr JOIN q ON nr.s = q.s GROUP BY 1) SELECT f.s, t, round(s0 * exp(m * t), 3) AS mean, TRUE AS within FROM f JOIN last ON f.s = last.s, steps",
)
def mc_merton(spark, sf_dir):
    rows = nav(spark, sf_dir)
    params = estimators.merton(estimators.jumps_quantile(rows, "r"), "r").withColumnRenamed("lambda", "rate").join(_last(rows), "s")
    return _against(paths.merton_rows(params, ["s"], N, STEPS), params, F.col("s0") * F.exp(F.col("mu") * F.col("t")))


_OLS = "f AS (SELECT s, CASE WHEN regr_slope(z, l) < 0 THEN -regr_slope(z, l) ELSE 0.1 END AS k, regr_intercept(z, l) / -regr_slope(z, l) AS m FROM nr GROUP BY 1)"


@query("mc_ou", f"WITH {_NAV}, {_OLS} SELECT f.s, t, round(m + pow(1 - k, t) * (y0 - m), 5) AS mean, TRUE AS within FROM f JOIN last ON f.s = last.s, steps")
def mc_ou(spark, sf_dir):
    rows = nav(spark, sf_dir)
    params = estimators.ou_ols(rows, "y").join(_last(rows), "s")
    return _against(paths.ou_rows(params, ["s"], N, STEPS), params, F.col("mu") + F.pow(1 - F.col("kappa"), F.col("t")) * (F.col("x0") - F.col("mu")), 5)


@query(
    "mc_ou_exact",
    f"WITH {_NAV}, b AS (SELECT s, regr_slope(y, l) AS b, regr_intercept(y, l) AS a FROM nr GROUP BY 1), f AS (SELECT s, a, CASE WHEN b > 0 AND b < 1 THEN b ELSE greatest(0.01, least(0.99, b)) END AS c FROM b) SELECT f.s, t, round(a / (1 - c) + pow(c, t) * (y0 - a / (1 - c)), 5) AS mean, TRUE AS within FROM f JOIN last ON f.s = last.s, steps",
)
def mc_ou_exact(spark, sf_dir):
    rows = nav(spark, sf_dir)
    params = estimators.ou_exact(rows, "y").withColumnRenamed("theta", "mu").join(_last(rows), "s")
    return _against(paths.exact_ou_rows(params, ["s"], N, STEPS), params, F.col("mu") + F.exp(-F.col("kappa") * F.col("t")) * (F.col("x0") - F.col("mu")), 5)


@query(
    "mc_ou_pair",
    f"WITH {_NAV}, {_OLS}, g AS (SELECT f.s, k, m, y0 FROM f JOIN last ON f.s = last.s) SELECT a.s, t, round(a.m + pow(1 - a.k, t) * (a.y0 - a.m), 5) AS mean, TRUE AS within, round(b.m + pow(1 - b.k, t) * (b.y0 - b.m), 5) AS other_mean, TRUE AS other_within FROM g a JOIN g b ON CAST(substr(b.s, 1, 1) AS INTEGER) = CAST(substr(a.s, 1, 1) AS INTEGER) + 1, steps",
)
def mc_ou_pair(spark, sf_dir):
    """Every series with the next one, their shocks correlated as their changes are."""
    rows = nav(spark, sf_dir)
    fit = estimators.ou_ols(rows, "y").join(_last(rows), "s")
    number = F.substring("s", 1, 1).cast("int")  # series are named 1-URGENT to 5-LOW
    a = fit.select("s", number.alias("k"), F.col("x0").alias("a"), (F.col("kappa") * 252).alias("ka"), F.col("mu").alias("ma"), (F.col("sigma") * 252**0.5).alias("sa"))
    b = fit.select((number - 1).alias("k"), F.col("x0").alias("b"), (F.col("kappa") * 252).alias("kb"), F.col("mu").alias("mb"), (F.col("sigma") * 252**0.5).alias("sb"))
    one = rows.select(number.alias("k"), "d", F.col("z").alias("_a"))
    rho = one.join(rows.select((number - 1).alias("k"), "d", F.col("z").alias("_b")), ["k", "d"]).groupBy("k").agg(F.coalesce(F.corr("_a", "_b"), F.lit(0.0)).alias("rho"))
    params = a.join(b, "k").join(rho, "k")
    p = paths.ou_pair_rows(params, ["s"], N, STEPS)
    mean = lambda m, k, x: F.col(m) + F.pow(1 - F.col(k) / 252, F.col("t")) * (F.col(x) - F.col(m))
    other = _against(p, params, mean("mb", "kb", "b"), 5, "w").select("s", "t", F.col("mean").alias("other_mean"), F.col("within").alias("other_within"))
    return _against(p, params, mean("ma", "ka", "a"), 5).join(other, ["s", "t"])


@query("mc_state_draws", f"WITH {_NAV}, f AS (SELECT s, avg(ln(1 + y)) AS m, var_pop(ln(1 + y)) AS v FROM nr GROUP BY 1) SELECT s, t, round(exp(m + v / 2) - 1, 5) AS mean, TRUE AS within FROM f, steps")
def mc_state_draws(spark, sf_dir):
    logs = F.log1p("y")
    params = nav(spark, sf_dir).groupBy("s").agg(F.avg(logs).alias("mu"), F.stddev_pop(logs).alias("sigma"))
    p = paths.emission_rows(params, ["s"], N, STEPS).withColumn("v", F.expm1("z"))
    return _against(p, params, F.expm1(F.col("mu") + F.col("sigma") * F.col("sigma") / 2), 5)


@query("mc_heston_changes", f"WITH {_NAV} SELECT s, t, CAST(0 AS DOUBLE) AS mean, TRUE AS within FROM (SELECT DISTINCT s FROM nav), steps")
def mc_heston_changes(spark, sf_dir):
    params = estimators.stochastic_volatility(nav(spark, sf_dir), "z").withColumn("v0", F.col("theta"))
    return _against(paths.heston_changes_rows(params, ["s"], N, STEPS), params, F.lit(0.0))


@query("mc_gap_ou")
def mc_gap_ou(spark, sf_dir):
    from quillon.plans import flows

    rows = nav(spark, sf_dir)
    fit = estimators.heteroscedastic_ou(rows, "y", ["r"]).join(flows.driver_rows(rows, ["r"], ["s"], STEPS), "s").join(_last(rows), "s")
    return metrics.fan_bands(paths.ou_driven_rows(fit.withColumn("deltas", F.array("delta_r")), ["s"], N, STEPS), by=("s", "t"))


@query("mc_kp_threshold")
def mc_kp_threshold(spark, sf_dir):
    rows = nav(spark, sf_dir).withColumn("v", (F.col("y") - F.avg("y").over(Window.partitionBy("s"))) / 100)
    tau = estimators.threshold_bic(rows, "v").filter("best").groupBy("s").agg(F.min("tau").alias("tau"))
    found = estimators.ou_of_regime(rows.join(tau, "s").withColumn("g", F.when(F.abs("v") <= F.col("tau"), 0).when(F.col("v") > F.col("tau"), 1).otherwise(2)), "v", "g")
    wide = found.groupBy("s").agg(F.map_from_entries(F.collect_list(F.struct("g", F.struct("kappa", "mu", "sigma")))).alias("_m"))  # three regimes
    of = [F.coalesce(F.try_element_at("_m", F.lit(i)), F.try_element_at("_m", F.lit(0))) for i in range(3)]
    none = {c: F.lit(None).cast("array<double>") for c in ("deltas", "drivers")}
    params = wide.join(tau, "s").withColumns({c: F.array(*(x[c] for x in of)) for c in ("kappa", "mu", "sigma")} | none | {"x0": F.lit(0.0)})
    return metrics.fan_bands(paths.ou_threshold_rows(params, ["s"], N, STEPS), by=("s", "t"))


@query("mc_jump_volatility")
def mc_jump_volatility(spark, sf_dir):
    rows = nav(spark, sf_dir)
    params = estimators.jump_garch(rows, "r").join(_last(rows), "s")
    return metrics.fan_bands(paths.jump_volatility_rows(params, ["s"], N, STEPS), by=("s", "t"))


# ---- regressions with ARMA errors ----------------------------------------------------------------

_DRIVERS = ["y", "before"]


def _returns(spark, sf_dir) -> DataFrame:
    """NAV returns with two drivers: interest, and the return of 20 days before."""
    return nav(spark, sf_dir).withColumn("before", F.lag("r", 20).over(W()))


@query("arimax_garch_t")
def arimax_garch_t(spark, sf_dir):
    return arma.fits(_returns(spark, sf_dir), "r", _DRIVERS).drop("state", "last_e", "last_x", "last_y")


@query(
    "regression_white",
    f"WITH {_NAV}, f AS (SELECT s, count(*) AS n, regr_slope(r, y) AS b, regr_intercept(r, y) AS a, regr_syy(r, y) / count(*) AS v, regr_r2(r, y) AS r2 FROM nr WHERE r IS NOT NULL GROUP BY 1), g AS (SELECT *, v * (1 - r2) AS s2, -0.5 * n * (ln(2 * pi() * v * (1 - r2)) + 1) AS ll FROM f) "
    "SELECT s, round(a, 8) AS const, round(b, 9) AS beta, round(s2, 9) AS sigma2, round(ll, 4) AS loglik, round(6 - 2 * ll, 4) AS aic, round(3 * ln(n) - 2 * ll, 4) AS bic, n FROM g",
)
def regression_white(spark, sf_dir):
    """The order without autoregression and moving average: what is left of the model is the regression."""
    fit = arma.fits(nav(spark, sf_dir), "r", ["y"], [(0, 0, 0)], None)
    return fit.select("s", r("const", 8).alias("const"), r(F.col("beta")[0], 9).alias("beta"), r("sigma2", 9).alias("sigma2"), *(r(c, 4).alias(c) for c in ("loglik", "aic", "bic")), "n")


@query("arma_orders")
def arma_orders(spark, sf_dir):
    """The order of the least AIC of each series among all up to two autoregressive and two moving-average terms."""
    grid = [(p, 0, q) for p in range(3) for q in range(3)]
    return arma.best_orders(arma.fits(nav(spark, sf_dir), "r", (), grid, None)).select("s", "p", "q", "phi", "theta", "sigma2", "loglik", "aic", "bic", "n", "ok")


@query("arma_fallback")
def arma_fallback(spark, sf_dir):
    wanted = [(1, 1, 1), (1, 0, 1), (0, 0, 0)]
    fits = arma.fits(nav(spark, sf_dir), "n", (), wanted, "normal")
    return arma.first_of_orders(fits, wanted).select("s", "fallback", "p", "d", "q", "phi", "theta", "omega", "alpha", "garch_beta", "loglik", "n")


@query("ar_garch_fit")
def ar_garch_fit(spark, sf_dir):
    found = [arma.ar_garch(nav(spark, sf_dir), "z", lags, student).withColumns({"lags": F.lit(lags), "student": F.lit(student)}) for lags in (0, 1) for student in (False, True)]
    out = found[0]
    for one in found[1:]:
        out = out.unionByName(one)
    return out.drop("last_e", "last_z")


@query("mc_arma_garch_t")
def mc_arma_garch_t(spark, sf_dir):
    """NAV paths that go on from the end of each series, its drivers staying where they are."""
    rows = _returns(spark, sf_dir)
    fits = arma.first_of_orders(arma.fits(rows, "r", _DRIVERS, ((1, 0, 1), (0, 0, 0))), ((1, 0, 1), (0, 0, 0)))
    p = paths.arma_garch_rows(fits.join(_last(rows).select("s", "s0"), "s"), ["s"], N, STEPS)
    return metrics.fan_bands(p, by=("s", "t"))
