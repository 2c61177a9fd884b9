"""Validation of the mean-reverting drivers of regime simulations: their moments, stationarity, autocorrelation, and what a fit finds again in simulated paths."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.operators import estimators, paths, regime, stats


def parameter_check(values: DataFrame, by: Sequence[str] = ("s",), dt: float = 1 / 252) -> DataFrame:
    """theta, mu, sigma, r2 and n of each series and regime beside the mean and sample deviation of its values; `values` is (by, d, value, regime)."""
    fits = estimators.ou_by_regime(estimators.consecutive_pairs(values, "value", "regime", by), dt, by)
    seen = values.filter("value is not null").groupBy(*by, "regime").agg(F.avg("value").alias("orig_mean"), F.stddev_samp("value").alias("orig_std"), F.count("*").alias("n_values"))
    return fits.join(seen, [*by, "regime"]).select(*by, "regime", "theta", "mu", "sigma", "r2", "n", "orig_mean", "orig_std", "n_values")


def stationarity(values: DataFrame, by: Sequence[str] = ("s",), level: float = 0.05) -> DataFrame:
    """The unit-root test of the values of each series and regime in their order; null where there are too few to test."""
    keys = [*by, "regime"]
    tested = regime.adf(values, "value", keys)
    return values.select(*keys).distinct().join(tested, keys, "left").select(*keys, "stat", "p", "lags", (F.col("p") < level).alias("stationary"))


def autocorrelations(values: DataFrame, fits: DataFrame, lags: int = 20, by: Sequence[str] = ("s",), dt: float = 1 / 252) -> DataFrame:
    """(by, regime, lag, acf, theory): the autocorrelation of a regime's values in their order, and exp(-theta lag dt); regimes of lags + 2 values or fewer go."""
    keys = [*by, "regime"]
    rows = values.filter("value is not null")
    large = rows.groupBy(*keys).agg(F.count("*").alias("_n")).filter(F.col("_n") > lags + 2).select(*keys)
    seen = stats.autocorrelation(rows.join(large, keys), "value", lags, keys, ["d"])
    theory = F.exp(-F.greatest(F.col("theta"), F.lit(1e-6)) * F.col("lag") * dt)
    return seen.join(fits.select(*keys, "theta"), keys).select(*keys, "lag", "acf", theory.alias("theory"))


def reestimated(fits: DataFrame, n: int, steps: int, by: Sequence[str] = ("s",), dt: float = 1 / 252, seed: int = 42) -> DataFrame:
    """(by, regime, parameter, fitted, again, deviation, n_paths): the fits of `n` simulated paths of each row of parameters.

    Paths start at the level mu. Every path is fitted from its sums of products, all in one
    aggregation; `again` and `deviation` are the mean and sample deviation over paths.
    """
    keys = [*by, "regime"]
    params = fits.select(*keys, F.col("mu").alias("x0"), (F.col("theta") * dt).alias("kappa"), "mu", (F.col("sigma") * F.lit(dt**0.5)).alias("sigma"))
    p = paths.ou_rows(params, keys, n, steps, seed)
    path = [*by, "_path"]  # the regime is part of it, so that the rows of a path are of one regime
    pairs = estimators.consecutive_pairs(p.withColumn("_path", F.struct("regime", "sim_id")), "v", "regime", path, "t")
    again = estimators.ou_by_regime(pairs, dt, path)
    cells = lambda c: F.explode(F.array(*(F.struct(F.lit(k).alias("parameter"), F.col(k).alias(c)) for k in ("theta", "mu", "sigma")))).alias("_c")
    found = again.select(*keys, cells("v")).select(*keys, "_c.*").groupBy(*keys, "parameter").agg(F.avg("v").alias("again"), F.stddev_samp("v").alias("deviation"), F.count("v").alias("n_paths"))
    return fits.select(*keys, cells("fitted")).select(*keys, "_c.*").join(found, [*keys, "parameter"])


def validate(values: DataFrame, n: int = 1_000, steps: int = 252, lags: int = 20, by: Sequence[str] = ("s",), dt: float = 1 / 252, seed: int = 42) -> dict[str, DataFrame]:
    """The tables of all checks, and `table`: a row a series, regime and parameter with what was fitted, what the values show, and what a fit finds again."""
    keys = [*by, "regime"]
    check = parameter_check(values, by, dt)
    adf = stationarity(values, by)
    again = reestimated(check, n, steps, by, dt, seed)
    seen = F.when(F.col("parameter") == "mu", F.col("orig_mean")).when(F.col("parameter") == "sigma", F.col("orig_std"))
    table = again.join(check.select(*keys, "orig_mean", "orig_std", "n"), keys).join(adf.select(*keys, F.col("stat").alias("adf_stat"), F.col("p").alias("adf_p"), "stationary"), keys, "left")
    table = table.select(*keys, "parameter", "fitted", seen.alias("observed"), "again", "deviation", "n_paths", "n", "adf_stat", "adf_p", "stationary")
    return {"parameters": check, "adf": adf, "acf": autocorrelations(values, check, lags, by, dt), "again": again, "table": table}
