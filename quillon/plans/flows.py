"""The named flows, end to end: base simulation, regimes to scenarios, simulation by scenario and regime, model contests."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.functions import lineage, series
from quillon.operators import arma, estimators, metrics, paths, regime, scenario
from quillon.settings import Settings


def _keyed(history: DataFrame, by: Sequence[str]) -> tuple[DataFrame, list[str]]:
    return (history, list(by)) if by else (history.withColumn("only_series", F.lit(0)), ["only_series"])


def driver_rows(history: DataFrame, columns: Sequence[str], keys: Sequence[str], steps: int, order: str = "d", clip: float = 3.0) -> DataFrame:
    """(keys, drivers): the first `steps` complete rows of the drivers of each series as clipped z-scores of its history, one after the other."""
    w = Window.partitionBy(*keys)
    rows = history.select(*keys, order, *(series.zscore_clip(F.col(c), w, clip).alias(f"_z{i}") for i, c in enumerate(columns))).dropna()
    cells = F.struct(F.col("_n"), F.array(*(f"_z{i}" for i in range(len(columns)))).alias("z"))
    rows = rows.withColumn("_n", F.row_number().over(w.orderBy(order))).filter(F.col("_n") <= steps)
    return rows.groupBy(*keys).agg(F.flatten(F.transform(F.array_sort(F.collect_list(cells)), lambda c: c["z"])).alias("drivers"))


#: The orders of a NAV model: the wanted one, and what is taken where its fit fails.
NAV_ORDERS = ((1, 0, 1), (0, 0, 0))


def base_simulation(spark: SparkSession, history: DataFrame, settings: Settings | None = None, gap_drivers: Sequence[str] = (), kp_drivers: Sequence[str] = (), nav_drivers: Sequence[str] = (), by: Sequence[str] = ()) -> dict[str, DataFrame]:
    """NAV, premium and local-premium paths fitted on histories (by, d, nav, gap, kp, drivers), combined and evaluated.

    Without `by` there is one history. NAV returns are a regression on their drivers with ARMA errors
    and t-GARCH; their paths go on from the last observed state, drivers staying where they are. With
    drivers the volatility of the premium follows them, and the local premium reverts in three
    regimes, around the threshold of the least BIC, each with a volatility that follows its drivers.
    Parameters are a row a series, and the paths of all series are generated in one job each.
    """
    settings = settings or Settings()
    history, keys = _keyed(history, by)
    rows = history.withColumn("r", series.log_return(F.col("nav"), series.ordered(tuple(keys))))
    first = history.groupBy(*keys).agg(*(F.min_by(c, "d").alias(x) for c, x in (("nav", "s0"), ("gap", "g0"), ("kp", "k0"))))
    n, steps, seed = settings.base_paths, settings.base_steps, settings.seed
    fits = arma.first_of_orders(arma.fits(rows, "r", nav_drivers, NAV_ORDERS, "t", keys), NAV_ORDERS, keys)
    nav = paths.arma_garch_rows(fits.join(first.select(*keys, "s0"), keys), keys, n, steps, seed=seed)
    if gap_drivers:
        o = estimators.heteroscedastic_ou(history, "gap", gap_drivers, by=keys).join(driver_rows(history, gap_drivers, keys, steps), keys).join(first, keys)
        gap = paths.ou_driven_rows(o.withColumns({"x0": F.col("g0"), "deltas": F.array(*(f"delta_{c}" for c in gap_drivers))}), keys, n, steps, seed=seed + 10_000)
    else:
        gap = paths.ou_rows(estimators.ou_ols(history, "gap", keys).join(first, keys).withColumn("x0", F.col("g0")), keys, n, steps, seed=seed + 10_000)
    if kp_drivers:
        best = estimators.threshold_bic(history, "kp", by=keys).filter("best").groupBy(*keys).agg(F.min("tau").alias("tau"))
        found = estimators.threshold_ou(history.join(best, keys), "kp", kp_drivers, "tau", by=keys)
        cell = F.struct("kappa", "mu", "sigma", F.array(*(f"delta_{c}" for c in kp_drivers)).alias("deltas"))
        found = found.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct(F.col("regime").cast("int"), cell))).alias("_m"))  # three regimes
        of = [F.coalesce(F.try_element_at("_m", F.lit(i)), F.try_element_at("_m", F.lit(0))) for i in range(3)]
        arrays = {c: F.array(*(x[c] for x in of)) for c in ("kappa", "mu", "sigma")} | {"deltas": F.flatten(F.array(*(x["deltas"] for x in of))), "x0": F.col("k0")}
        k = found.join(best, keys).join(first, keys).join(driver_rows(history, kp_drivers, keys, steps), keys).withColumns(arrays)
        kp = paths.ou_threshold_rows(k, keys, n, steps, seed=seed + 20_000)
    else:
        kp = paths.ou_rows(estimators.ou_ols(history, "kp", keys).join(first, keys).withColumn("x0", F.col("k0")), keys, n, steps, seed=seed + 20_000)
    etf = metrics.anchored_product(nav, gap, kp, settings.anchor, keys)
    found = {"nav": nav, "gap": gap, "kp": kp, "etf": etf, "fan": metrics.fan_bands(etf, by=(*keys, "t")), "risk": metrics.scenario_risk(etf, keys)}
    return found if by else {name: x.drop(*keys) for name, x in found.items()}


def regimes_to_scenarios(regimes: DataFrame, variables: Sequence[str], states: Sequence[int] = (0, 1, 2), most_shared: int = 1, judgements: DataFrame | None = None) -> dict[str, DataFrame]:
    """Long regimes to lifts, ranked combinations and the selected scenarios with their days."""
    table = scenario.wide(regimes, variables)
    lifts = scenario.pairwise_lift(regimes)
    combos = scenario.enumerate_combos({v: states for v in variables}, regimes.sparkSession)
    ranked = scenario.rank_combos(scenario.classify(combos, lifts, variables, judgements), scenario.joint_frequency(table, variables), variables)
    chosen = scenario.greedy_diversity(ranked, variables, most_shared)
    return {"lifts": lifts, "ranked": ranked, "scenarios": chosen, "days": scenario.scenario_days(table, chosen, variables)}


def scenario_simulation(spark: SparkSession, values: DataFrame, days: DataFrame, value: str, settings: Settings | None = None) -> DataFrame:
    """Fan bands per scenario of a mean-reverting series whose volatility is that of the scenario's days; all scenarios in one job."""
    settings = settings or Settings()
    sigmas = estimators.sigma_per_scenario(days, values, value).groupBy("scenario_id").agg(F.avg("sigma").alias("_s"))
    fit = estimators.ou_ols(values, value).agg(F.avg("kappa").alias("kappa"), F.avg("mu").alias("mu"))
    rows = sigmas.crossJoin(F.broadcast(fit))  # one row
    params = rows.select("scenario_id", F.col("mu").alias("x0"), F.least("kappa", F.lit(1.9)).alias("kappa"), "mu", (F.col("_s") / 252**0.5).alias("sigma"))
    return metrics.fan_bands(paths.ou_rows(params, ["scenario_id"], settings.regime_paths, settings.scenario_steps, settings.seed), by=("scenario_id", "t"))


def scenario_pipeline(scenarios: DataFrame, fits: DataFrame, variables: Sequence[str], inverse: Mapping[str, str] | None = None, settings: Settings | None = None) -> dict[str, DataFrame]:
    """Draws of every variable of every scenario (z: scale of the model, v: original scale), and their summaries; `fits` as for `scenario.emissions`."""
    settings = settings or Settings()
    params = scenario.emissions(scenarios, fits, variables, inverse)
    draws = paths.emission_rows(params, ["scenario_id", "variable", "inverse"], settings.base_paths, settings.scenario_steps, settings.seed)
    draws = draws.withColumn("v", regime.back_transformed(F.col("z"), F.col("inverse"))).drop("inverse")
    named = draws.withColumnRenamed("variable", "series")
    return {"draws": draws, "summary": scenario.summary_by_scenario(named), "summary_model": scenario.summary_by_scenario(named.withColumn("v", F.col("z")))}


def regime_simulation(drivers: DataFrame, target: Mapping[str, float], settings: Settings | None = None, by: str = "s", group: Sequence[str] = ()) -> dict[str, DataFrame]:
    """Two driver series (group, s, d, value, regime) to the paths of a level they drive, per group and regime, and its risk.

    Mean reversion of each driver and regime comes from the pairs of neighbouring days, the
    correlation of shocks from their residuals (0 with fewer than three common days); `target` holds
    x0, kappa, mu, sigma0, delta1, delta2 of the level. Regimes without a fit of both drivers go.
    """
    settings = settings or Settings()
    keys = [*group, "regime"]
    pairs = estimators.consecutive_pairs(drivers, "value", "regime", [*group, by])
    fits = estimators.ou_by_regime(pairs, by=[*group, by])
    order = F.row_number().over(series.ordered(("regime",), (by,)) if not group else Window.partitionBy(*keys).orderBy(by))
    fits = fits.withColumn("_k", order).groupBy(*keys).pivot("_k", [1, 2]).agg(F.max("theta").alias("th"), F.max("mu").alias("m"), F.max("sigma").alias("s")).dropna()
    e = estimators.regime_residuals(pairs, [*group, by])
    wide = e.groupBy(*group, "d", "regime").agg(F.min_by("e", by).alias("a"), F.max_by("e", by).alias("b"), F.count("*").alias("n")).filter("n = 2")
    rho = wide.groupBy(*keys).agg(F.when(F.count("*") < 3, 0.0).otherwise(F.coalesce(F.corr("a", "b"), F.lit(0.0))).alias("rho"))
    params = fits.select(*keys, *(F.col(f"{k}_{c}").alias(f"{c}{k}") for k in (1, 2) for c in ("th", "m", "s"))).join(rho, keys, "left").na.fill(0.0, ["rho"])
    params = params.withColumns({k: F.lit(float(v)) for k, v in target.items()})
    found = paths.driven_rows(params, keys, settings.base_paths, settings.scenario_steps, seed=settings.seed)
    return {"params": params, "paths": found, "risk": metrics.scenario_risk(found.withColumn("v", 1 + F.col("v")), keys)}


def detect_regimes(df: DataFrame, value: str, starts: int = 10, replicates: int = 1_000, by: Sequence[str] = ("s",), transform: str = "none", order: str = "d") -> DataFrame:
    """best_k and the fit of that many states of each series, of the value or its log or log1p."""
    df = df.withColumn(value, regime.transformed(F.col(value), transform))
    fits, chosen = regime.choose_states(df, value, starts, replicates, by=by, order=order)
    return fits.join(chosen.select(*by, "best_k"), list(by)).filter("k = best_k")


def regime_frame(daily: DataFrame, weekly: DataFrame, day_columns: Mapping[str, str], week_columns: Mapping[str, str], har_column: str, starts: int = 10, replicates: int = 1_000, counts: DataFrame | None = None, by: Sequence[str] = ("s",)) -> dict[str, DataFrame]:
    """The states of all variables on the daily calendar, as numbers and as labels.

    Daily and weekly columns are given with their transformation (none, log, log1p); of
    `har_column` it is the standardised residual of its day, week and month regression that has
    regimes. All series are fitted together; the fits are kept in the checkpoint folder. `counts` (by,
    variable, k), as of `regime.counted_states`, fixes the number of states without a test.
    """
    keys = [*by, "variable"]
    long = lambda rows, name, kind: rows.select(*by, "d", F.lit(name).alias("variable"), regime.transformed(F.col(name).cast("double"), kind).alias("value"))
    residual = f"{har_column}_resid"
    parts = [long(daily, c, kind) for c, kind in day_columns.items()]
    parts.append(regime.har(daily, har_column, by).select(*by, "d", F.lit(residual).alias("variable"), F.col("z").alias("value")))
    parts += [long(weekly, c, kind) for c, kind in week_columns.items()]
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    rows = rows.filter("value is not null")
    fits = detect_regimes(rows, "value", starts, replicates, keys) if counts is None else regime.hmm_regimes(rows, "value", counts, starts, by=keys)
    fits = lineage.cut(fits)  # a row a series, slow to make, and read by all that follows
    states = regime.state_series(rows, fits, "value", keys)
    of = lambda names: states.filter(F.col("variable").isin(list(names)))
    variables = [*day_columns, residual, *week_columns]
    table = scenario.regime_calendar(daily, of([*day_columns, residual]), of(week_columns), variables, by)
    labels = scenario.label_table(states, [residual])
    return {"fits": fits, "states": states, "table": table, "labelled": scenario.labelled(table, labels, variables)}


def validation_grid(history: DataFrame, settings: Settings | None = None, by: Sequence[str] = ()) -> DataFrame:
    """The tests of fund returns of two NAV models times two premium models against the true ones; `history` is (by, d, nav, gap, etf).

    The fund starts at nav (1 + gap) and follows the simulated product by a step. Every model of
    every series is fitted and simulated once, whatever it is combined with.
    """
    settings = settings or Settings()
    history, keys = _keyed(history, by)
    w = series.ordered(tuple(keys))
    rows = history.withColumns({"r": series.log_return(F.col("nav"), w), "z": series.diff(F.col("gap"), w)})
    first = rows.groupBy(*keys).agg(F.min_by("nav", "d").alias("nav0"), F.min_by("gap", "d").alias("gap0"), (F.count("*") - 1).alias("steps"))
    named = lambda fit, prefix: fit.select(*keys, *(F.col(c).alias(prefix + c) for c in paths.GRID[prefix]))
    on = lambda fit: fit.join(first, keys)
    h = on(estimators.heston_moments(rows, "r", keys)).withColumn("s0", F.col("nav0"))
    g = on(arma.first_of_orders(arma.fits(rows, "r", (), NAV_ORDERS, "normal", keys), NAV_ORDERS, keys)).withColumns({"s0": F.col("nav0"), "ahead": F.lit(None).cast("array<double>")})
    c = estimators.stochastic_volatility(rows, "z", keys).withColumn("v0", F.col("theta"))
    o = on(estimators.ou_ols(rows, "gap", keys)).withColumn("x0", F.col("gap0"))
    params = first.filter("steps > 0")
    for fit, prefix in ((h, "h_"), (g, "g_"), (c, "c_"), (o, "o_")):
        params = params.join(named(fit, prefix), keys)
    changes = paths.delayed_grid_rows(params, keys, settings.base_paths, settings.seed)
    actual = history.select(*keys, (F.row_number().over(w) - 1).alias("t"), series.log_return(F.col("etf"), w).alias("a")).filter("a is not null")
    models = [*keys, "nav_model", "gap_model"]
    out = metrics.tests_of_steps(metrics.step_tests(changes, actual, by=models, actual_by=keys), models)
    return out if by else out.drop(*keys)
