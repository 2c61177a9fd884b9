"""Path and distribution metrics on long path tables (sim_id, t, v) against an actual series (t, a)."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from quillon.functions import distributions, series
from quillon.operators import paths, stats

#: Half widths and weights of the capture bands.
BANDS = ((0.2, 5.0), (0.3, 4.0), (0.4, 3.0), (0.5, 2.0), (0.6, 1.0))


def _path() -> WindowSpec:
    return Window.partitionBy("sim_id").orderBy("t")


def fan_bands(paths: DataFrame, levels: Sequence[float] = (0.05, 0.25, 0.5, 0.75, 0.95), by: Sequence[str] = ("t",)) -> DataFrame:
    """Mean and exact percentiles of the cross-section at each step."""
    out = paths.groupBy(*by).agg(F.avg("v").alias("mean"), F.percentile("v", F.array(*map(F.lit, levels))).alias("_q"))
    return out.select(*by, "mean", *(F.col("_q")[i].alias(f"p{round(100 * p):02d}") for i, p in enumerate(levels)))


def terminal(paths: DataFrame) -> DataFrame:
    """The last value of each path."""
    return paths.groupBy("sim_id").agg(F.max_by("v", "t").alias("v"))


def tail_risk(values: DataFrame, alpha: float = 0.05) -> DataFrame:
    """mean, median, VaR and CVaR (mean of the values at or below it) of column v."""
    cut = values.agg(F.percentile("v", alpha).alias("var"))
    one = values.crossJoin(F.broadcast(cut))  # one row
    return one.agg(F.avg("v").alias("mean"), F.median("v").alias("median"), F.max("var").alias("var"), F.avg(F.when(F.col("v") <= F.col("var"), F.col("v"))).alias("cvar"))


def max_drawdown(paths: DataFrame) -> DataFrame:
    return paths.withColumn("_dd", series.drawdown(F.col("v"), _path())).groupBy("sim_id").agg(F.min("_dd").alias("mdd"))


def pit(paths: DataFrame, actual: DataFrame) -> DataFrame:
    """u per step: the share of simulated values that do not exceed the actual one."""
    return paths.join(actual, "t").groupBy("t").agg(F.avg((F.col("v") <= F.col("a")).cast("double")).alias("u"))


def ks_uniform(u: DataFrame) -> DataFrame:
    """n and the Kolmogorov-Smirnov distance of u from the uniform distribution.

    Ranks are counted on the distinct values of u, of which there are at most as many as steps.
    """
    n = F.count("*").over(Window.partitionBy())
    i = F.row_number().over(Window.orderBy("u", "t"))
    return u.select("u", i.alias("i"), n.alias("n")).agg(F.max("n").alias("n"), F.max(F.greatest(F.col("i") / F.col("n") - F.col("u"), F.col("u") - (F.col("i") - 1) / F.col("n"))).alias("d"))


def value_at_risk(paths: DataFrame, actual: DataFrame, alpha: float) -> DataFrame:
    """Per step: actual a, VaR, expected shortfall, and whether the actual value falls below the VaR."""
    cut = paths.groupBy("t").agg(F.percentile("v", alpha).alias("var"))
    es = paths.join(cut, "t").groupBy("t").agg(F.max("var").alias("var"), F.coalesce(F.avg(F.when(F.col("v") <= F.col("var"), F.col("v"))), F.min("v")).alias("es"))
    return es.join(actual, "t").withColumn("hit", (F.col("a") < F.col("var")).cast("int"))


def kupiec(days: DataFrame, alpha: float, guarded: bool = False) -> DataFrame:
    """t, x (violations) and the likelihood ratio of unconditional coverage, 0 ln 0 taken as 0.

    `guarded`: without violations the ratio is 0, with nothing but violations it is infinite.
    """
    one = days.agg(F.count("*").alias("n"), F.sum("hit").alias("x"))
    n, x = F.col("n"), F.col("x")
    p = x / n
    part = lambda k, q: F.when(k > 0, k * F.ln(q)).otherwise(0.0)
    null = x * F.ln(F.lit(alpha)) + (n - x) * F.ln(F.lit(1 - alpha))
    lr = F.greatest(F.lit(0.0), -2 * (null - part(x, p) - part(n - x, 1 - p)))
    if guarded:
        lr = F.when(x == 0, 0.0).when(x == n, float("inf")).otherwise(lr)
    return one.select("n", "x", lr.alias("lr"))


def kupiec_test(days: DataFrame, alpha: float, guarded: bool = False) -> DataFrame:
    """`kupiec` with the p-value of one degree of freedom and the rate of violations."""
    return kupiec(days, alpha, guarded).withColumns({"p": distributions.chi2_tail(F.col("lr"), F.lit(1)), "rate": F.col("x") / F.nullif(F.col("n"), F.lit(0))})


def es_tail_error(days: DataFrame, empty: float | None = None) -> DataFrame:
    """Violations, their mean actual value and expected shortfall, and the distance of both; `empty` without violations."""
    one = days.filter("hit = 1").agg(F.count("*").alias("x"), F.avg("a").alias("mean_actual"), F.avg("es").alias("mean_es"), F.avg(F.col("a") - F.col("es")).alias("tail_error"))
    other = F.lit(empty).cast("double")
    return one.select("x", *(F.coalesce(c, other).alias(c) for c in ("mean_actual", "mean_es", "tail_error")))


def pit_ks_test(u: DataFrame) -> DataFrame:
    """`ks_uniform` with its p-value (exact up to 2,000 steps)."""
    return ks_uniform(u).withColumn("p", distributions.ks_tail(F.col("d"), F.col("n").cast("int")))


def statistical_tests(paths: DataFrame, actual: DataFrame, alpha: float = 0.05, guarded: bool = False, level: float = 0.05) -> DataFrame:
    """One row: uniformity of the PIT, coverage of the VaR, the shortfall on violation days, and is_valid (both p-values above `level`).

    `guarded` is the variant with a ratio of 0 and a tail error of 0 where nothing is violated.
    """
    days = value_at_risk(paths, actual, alpha)
    ks = pit_ks_test(pit(paths, actual)).select(F.col("d").alias("ks"), F.col("p").alias("ks_p"))
    cover = kupiec_test(days, alpha, guarded).select("n", F.col("x").alias("violations"), "rate", "lr", F.col("p").alias("lr_p"))
    tail = es_tail_error(days, 0.0 if guarded else None).drop("x")
    one = ks.crossJoin(F.broadcast(cover)).crossJoin(F.broadcast(tail))  # one row each
    return one.withColumn("is_valid", (F.col("ks_p") > level) & (F.col("lr_p") > level))


def step_tests(paths: DataFrame, actual: DataFrame, alpha: float = 0.05, by: Sequence[str] = (), actual_by: Sequence[str] = ()) -> DataFrame:
    """(by, t, a, u, var, es, hit) of each step: what `pit` and `value_at_risk` give, for many models at once and in one pass over the paths.

    A group is the simulations of one step of one model, sorted. `actual` is (actual_by, t, a), `actual_by` being some of `by`.
    """
    rows = paths.groupBy(*by, "t").agg(F.sort_array(F.collect_list("v")).alias("_s")).join(actual, [*actual_by, "t"])
    s, a = F.col("_s"), F.col("a")
    at = (F.size(s) - 1) * F.lit(alpha)
    lo = F.floor(at).cast("int")
    var = s[lo] + (at - lo) * (s[F.least(lo + 1, F.size(s) - 1)] - s[lo])
    rows = rows.withColumn("var", var)
    tail = F.filter(s, lambda x: x <= F.col("var"))
    es = F.aggregate(tail, F.lit(0.0), lambda t, x: t + x) / F.nullif(F.size(tail), F.lit(0))
    u = F.size(F.filter(s, lambda x: x <= a)) / F.size(s)
    return rows.select(*by, "t", "a", u.alias("u"), "var", F.coalesce(es, s[0]).alias("es"), (a < F.col("var")).cast("int").alias("hit"))


def tests_of_steps(steps: DataFrame, by: Sequence[str], alpha: float = 0.05, guarded: bool = False, level: float = 0.05) -> DataFrame:
    """`statistical_tests` of each model from the rows of `step_tests`, all models in one job; the window of a model is its steps."""
    w = Window.partitionBy(*by)
    i, n = F.row_number().over(w.orderBy("u", "t")), F.count("*").over(w)
    d = F.greatest(F.col("_i") / F.col("_n") - F.col("u"), F.col("u") - (F.col("_i") - 1) / F.col("_n"))
    hit = F.col("hit") == 1
    rows = steps.withColumns({"_i": i, "_n": n}).groupBy(*by).agg(
        F.max(d).alias("ks"), F.count("*").alias("n"), F.sum("hit").alias("violations"),
        *(F.avg(F.when(hit, x)).alias(name) for name, x in (("mean_actual", F.col("a")), ("mean_es", F.col("es")), ("tail_error", F.col("a") - F.col("es")))),
    )
    x, n = F.col("violations"), F.col("n")
    p = x / n
    part = lambda k, q: F.when(k > 0, k * F.ln(q)).otherwise(0.0)
    lr = F.greatest(F.lit(0.0), -2 * (x * math.log(alpha) + (n - x) * math.log(1 - alpha) - part(x, p) - part(n - x, 1 - p)))
    if guarded:
        lr = F.when(x == 0, 0.0).when(x == n, float("inf")).otherwise(lr)
        rows = rows.na.fill(0.0, ["mean_actual", "mean_es", "tail_error"])
    rows = rows.withColumns({"rate": p, "lr": lr}).withColumns({"ks_p": distributions.ks_tail(F.col("ks"), F.col("n").cast("int")), "lr_p": distributions.chi2_tail(F.col("lr"), F.lit(1))})
    names = ["ks", "ks_p", "n", "violations", "rate", "lr", "lr_p", "mean_actual", "mean_es", "tail_error"]
    return rows.select(*by, *names, ((F.col("ks_p") > level) & (F.col("lr_p") > level)).alias("is_valid"))


def var_es_comparison(x: DataFrame, y: DataFrame, alpha: float = 0.05) -> DataFrame:
    """VaR and ES at `alpha` of both samples (x: actual), and how near those of y come."""
    one = tail_risk(x, alpha).select(F.col("var").alias("actual_var"), F.col("cvar").alias("actual_es"))
    two = tail_risk(y, alpha).select(F.col("var").alias("sim_var"), F.col("cvar").alias("sim_es"))
    both = one.crossJoin(F.broadcast(two))  # one row each
    return both.withColumns({"var_proximity": proximity(F.col("actual_var"), F.col("sim_var")), "es_proximity": proximity(F.col("actual_es"), F.col("sim_es"))})


def volatility_scores(paths: DataFrame, actual: DataFrame) -> DataFrame:
    """vvs, vpr: how near the deviation of absolute changes is (0 to 1), and the ratio of the autocovariances; means over paths of full length.

    Both are of the series given, as a rule realised volatilities; without a scale they are 0.
    """
    a = volatility_of_changes(actual.withColumn("_one", F.lit(1)), "a", ["_one"]).select(F.col("vv").alias("_va"), F.col("persistence").alias("_pa"))  # one series
    steps = actual.agg(F.count("*").alias("_t"))
    size = paths.groupBy("sim_id").agg(F.count("*").alias("_n"))
    p = volatility_of_changes(paths, "v", ["sim_id"]).join(size, "sim_id").crossJoin(F.broadcast(steps))  # one row
    p = p.agg(F.avg("vv").alias("_vs"), F.avg(F.when(F.col("_n") == F.col("_t"), F.col("persistence"))).alias("_ps"))
    one = p.crossJoin(F.broadcast(a))
    vvs = 1 - F.abs(F.col("_vs") - F.col("_va")) / F.nullif(F.col("_vs") + F.col("_va"), F.lit(0.0))
    return one.select(F.greatest(F.lit(0.0), F.coalesce(vvs, F.lit(0.0))).alias("vvs"), F.coalesce(F.col("_ps") / F.nullif(F.col("_pa"), F.lit(0.0)), F.lit(0.0)).alias("vpr"))


def legacy_capture(pair: DataFrame, window: int | None = None, share: float = 0.6, by: Sequence[str] = ()) -> DataFrame:
    """Mean rolling correlation of a and v (t, a, v), later windows weighing more, minus `share` of the mean autocorrelation of a.

    Windows of a tenth of the steps, at least 10, or as given; those without variation are left
    out, and without any the score is 0. Autocorrelations are of lags 1 to 5 (to n / 4 at most).
    """
    by = list(by)
    keyed = pair if by else pair.withColumn("_one", F.lit(1))  # one short series
    keys = by or ["_one"]
    w = Window.partitionBy(*keys)
    rows = keyed.withColumns({"_n": F.count("*").over(w), "_i": F.row_number().over(w.orderBy("t"))})
    size = F.lit(window) if window else F.greatest(F.lit(10), F.floor(F.col("_n") / 10))
    rows = rows.withColumn("_w", size.cast("bigint"))
    # Windowed sums of n, v, a, vv, aa, va as differences of running sums of centred values.
    c = {k: F.col(k) - F.avg(k).over(w) for k in ("v", "a")}
    rows = rows.withColumns({"_v": c["v"], "_a": c["a"]})
    o = w.orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    parts = {"v": F.col("_v"), "a": F.col("_a"), "vv": F.col("_v") ** 2, "aa": F.col("_a") ** 2, "va": F.col("_v") * F.col("_a")}
    rows = rows.withColumn("_c", F.struct(*(F.sum(x).over(o).alias(k) for k, x in parts.items())))
    before = rows.select(*keys, (F.col("_i") + F.col("_w")).alias("_i"), F.col("_c").alias("_b"))
    rows = rows.join(before, [*keys, "_i"], "left").filter(F.col("_i") >= F.col("_w"))
    s = {k: (F.col("_c")[k] - F.coalesce(F.col("_b")[k], F.lit(0.0))) / F.col("_w") for k in parts}
    var_v, var_a = s["vv"] - s["v"] ** 2, s["aa"] - s["a"] ** 2
    corr = F.when((var_v > 1e-12) & (var_a > 1e-12), (s["va"] - s["v"] * s["a"]) / F.sqrt(var_v * var_a))
    rows = rows.withColumns({"_corr": corr, "_k": F.col("_i") - F.col("_w") + 1}).filter("_corr is not null")
    mean = rows.groupBy(*keys).agg((F.sum(F.col("_corr") * F.col("_k")) / F.sum("_k")).alias("_mean"))
    acf = stats.autocorrelation(keyed, "a", 5, keys, ["t"]).join(keyed.groupBy(*keys).agg(F.count("*").alias("_n")), keys)
    acf = acf.filter((F.col("lag") > 0) & (F.col("lag") <= F.floor(F.col("_n") / 4))).groupBy(*keys).agg(F.avg("acf").alias("_acf"))
    out = keyed.select(*keys).distinct().join(mean, keys, "left").join(acf, keys, "left")
    score = F.when(F.col("_mean").isNull(), 0.0).otherwise(F.col("_mean") - share * F.coalesce("_acf", F.lit(0.5)))
    return out.select(*by, score.alias("wmcr"))


def all_metrics(levels: DataFrame, level: DataFrame, returns: DataFrame, actual: DataFrame, sim_id: int = 0, n: int = 20, single: bool = False) -> DataFrame:
    """Every comparison of simulated paths (levels, returns: sim_id, t, v) with the actual ones (level, actual: t, a), as (metric, value).

    Path measures are of the representative path `sim_id`, the others of all paths. With `single`
    only that path is looked at: capture rates are the legacy ones, and the scores of volatilities
    are those of the returns themselves, as the method without simulations has them.
    """
    one_level, one = levels.filter(F.col("sim_id") == sim_id), returns.filter(F.col("sim_id") == sim_id)
    used = one if single else returns
    vols = realised_volatility(used, "v", ["sim_id"], n=n).select("sim_id", "t", F.col("rv").alias("v"))
    vol = realised_volatility(actual.withColumn("_one", F.lit(1)), "a", ["_one"], n=n).select("t", F.col("rv").alias("a"))
    one_vol = vols.filter(F.col("sim_id") == sim_id)
    sample = lambda d, c: d.select(F.col(c).alias("v"))
    x, y = sample(actual, "a"), sample(one, "v")
    pair = lambda p, a: p.join(a, "t").select("t", "a", "v")
    capture = lambda p, a: legacy_capture(pair(p, a)) if single else wmcr(p, a)
    scored = (one, actual) if single else (vols, vol)
    rows = [
        paths.dtw(one_level, level).select(F.col("dtw").alias("dtw_price")),
        capture(one_level if single else levels, level).select(F.col("wmcr").alias("wmcr_price")),
        paths.dtw(one_vol, vol).select(F.col("dtw").alias("dtw_vol")),
        capture(vols, vol).select(F.col("wmcr").alias("wmcr_vol")),
        path_match(one_level, level).select("pmc"),
        volatility_regression(one, actual, n).select(F.col("r2").alias("rvr_r2"), F.col("beta").alias("rvr_beta"), F.col("beta_gap").alias("rvr_beta_gap")),
        volatility_scores(*scored),
        jump_coincidence(*scored).agg(F.coalesce(F.avg("vjc"), F.lit(0.0)).alias("vjc")),
        tail_weighted_distance(x, y),
        ks_two_sample(x, y).select(F.col("d").alias("ks"), F.col("p").alias("ks_p")),
        moments_proximity(x, y).select(*(F.col(c).alias(f"{c}_proximity") for c in ("mean", "median", "std"))),
        var_es_comparison(x, y).select("var_proximity", "es_proximity"),
    ]
    out = None
    for row in rows:
        cells = row.select(F.explode(F.array(*(F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in row.columns))).alias("m")).select("m.*")
        out = cells if out is None else out.unionByName(cells)
    return out


def pit_ljung_box(u: DataFrame, lags: int = 10, by: Sequence[str] = ()) -> DataFrame:
    """n, lags, q and p of the portmanteau test of u (by, t, u), clipped to stay off 0 and 1.

    The lags are at most `lags` and n / 2 - 1, at least one; steps of a model are one short window.
    """
    keyed = u if by else u.withColumn("_one", F.lit(1))
    keys = list(by) or ["_one"]
    rows = keyed.withColumn("_u", F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), F.col("u"))))
    n = rows.groupBy(*keys).agg(F.count("_u").alias("n"))
    h = F.greatest(F.lit(1), F.least(F.lit(lags), F.floor(F.col("n") / 2).cast("int") - 1))
    acf = stats.autocorrelation(rows, "_u", lags, keys, ["t"]).join(n.withColumn("lags", h), keys).filter((F.col("lag") > 0) & (F.col("lag") <= F.col("lags")))
    q = acf.groupBy(*keys, "n", "lags").agg(F.sum(F.col("acf") * F.col("acf") / (F.col("n") - F.col("lag"))).alias("_q"))
    q = q.withColumn("q", F.col("n") * (F.col("n") + 2) * F.col("_q"))
    return q.select(*by, "n", "lags", "q", distributions.chi2_tail(F.col("q"), F.col("lags")).alias("p"))


def wmcr(paths: DataFrame, actual: DataFrame, bands: Sequence[tuple[float, float]] = BANDS) -> DataFrame:
    """Weighted multi-band capture rate: bands around the middle of the simulated range of each step."""
    mid = paths.groupBy("t").agg(((F.min("v") + F.max("v")) / 2).alias("mid")).join(actual, "t")
    share = lambda p: F.avg(F.col("a").between(F.col("mid") * (1 - p), F.col("mid") * (1 + p)).cast("double"))
    weight = sum(w for _, w in bands)
    return mid.agg((sum((w * share(p) for p, w in bands[1:]), bands[0][1] * share(bands[0][0])) / weight).alias("wmcr"))


def path_match(paths: DataFrame, actual: DataFrame) -> DataFrame:
    """Per path: half the sign agreement of changes, half their correlation (0 without one) moved to 0..1."""
    rows = paths.join(actual, "t")
    rows = rows.withColumns({"_dv": series.diff(F.col("v"), _path()), "_da": series.diff(F.col("a"), _path())})
    agree = F.avg(F.when(F.col("_dv").isNotNull() & F.col("_da").isNotNull(), (F.signum("_dv") == F.signum("_da")).cast("double")))
    return rows.groupBy("sim_id").agg((0.5 * agree + 0.5 * (F.coalesce(F.nanvl(F.corr("_dv", "_da"), F.lit(0.0)), F.lit(0.0)) + 1) / 2).alias("pmc"))


def volatility_of_changes(df: DataFrame, value: str, by: Sequence[str], order: str = "t") -> DataFrame:
    """Population deviation of absolute changes (vv), and the sum of products of neighbouring deviations over n - 1 (persistence)."""
    w = Window.partitionBy(*by).orderBy(order)
    rows = df.withColumns({"_d": F.abs(series.diff(F.col(value), w)), "_c": F.col(value) - F.avg(value).over(Window.partitionBy(*by))})
    rows = rows.withColumn("_p", F.col("_c") * F.lag("_c").over(w))
    return rows.groupBy(*by).agg(F.stddev_pop("_d").alias("vv"), (F.sum("_p") / F.nullif(F.count("*") - 1, F.lit(0))).alias("persistence"))


def jump_coincidence(paths: DataFrame, actual: DataFrame, level: float = 0.95) -> DataFrame:
    """Per path: the share of actual jumps (absolute changes above their quantile) at which the path jumps too."""
    a = actual.withColumn("_d", F.abs(series.diff(F.col("a"), Window.partitionBy(F.lit(0)).orderBy("t"))))  # one short series
    a = a.crossJoin(F.broadcast(a.agg(F.percentile("_d", level).alias("_q")))).filter("_d > _q").select("t")
    p = paths.withColumn("_d", F.abs(series.diff(F.col("v"), _path())))
    q = p.groupBy("sim_id").agg(F.percentile("_d", level).alias("_q"))
    return p.join(a, "t").join(q, "sim_id").groupBy("sim_id").agg(F.avg((F.coalesce(F.col("_d") > F.col("_q"), F.lit(False))).cast("double")).alias("vjc"))


def cumulative_shares(x: DataFrame, y: DataFrame) -> DataFrame:
    """v, f1, f2, i, n, same, n1, n2: both empirical distribution functions at every distinct value of the two samples (column v).

    i is the number of values up to v, `same` of those that equal it, n1 and n2 the sample sizes.

    Counts per distinct value are aggregated first; the running sums are then over distinct values.
    """
    rows = x.select("v", F.lit(1).alias("_x"), F.lit(0).alias("_y")).unionByName(y.select("v", F.lit(0).alias("_x"), F.lit(1).alias("_y")))
    counts = rows.groupBy("v").agg(F.sum("_x").alias("_x"), F.sum("_y").alias("_y"))
    total = counts.agg(F.sum("_x").alias("_nx"), F.sum("_y").alias("_ny"))
    run = stats.running_sums(counts, "v", ["_x", "_y"]).crossJoin(F.broadcast(total))  # one row
    i = F.col("run__x") + F.col("run__y")
    return run.select("v", (F.col("run__x") / F.col("_nx")).alias("f1"), (F.col("run__y") / F.col("_ny")).alias("f2"), i.alias("i"), (F.col("_nx") + F.col("_ny")).alias("n"), (F.col("_x") + F.col("_y")).alias("same"), F.col("_nx").alias("n1"), F.col("_ny").alias("n2"))


def ks_two_sample(x: DataFrame, y: DataFrame) -> DataFrame:
    """d, n1, n2 and p: the p-value is that of one sample of round(n1 n2 / (n1 + n2)) values."""
    one = cumulative_shares(x, y).agg(F.max(F.abs(F.col("f1") - F.col("f2"))).alias("d"), F.max("n1").alias("n1"), F.max("n2").alias("n2"))
    n = F.round(F.col("n1") * F.col("n2") / (F.col("n1") + F.col("n2"))).cast("int")
    return one.withColumn("p", distributions.ks_tail(F.col("d"), n))


def tail_weighted_distance(x: DataFrame, y: DataFrame, tail: float = 0.1) -> DataFrame:
    """How far the tails of y are from those of x (actual): values up to the `tail` quantile of x or from the opposite one on.

    The sum over all sorted tail values but the first and the last, with i from 0, of the squared
    distance of both distribution functions over i (n - i); infinite with fewer than 5 values of
    either. Equal values share their distance, and their weights are added up.
    """
    cut = F.broadcast(x.agg(F.percentile("v", F.array(F.lit(tail), F.lit(1 - tail))).alias("_q")))  # one row
    ends = lambda d: d.crossJoin(cut).filter((F.col("v") <= F.col("_q")[0]) | (F.col("v") >= F.col("_q")[1])).select("v")
    steps = cumulative_shares(ends(x), ends(y))
    last, n = F.col("i") - 1, F.col("n")
    lo, hi = F.greatest(F.lit(1), last - F.col("same") + 1), F.least(n - 2, last)
    weight = F.when(lo <= hi, F.aggregate(F.sequence(lo.cast("bigint"), hi.cast("bigint")), F.lit(0.0), lambda a, i: a + 1.0 / (i * (n - i)))).otherwise(0.0)
    few = F.least(F.max("n1"), F.max("n2")) < 5
    total = F.sum(F.pow(F.col("f1") - F.col("f2"), 2) * weight)
    return steps.agg(F.when(F.coalesce(few, F.lit(True)), float("inf")).otherwise(total).alias("twad"))


def proximity(a: Column, s: Column) -> Column:
    return 1 - F.abs(a - s) / (F.abs(a) + 1e-10)


def moments_proximity(x: DataFrame, y: DataFrame) -> DataFrame:
    """How near mean, median and population deviation of y are to those of x."""
    sums = lambda d, p: d.agg(F.avg("v").alias(f"{p}m"), F.median("v").alias(f"{p}d"), F.stddev_pop("v").alias(f"{p}s"))
    one = sums(x, "x").crossJoin(F.broadcast(sums(y, "y")))  # one row each
    return one.select(*(proximity(F.col(f"x{k}"), F.col(f"y{k}")).alias(n) for k, n in (("m", "mean"), ("d", "median"), ("s", "std"))))


def closest_path(paths: DataFrame, actual: DataFrame) -> DataFrame:
    """The path of the least root mean square error, the smallest sim_id of equals."""
    rmse = paths.join(actual, "t").groupBy("sim_id").agg(F.sqrt(F.avg(F.pow(F.col("v") - F.col("a"), 2))).alias("rmse"))
    return rmse.agg(F.min(F.struct("rmse", "sim_id")).alias("m")).select("m.sim_id", "m.rmse")


def tail_quantiles(df: DataFrame, value: str, levels: Sequence[float] = (0.95, 0.975, 0.99, 0.995), by: Sequence[str] = ()) -> DataFrame:
    out = df.groupBy(*by).agg(F.percentile(F.abs(value), F.array(*map(F.lit, levels))).alias("_q"))
    return out.select(*by, *(F.col("_q")[i].alias(f"q{str(p)[2:]}") for i, p in enumerate(levels)))


def anchored_product(nav: DataFrame, gap: DataFrame, premium: DataFrame, start: float = 10_000.0, by: Sequence[str] = ()) -> DataFrame:
    """nav * (1 + gap) * (1 + premium) of each path, scaled to `start` at its first step."""
    keys = [*by, "sim_id", "t"]
    j = nav.select(*keys, F.col("v").alias("_n")).join(gap.select(*keys, F.col("v").alias("_g")), keys).join(premium.select(*keys, F.col("v").alias("_p")), keys)
    level = F.col("_n") * (1 + F.col("_g")) * (1 + F.col("_p"))
    w = Window.partitionBy(*by, "sim_id").orderBy("t")
    first = F.first(level).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return j.select(*keys, (level * F.lit(start) / F.nullif(first, F.lit(0.0))).alias("v"))


def premium_product(gap: DataFrame, premium: DataFrame, starts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """s0 (1 + gap) (1 + premium) / ((1 + g0) (1 + k0)) of each path; `starts` holds s0, g0, k0 for each `by` (one row without keys). A divisor of 0 counts as 1."""
    keys = [*by, "sim_id", "t"]
    j = gap.select(*keys, F.col("v").alias("_g")).join(premium.select(*keys, F.col("v").alias("_p")), keys)
    j = j.join(starts.select(*by, "s0", "g0", "k0"), list(by)) if by else j.crossJoin(F.broadcast(starts.select("s0", "g0", "k0")))  # one row
    at_start = (1 + F.col("g0")) * (1 + F.col("k0"))
    level = F.col("s0") * (1 + F.col("_g")) * (1 + F.col("_p")) / F.when(at_start == 0, 1.0).otherwise(at_start)
    return j.select(*keys, level.alias("v"))


def realised_volatility(df: DataFrame, value: str, by: Sequence[str], order: str = "t", n: int = 20, scale: float = 252**0.5) -> DataFrame:
    """Adds rv: the rolling deviation of `value`, its first gap filled backward, zero if there is none."""
    w = Window.partitionBy(*by).orderBy(order)
    df = df.withColumn("_rv", series.rolling_std(F.col(value), w, n, scale))
    return df.withColumn("rv", F.coalesce(series.bfill(F.col("_rv"), w), series.ffill(F.col("_rv"), w), F.lit(0.0))).drop("_rv")


def volatility_regression(paths: DataFrame, actual: DataFrame, n: int = 20, least: int = 10) -> DataFrame:
    """Per path r2, beta and |beta - 1| of the regression of actual on simulated volatility; too few steps give 0, 0, 1."""
    a = realised_volatility(actual.withColumn("_one", F.lit(1)), "a", ["_one"], n=n).select("t", F.col("rv").alias("ra"))  # one series
    p = realised_volatility(paths, "v", ["sim_id"], n=n).join(a, "t")
    fit = p.groupBy("sim_id").agg(F.count("*").alias("_n"), F.regr_r2("ra", "rv").alias("r2"), F.regr_slope("ra", "rv").alias("beta"))
    short = (F.col("_n") < least) | F.col("beta").isNull()
    beta = F.when(short, 0.0).otherwise(F.col("beta"))
    return fit.select("sim_id", F.when(short, 0.0).otherwise(F.coalesce("r2", F.lit(0.0))).alias("r2"), beta.alias("beta"), F.abs(beta - 1).alias("beta_gap"))


def ljung_box(df: DataFrame, value: str, lags: int, by: Sequence[str], order: Sequence[str] = ("t",)) -> DataFrame:
    """n and the portmanteau statistic over `lags` autocorrelations."""
    acf = stats.autocorrelation(df, value, lags, by, order).filter("lag > 0")
    n = df.groupBy(*by).agg(F.count(value).alias("n"))
    return acf.join(n, list(by)).groupBy(*by).agg(F.max("n").alias("n"), F.sum(F.col("acf") * F.col("acf") / (F.col("n") - F.col("lag"))).alias("_q")).select(*by, "n", (F.col("n") * (F.col("n") + 2) * F.col("_q")).alias("q"))


def scenario_risk(paths: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Of each scenario: terminal VaR and CVaR at 95 and 99 %, mean drawdown, mean deviation of changes, skewness, kurtosis, quantiles."""
    w = Window.partitionBy(*by, "sim_id").orderBy("t")
    rows = paths.withColumns({"_d": series.diff(F.col("v"), w), "_dd": (F.col("v") - (top := F.max("v").over(w.rowsBetween(Window.unboundedPreceding, 0)))) / (F.abs(top) + 1e-12)})
    one = rows.groupBy(*by, "sim_id").agg(F.max_by("v", "t").alias("v"), F.min("_dd").alias("_mdd"), F.stddev_pop("_d").alias("_sd"))
    cut = one.groupBy(*by).agg(F.percentile("v", F.array(*map(F.lit, (0.01, 0.05, 0.25, 0.5, 0.75, 0.95)))).alias("_q"))
    j = one.join(cut, list(by)) if by else one.crossJoin(F.broadcast(cut))  # one row
    q = F.first("_q")
    tail = lambda i: F.avg(F.when(F.col("v") <= F.col("_q")[i], F.col("v")))
    return j.groupBy(*by).agg(
        F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"), q[1].alias("var95"), tail(1).alias("cvar95"), q[0].alias("var99"), tail(0).alias("cvar99"), F.avg("_mdd").alias("mdd"), F.avg("_sd").alias("vol"),
        F.skewness("v").alias("skew"), F.kurtosis("v").alias("kurt"), q[2].alias("p25"), q[3].alias("p50"), q[4].alias("p75"), q[5].alias("p95"),
    )


def loss_probability(paths: DataFrame, share: float = 0.2) -> DataFrame:
    """The share of paths that end more than `share` below their first value."""
    ends = paths.groupBy("sim_id").agg(F.min_by("v", "t").alias("_a"), F.max_by("v", "t").alias("_z"))
    return ends.agg(F.avg((F.col("_z") < F.col("_a") * (1 - share)).cast("double")).alias("p_loss"))


def scaled_product(nav: DataFrame, gap: DataFrame, first_true: float) -> DataFrame:
    """nav scaled to start at `first_true`, times (1 + gap); and its distance from the scaled nav."""
    j = nav.select("sim_id", "t", F.col("v").alias("_n")).join(gap.select("sim_id", "t", F.col("v").alias("_g")), ["sim_id", "t"])
    first = F.first("_n").over(_path().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    scaled = F.col("_n") * F.lit(first_true) / F.nullif(first, F.lit(0.0))
    level = scaled * (1 + F.col("_g"))
    return j.select("sim_id", "t", level.alias("v"), (level / F.nullif(scaled, F.lit(0.0)) - 1).alias("relative"))


def delayed_product(nav: DataFrame, gap: DataFrame, start: float, gap0: float) -> DataFrame:
    """Log changes of start (1 + gap0), nav_0 (1 + gap_0), nav_1 (1 + gap_1), ...: the level follows the simulation by one step."""
    j = nav.select("sim_id", "t", F.col("v").alias("_n")).join(gap.select("sim_id", "t", F.col("v").alias("_g")), ["sim_id", "t"])
    level = j.select("sim_id", (F.col("t") + 1).alias("t"), (F.col("_n") * (1 + F.col("_g"))).alias("v"))
    level = level.unionByName(j.select("sim_id").distinct().select("sim_id", F.lit(0).alias("t"), F.lit(start * (1 + gap0)).alias("v")))
    return level.withColumn("r", series.log_return(F.col("v"), _path()))


def normal_quantile_points(df: DataFrame, value: str, points: int = 99) -> DataFrame:
    """(p, theoretical, sample): normal quantiles against exact percentiles at equally spaced probabilities."""
    from statistics import NormalDist

    levels = [(i + 1) / (points + 1) for i in range(points)]
    one = df.agg(F.percentile(value, F.array(*map(F.lit, levels))).alias("_q"))
    cells = F.array(*(F.struct(F.lit(p).alias("p"), F.lit(NormalDist().inv_cdf(p)).alias("theoretical"), F.col("_q")[i].alias("sample")) for i, p in enumerate(levels)))
    return one.select(F.explode(cells).alias("c")).select("c.*")


def order_statistics(df: DataFrame, value: str) -> DataFrame:
    """(i, n, p, sample) of each distinct value: its last rank i, and the median of the order statistic of that rank (Filliben, 1975).

    Ranks are running counts over distinct values, in buckets.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(F.col(value).alias("sample")).agg(F.count("*").alias("m"))
    total = counts.agg(F.sum("m").alias("n"))
    rows = stats.running_sums(counts, "sample", ["m"]).crossJoin(F.broadcast(total))  # one row
    i, n = F.col("run_m"), F.col("n")
    end = F.pow(F.lit(0.5), 1.0 / n)
    p = F.when(i == n, end).when(i == 1, 1 - end).otherwise((i - 0.3175) / (n + 0.365))
    return rows.select(i.alias("i"), "n", p.alias("p"), "sample")


def change_bands(paths: DataFrame, actual: DataFrame, levels: Sequence[float] = (0.05, 0.95)) -> DataFrame:
    """(t, da, lo, hi, inside): the change of the actual series and the band of the changes of the paths."""
    d = paths.withColumn("_d", series.diff(F.col("v"), _path())).filter("_d is not null").groupBy("t").agg(F.percentile("_d", F.array(*map(F.lit, levels))).alias("_q"))
    a = actual.withColumn("da", series.diff(F.col("a"), Window.partitionBy(F.lit(0)).orderBy("t"))).filter("da is not null")  # one short series
    return a.join(d, "t").select("t", "da", F.col("_q")[0].alias("lo"), F.col("_q")[1].alias("hi"), F.col("da").between(F.col("_q")[0], F.col("_q")[1]).alias("inside"))
