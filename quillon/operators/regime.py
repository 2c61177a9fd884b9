"""Regimes: heterogeneous autoregression, unit-root test, Gaussian hidden Markov models and their selection.

Every fit is one numpy group of one series; many series, state counts, starts and bootstrap
replicates run as tasks side by side.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions import lineage, scalar, series
from quillon.operators import estimators

# MacKinnon (2010) response surfaces of the Dickey-Fuller test with a constant, at 1, 5 and 10 %.
_ADF_CRITICAL = {"1%": (-3.43035, -6.5393, -16.786), "5%": (-2.86154, -2.8903, -4.234), "10%": (-2.56677, -1.5384, -2.809)}
# MacKinnon (1994) p-value polynomials, below and above the threshold.
_ADF_SPLIT, _ADF_LOW, _ADF_HIGH = -1.61, (2.1659, 1.4412, 0.038269), (1.7339, 0.93202, -0.12745, -0.010368)


def har(df: DataFrame, value: str, by: Sequence[str] = ("s",), order: str = "d", standardise: bool = True) -> DataFrame:
    """Adds day, week, month lags, and residual and z of the regression on them; rows before the first full month go.

    z is the plain residual without `standardise`.

    The normal equations are one aggregation per series; the few coefficients come from a 4 x 4 solve per group.
    """
    w = Window.partitionBy(*by).orderBy(order)
    x = F.col(value)
    rows = df.withColumns({"day": F.lag(x).over(w), "week": series.rolling_mean(x, w, 5, 1), "month": series.rolling_mean(x, w, 22, 1)}).dropna(subset=[value, "day", "week", "month"])
    coef = har_coefficients(rows, value, by)
    fitted = F.col("c0") + F.col("c1") * F.col("day") + F.col("c2") * F.col("week") + F.col("c3") * F.col("month")
    rows = rows.join(coef, list(by)).withColumn("residual", x - fitted)
    every = Window.partitionBy(*by)
    z = (F.col("residual") - F.avg("residual").over(every)) / F.nullif(F.stddev_samp("residual").over(every), F.lit(0.0))
    return rows.withColumn("z", z if standardise else F.col("residual")).drop("c0", "c1", "c2", "c3", "r2", "adj_r2", "n")


def har_coefficients(rows: DataFrame, value: str, by: Sequence[str] = ("s",)) -> DataFrame:
    """c0..c3, r2, adj_r2 and n per series, of rows that hold day, week and month."""
    return estimators.least_squares(rows, value, ["day", "week", "month"], by)


def adf_series(x: np.ndarray) -> dict[str, float]:
    """Augmented Dickey-Fuller test with a constant; the lag is the one of the least AIC on a common sample."""
    n = len(x)
    most = min(int(math.ceil(12 * (n / 100) ** 0.25)), n // 2 - 2)
    d = np.diff(x)

    def regression(lags: int, skip: int) -> tuple[float, float]:
        y = d[skip:]
        cols = [x[skip:-1], np.ones(len(y)), *(d[skip - k : len(d) - k] for k in range(1, lags + 1))]
        a = np.column_stack(cols)
        c, *_ = np.linalg.lstsq(a, y, rcond=None)
        ssr = float(((y - a @ c) ** 2).sum())
        error = math.sqrt(ssr / (len(y) - a.shape[1]) * np.linalg.pinv(a.T @ a)[0, 0])
        return c[0] / error, len(y) * math.log(ssr / len(y)) + 2 * a.shape[1]

    best = min(range(most + 1), key=lambda k: regression(k, most)[1])
    stat, _ = regression(best, best)
    poly = _ADF_LOW if stat <= _ADF_SPLIT else _ADF_HIGH
    p = 0.5 * math.erfc(-sum(b * stat**i for i, b in enumerate(poly)) / math.sqrt(2))
    m = n - 1 - best
    return {"stat": stat, "p": min(1.0, max(0.0, p)), "lags": best} | {f"crit_{k[:-1]}": a + b / m + c / m**2 for k, (a, b, c) in _ADF_CRITICAL.items()}


def adf(df: DataFrame, value: str, by: Sequence[str] = ("s",), order: str = "d") -> DataFrame:
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.sort_values(order)[value].to_numpy(float)
        return pd.DataFrame([{k: pdf[k].iloc[0] for k in by} | adf_series(x)]) if len(x) >= 20 else pd.DataFrame(columns=[*by, *names])

    names = ["stat", "p", "lags", "crit_1", "crit_5", "crit_10"]
    keys = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in by)
    return df.select(*by, order, value).dropna().groupBy(*by).applyInPandas(run, f"{keys}, stat double, p double, lags int, crit_1 double, crit_5 double, crit_10 double")


# ---- Gaussian hidden Markov models ---------------------------------------------------------------


def _log_density(y: np.ndarray, mu: np.ndarray, var: np.ndarray) -> np.ndarray:
    return -0.5 * (np.log(2 * np.pi * var) + (y[:, None] - mu) ** 2 / var)


def _expected(y: np.ndarray, mu: np.ndarray, var: np.ndarray, start: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For a batch of series (batch, time) and models: log likelihoods, state weights (time, batch, k) and transition counts.

    One loop over time does for the whole batch.
    """
    density = -0.5 * (np.log(2 * np.pi * var)[:, None] + (y[:, :, None] - mu[:, None]) ** 2 / var[:, None])
    top = density.max(2)
    b = np.ascontiguousarray(np.exp(density - top[:, :, None]).transpose(1, 0, 2))
    alpha, scale = np.empty_like(b), np.empty(b.shape[:2])
    row = start * b[0]
    for t in range(len(b)):
        if t:
            row = np.matmul(row[:, None], move)[:, 0] * b[t]
        scale[t] = np.maximum(row.sum(1), 1e-300)
        alpha[t] = row = row / scale[t][:, None]
    beta = np.ones_like(b)
    for t in range(len(b) - 2, -1, -1):
        beta[t] = np.matmul(move, (b[t + 1] * beta[t + 1] / scale[t + 1][:, None])[:, :, None])[:, :, 0]
    gamma = alpha * beta
    gamma /= gamma.sum(2, keepdims=True)
    pair = np.einsum("tbi,tbj->bij", alpha[:-1], b[1:] * beta[1:] / scale[1:, :, None]) * move
    return np.log(scale).sum(0) + top.sum(1), gamma, pair


def hmm_fits(y: np.ndarray, k: int, seeds: Sequence[int], rounds: int = 300, tol: float = 1e-4, begin: dict[str, np.ndarray] | None = None) -> dict[str, np.ndarray]:
    """Baum-Welch on every row of `y` (batch, time) from the start of its seed, or from the fits `begin`; states in the order of their means."""
    n, spread = len(y), y.var(1)
    floor = np.maximum(1e-8, 1e-3 * spread)[:, None]
    levels = np.stack([(np.arange(k) + np.random.default_rng(seed).uniform(0.25, 0.75, k)) / k for seed in seeds])
    mu = np.sort(np.stack([np.quantile(row, q) for row, q in zip(y, levels, strict=True)]), 1)
    var, start = np.maximum(np.repeat(spread[:, None], k, 1), floor), np.full((n, k), 1 / k)
    move = np.full((n, k, k), 0.1 / max(1, k - 1))
    move[:, np.arange(k), np.arange(k)] = 0.9 if k > 1 else 1.0
    if begin is not None:
        mu, var, start, move = (begin[c].copy() for c in ("mu", "var", "start", "move"))
    ll, open_ = np.full(n, -np.inf), np.arange(n)
    for _ in range(rounds):
        now, gamma, pair = _expected(y[open_], mu[open_], var[open_], start[open_], move[open_])
        more = now - ll[open_] >= tol
        ll[open_] = now
        open_, gamma, pair = open_[more], gamma[:, more], pair[more]
        if not len(open_):
            break
        first, pair = gamma[0] + 1e-12, pair + 1e-12
        start[open_], move[open_] = first / first.sum(1, keepdims=True), pair / pair.sum(2, keepdims=True)
        weight = gamma.sum(0) + 1e-12
        mean = np.einsum("tbk,bt->bk", gamma, y[open_]) / weight
        mu[open_] = mean
        var[open_] = np.maximum(np.einsum("tbk,tbk->bk", gamma, (y[open_].T[:, :, None] - mean) ** 2) / weight, floor[open_])
    order = np.argsort(mu, axis=1, kind="stable")
    across = lambda x: np.take_along_axis(x, order, 1)
    moved = np.take_along_axis(np.take_along_axis(move, order[:, :, None], 1), order[:, None], 2)
    return {"mu": across(mu), "var": across(var), "start": across(start), "move": moved, "ll": ll}


def viterbi(y: np.ndarray, fit: dict) -> np.ndarray:
    density, move = _log_density(y, fit["mu"], fit["var"]), np.log(fit["move"] + 1e-300)
    score, back = np.log(fit["start"] + 1e-300) + density[0], np.zeros(density.shape, int)
    for t in range(1, len(y)):
        step = score[:, None] + move
        back[t] = step.argmax(0)
        score = step.max(0) + density[t]
    path = np.zeros(len(y), int)
    path[-1] = score.argmax()
    for t in range(len(y) - 1, 0, -1):
        path[t - 1] = back[t, path[t]]
    return path


def hmm_fit(y: np.ndarray, k: int, seed: int, rounds: int = 300, tol: float = 1e-4) -> dict[str, np.ndarray]:
    """The fit of one series from one start."""
    return {name: x[0] for name, x in hmm_fits(y[None], k, [seed], rounds, tol).items()}


def hmm_best(y: np.ndarray, k: int, starts: int, seed: int) -> dict:
    """The likeliest of the fits from `starts` starts, with the weights of its states."""
    fits = hmm_fits(np.repeat(y[None], starts, 0), k, range(seed, seed + starts))
    one = {name: x[[int(fits["ll"].argmax())]] for name, x in fits.items()}
    gamma = _expected(y[None], one["mu"], one["var"], one["start"], one["move"])[1]
    return {name: x[0] for name, x in one.items()} | {"gamma": gamma[:, 0]}


#: Rounds after which only the likeliest start of a simulated series goes on.
SHORT = 30


def _likelihoods(y: np.ndarray, k: int, starts: int, seed: int) -> np.ndarray:
    """The log likelihood of the fit of every row of `y`: that of its starts which is likeliest after SHORT rounds, to its end."""
    fits = hmm_fits(np.repeat(y, starts, 0), k, list(range(seed, seed + starts)) * len(y), SHORT)
    best = np.arange(len(y)) * starts + fits["ll"].reshape(len(y), starts).argmax(1)
    return hmm_fits(y, k, [seed] * len(y), begin={c: fits[c][best] for c in ("mu", "var", "start", "move")})["ll"]


def _spread(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows dealt by their keys into a fixed number of partitions: groups that are small but slow to fit are not put together again."""
    spark = rows.sparkSession
    return rows.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism), *keys)


def n_parameters(k: int) -> int:
    return k + k + k * (k - 1) + (k - 1)


def hmm_regimes(df: DataFrame, value: str, states: Sequence[int] | DataFrame = (1, 2, 3), starts: int = 5, seed: int = 42, by: Sequence[str] = ("s",), order: str = "d") -> DataFrame:
    """Per series and state count k: log likelihood, aic, bic, least occupancy, means, deviations, the Viterbi states and the posteriors (k a step).

    Each (series, k) is its own group, so that they run as separate tasks. `states` may be a small
    table (by, k) of the counts to fit for each series, as of `counted_states`.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        y, k = pdf[value].to_numpy(float), int(pdf["k"].iloc[0])
        if len(y) < 10 * k:
            return pd.DataFrame(columns=[*by, *names])
        fit = hmm_best(y, k, starts, seed)
        path, p = viterbi(y, fit), n_parameters(k)
        occupancy = np.bincount(path, minlength=k).min() / len(y)
        row = {"k": k, "n": len(y), "loglik": fit["ll"], "aic": 2 * p - 2 * fit["ll"], "bic": p * math.log(len(y)) - 2 * fit["ll"], "occupancy": occupancy}
        return pd.DataFrame([{c: pdf[c].iloc[0] for c in by} | row | {"mu": fit["mu"].tolist(), "sigma": np.sqrt(fit["var"]).tolist(), "move": fit["move"].ravel().tolist(), "states": path.tolist(), "posterior": fit["gamma"].ravel().tolist()}])[[*by, *names]]

    names = ["k", "n", "loglik", "aic", "bic", "occupancy", "mu", "sigma", "move", "states", "posterior"]
    keys = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in by)
    schema = f"{keys}, k int, n bigint, loglik double, aic double, bic double, occupancy double, mu array<double>, sigma array<double>, move array<double>, states array<int>, posterior array<double>"
    rows = df.select(*by, order, value).dropna()
    if isinstance(states, DataFrame):
        rows = rows.join(states.select(*by, F.col("k").cast("int").alias("k")), list(by))
    else:
        rows = rows.withColumn("k", F.explode(F.array(*map(F.lit, states))))
    return _spread(rows, [*by, "k"]).groupBy(*by, "k").applyInPandas(run, schema)


def comparison_table(fits: DataFrame, by: Sequence[str] = ("s",)) -> DataFrame:
    """(metric, k1, k2, k3) of each series: log likelihood, criteria and number of parameters side by side."""
    cells = F.array(*(F.struct(F.lit(m).alias("metric"), x.cast("double").alias("v")) for m, x in {"loglik": F.col("loglik"), "aic": F.col("aic"), "bic": F.col("bic"), "n_params": F.col("k") * (F.col("k") + 2) - 1}.items()))
    rows = fits.select(*by, "k", F.explode(cells).alias("c")).select(*by, "k", "c.*")
    out = rows.groupBy(*by, "metric").pivot("k", [1, 2, 3]).agg(F.max("v"))
    return out.select(*by, "metric", *(F.col(str(k)).alias(f"k{k}") for k in (1, 2, 3)))


def transformed(value: Column, kind: str = "none") -> Column:
    """The value, its log or its log1p; a value outside the domain is an error."""
    return value if kind == "none" else scalar.checked_log(value, kind)


def back_transformed(value: Column, kind: Column) -> Column:
    """The inverse of `transformed` for a column that names the transformation."""
    return F.when(kind == "log", F.exp(value)).when(kind == "log1p", F.expm1(value)).otherwise(value)


def state_series(df: DataFrame, fits: DataFrame, value: str, by: Sequence[str] = ("s",), order: str = "d") -> DataFrame:
    """(by, order, state) of one fit a series: its n-th state belongs to the n-th row with a value."""
    rows = df.select(*by, order, value).dropna().withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(order)))
    states = fits.select(*by, F.posexplode("states").alias("_p", "state")).withColumn("_n", F.col("_p") + 1).drop("_p")
    return rows.join(states, [*by, "_n"]).select(*by, order, "state")


def counted_states(states: DataFrame, by: Sequence[str] = ("s",)) -> DataFrame:
    """(by, k): the number of distinct states of stored regimes, to fit that many again without a test."""
    return states.filter("state is not null").groupBy(*by).agg(F.count_distinct("state").cast("int").alias("k"))


#: Replicates that one task generates and fits together.
REPLICATES = 100
#: A sequential test looks whether it is decided after so many replicates at first, and then after twice as many each time.
FIRST_LOOK = 100


def _smaller_models(df: DataFrame, value: str, k0: int, starts: int, seed: int, by: Sequence[str], order: str) -> DataFrame:
    """(by, n, observed, mu, var, start, move): the statistic of each series and its model of k0 states."""

    def observe(pdf: pd.DataFrame) -> pd.DataFrame:
        y = pdf.sort_values(order)[value].to_numpy(float)
        fit = hmm_best(y, k0, starts, seed)
        row = {"n": len(y), "observed": _statistic(y[None], k0, starts, seed)[0]} | {c: fit[c].ravel().tolist() for c in ("mu", "var", "start", "move")}
        return pd.DataFrame([{c: pdf[c].iloc[0] for c in by} | row])

    keys = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in by)
    return _spread(df.select(*by, order, value).dropna(), by).groupBy(*by).applyInPandas(observe, f"{keys}, n bigint, observed double, mu array<double>, var array<double>, start array<double>, move array<double>")


def _statistic(y: np.ndarray, k0: int, starts: int, seed: int) -> np.ndarray:
    return 2 * (_likelihoods(y, k0 + 1, starts, seed) - _likelihoods(y, k0, starts, seed))


def _replicates(models: DataFrame, k0: int, first: int, last: int, starts: int, seed: int, by: Sequence[str]) -> DataFrame:
    """(by, m, x): the replicates first .. last - 1 of each model, and how many reach its observed statistic. Every replicate has a stream of its own."""

    def replicate(pdf: pd.DataFrame) -> pd.DataFrame:
        one = pdf.iloc[0]
        mu, sd, n = np.array(one["mu"]), np.sqrt(one["var"]), int(one["n"])
        start, move = np.cumsum(one["start"]), np.cumsum(np.array(one["move"]).reshape(k0, k0), 1)
        streams = [np.random.default_rng([seed, b]) for b in range(int(one["chunk"]), min(last, int(one["chunk"]) + REPLICATES))]
        u, z = np.stack([r.random(n) for r in streams]), np.stack([r.standard_normal(n) for r in streams])
        state = np.minimum((start < u[:, :1]).sum(1), k0 - 1)
        y = np.empty_like(z)
        for t in range(n):
            if t:
                state = np.minimum((move[state] < u[:, t, None]).sum(1), k0 - 1)
            y[:, t] = mu[state] + sd[state] * z[:, t]
        reached = int((_statistic(y, k0, starts, seed) >= one["observed"]).sum())
        return pd.DataFrame([{c: one[c] for c in by} | {"m": len(streams), "x": reached}])

    keys = ", ".join(f"{k} {models.schema[k].dataType.simpleString()}" for k in by)
    parts = models.withColumn("chunk", F.explode(F.sequence(F.lit(first), F.lit(last - 1), F.lit(REPLICATES))))
    found = _spread(parts, [*by, "chunk"]).groupBy(*by, "chunk").applyInPandas(replicate, f"{keys}, m bigint, x bigint")
    return found.groupBy(*by).agg(F.sum("m").alias("m"), F.sum("x").alias("x"))


def bootstrap_lrt(df: DataFrame, value: str, k0: int = 1, replicates: int = 100, starts: int = 3, seed: int = 42, by: Sequence[str] = ("s",), order: str = "d") -> DataFrame:
    """observed statistic and p: k0 states against k0 + 1, by simulating from the smaller model and refitting both.

    The series is fitted once; its parameters go to the tasks, each of which generates and fits
    REPLICATES replicates.
    """
    models = _smaller_models(df, value, k0, starts, seed, by, order)
    counts = _replicates(models, k0, 0, replicates, starts, seed, by)
    return models.select(*by, "observed").join(counts, list(by)).select(*by, "observed", (F.col("x") / F.col("m")).alias("p"))


def sequential_lrt(df: DataFrame, value: str, k0: int = 1, replicates: int = 1_000, starts: int = 3, alpha: float = 0.05, seed: int = 42, by: Sequence[str] = ("s",), order: str = "d") -> DataFrame:
    """(by, observed, m, p, rejects): the bootstrap test that ends for a series once all `replicates` could not change its outcome.

    rejects says whether fewer than alpha times `replicates` of them reach the observed statistic.
    It is decided when so many do already, or when the rest are too few to get there; series that
    are decided leave the later rounds. p is the share among the m replicates that were made.
    """
    models = lineage.cut(_smaller_models(df, value, k0, starts, seed, by, order))
    bound, done, first, left = alpha * replicates, None, 0, models
    while first < replicates:
        last = min(replicates, max(FIRST_LOOK, 2 * first))
        more = _replicates(left, k0, first, last, starts, seed, by)
        if done is not None:
            more = more.unionByName(done.join(left.select(*by), list(by), "left_semi")).groupBy(*by).agg(F.sum("m").alias("m"), F.sum("x").alias("x"))
            more = more.unionByName(done.join(left.select(*by), list(by), "left_anti"))
        done = lineage.cut(more)
        decided = (F.col("x") >= bound) | (F.col("x") + replicates - F.col("m") < bound)
        left = left.join(done.filter(decided), list(by), "left_anti")
        first = last
        if left.isEmpty():
            break
    return models.select(*by, "observed").join(done, list(by)).select(*by, "observed", "m", (F.col("x") / F.col("m")).alias("p"), (F.col("x") < bound).alias("rejects"))


def choose_states(df: DataFrame, value: str, starts: int = 10, replicates: int = 1_000, least: float = 0.1, alpha: float = 0.05, test_starts: int = 3, seed: int = 42, by: Sequence[str] = ("s",), order: str = "d") -> tuple[DataFrame, DataFrame]:
    """The fits of 1 to 3 states, and (by, bic1 .. bic3, occ2, occ3, p12, m12, p23, m23, best_k, reason).

    Two states are chosen over one, and three over two, if each is occupied enough, has the smaller
    BIC, and a sequential bootstrap rejects the smaller model. The second test is made only where two
    states are chosen over one. The fits are kept.
    """
    fits = lineage.cut(hmm_regimes(df, value, (1, 2, 3), starts, seed, by, order))
    wide = fits.groupBy(*by).pivot("k", [1, 2, 3]).agg(F.max("bic").alias("bic"), F.max("occupancy").alias("occ"))
    wide = wide.select(*by, *(F.col(f"{k}_bic").alias(f"bic{k}") for k in (1, 2, 3)), F.col("2_occ").alias("occ2"), F.col("3_occ").alias("occ3"))
    rows = df.select(*by, order, value).dropna().join(wide.select(*by), list(by), "left_semi")
    one = sequential_lrt(rows, value, 1, replicates, test_starts, alpha, seed + 3, by, order).select(*by, F.col("p").alias("p12"), F.col("m").alias("m12"), F.col("rejects").alias("_r12"))
    table = lineage.cut(wide.join(one, list(by)).withColumn("_two", (F.col("occ2") >= least) & (F.col("bic2") < F.col("bic1")) & F.col("_r12")))
    two = sequential_lrt(rows.join(table.filter("_two").select(*by), list(by), "left_semi"), value, 2, replicates, test_starts, alpha, seed + 4, by, order)
    two = two.select(*by, F.col("p").alias("p23"), F.col("m").alias("m23"), F.col("rejects").alias("_r23"))
    fewer, enough = F.col("bic3") < F.col("bic2"), F.col("occ3") >= least
    reason = (
        F.when(F.col("occ2") < least, "one state: a state of two is occupied too little")
        .when(~(F.col("bic2") < F.col("bic1")), "one state: its BIC is not above that of two")
        .when(~F.col("_r12"), "one state: the test does not reject it")
        .when(~enough, "two states: a state of three is occupied too little")
        .when(fewer & F.col("_r23"), "three states: smaller BIC and the test rejects two")
        .when(fewer, "two states: the test does not reject them")
        .when(F.col("_r23"), "two states: their BIC is smaller although the test rejects them")
        .otherwise("two states: smaller BIC and the test does not reject them")
    )
    best = F.when(~F.col("_two"), 1).when(enough & fewer & F.col("_r23"), 3).otherwise(2)
    names = ["bic1", "bic2", "bic3", "occ2", "occ3", "p12", "m12", "p23", "m23"]
    return fits, table.join(two, list(by), "left").select(*by, *names, best.alias("best_k"), reason.alias("reason"))


def select_states(fits: DataFrame, p12: DataFrame, p23: DataFrame, least: float = 0.1, alpha: float = 0.05, by: Sequence[str] = ("s",)) -> DataFrame:
    """best_k: 2 over 1, then 3 over 2, each if occupied enough, of smaller BIC and significant."""
    wide = fits.groupBy(*by).pivot("k", [1, 2, 3]).agg(F.max("bic").alias("bic"), F.max("occupancy").alias("occ"))
    t = wide.join(p12.select(*by, F.col("p").alias("p12")), list(by)).join(p23.select(*by, F.col("p").alias("p23")), list(by))
    two = (F.col("2_occ") >= least) & (F.col("2_bic") < F.col("1_bic")) & (F.col("p12") < alpha)
    three = (F.col("3_occ") >= least) & (F.col("3_bic") < F.col("2_bic")) & (F.col("p23") < alpha)
    return t.select(*by, F.when(~two, 1).when(three, 3).otherwise(2).alias("best_k"))


def jarque_bera(df: DataFrame, value: str, by: Sequence[str] = ("s",)) -> DataFrame:
    jb = F.count(value) / 6 * (F.pow(F.skewness(value), 2) + F.pow(F.kurtosis(value), 2) / 4)
    return df.groupBy(*by).agg(jb.alias("jb")).withColumn("p", F.exp(-F.col("jb") / 2))
