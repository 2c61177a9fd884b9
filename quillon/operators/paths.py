"""Monte-Carlo path generators: spark.range of simulations, vectorised over the simulations of a batch.

Each simulation draws from its own stream, seeded by (seed, sim_id), so paths do not depend on how
they are partitioned or recomputed. Output is long: (sim_id, t, v), t from 0.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from types import SimpleNamespace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Simulations that a task works on at once, and how many make a task worth its start.
BATCH, SHARE = 256, 32


def _generate(spark: SparkSession, n: int, steps: int, make: Callable[[list[np.random.Generator], int], np.ndarray], seed: int) -> DataFrame:
    def run(batches):
        for pdf in batches:
            ids = pdf["id"].to_numpy()
            for at in range(0, len(ids), BATCH):
                part = ids[at : at + BATCH]
                v = make([np.random.default_rng([seed, int(i)]) for i in part], steps)
                yield pd.DataFrame({"sim_id": np.repeat(part, v.shape[1]), "t": np.tile(np.arange(v.shape[1], dtype=np.int32), len(part)), "v": v.ravel()})

    parts = max(1, min(-(-n // SHARE), 4 * spark.sparkContext.defaultParallelism))
    return spark.range(0, n, 1, parts).mapInPandas(run, "sim_id bigint, t int, v double")


def _generate_rows(params: DataFrame, keys: Sequence[str], n: int, make: Callable[[object, list[np.random.Generator]], dict[str, np.ndarray]], columns: Sequence[str], seed: int) -> DataFrame:
    """(keys, sim_id, t, columns): n simulations of every row of a small table of parameters, all in one job.

    A task works on batches of simulations of a row. Streams are named by seed, key and simulation.
    """
    spark = params.sparkSession
    rows = params.withColumns({"_stream": F.pmod(F.xxhash64(*keys), F.lit(2**31)), "_from": F.explode(F.sequence(F.lit(0), F.lit(n - 1), F.lit(SHARE)))})
    kinds = {k: params.schema[k].dataType.simpleString() for k in keys}

    def run(batches):
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                ids = np.arange(row[-1], min(n, row[-1] + SHARE))
                found = make(row, [np.random.default_rng([seed, int(row[-2]), int(i)]) for i in ids])
                steps = found[columns[0]].shape[1]
                out = {k: [getattr(row, k)] * (len(ids) * steps) for k in keys}
                yield pd.DataFrame(out | {"sim_id": np.repeat(ids, steps), "t": np.tile(np.arange(steps, dtype=np.int32), len(ids))} | {c: found[c].ravel() for c in columns})

    parts = 4 * spark.sparkContext.defaultParallelism
    schema = "".join(f"{k} {kind}, " for k, kind in kinds.items()) + "sim_id bigint, t int" + "".join(f", {c} double" for c in columns)
    return rows.repartition(parts, *keys, "_from").mapInPandas(run, schema)


def ou_rows(params: DataFrame, keys: Sequence[str], n: int, steps: int, seed: int = 42) -> DataFrame:
    """(keys, sim_id, t, v): mean reversion for every row of (keys, x0, kappa, mu, sigma)."""

    def make(row, streams):
        z = _normals(streams, steps)
        v = np.empty_like(z)
        v[:, 0] = row.x0
        for t in range(1, steps):
            v[:, t] = v[:, t - 1] + row.kappa * (row.mu - v[:, t - 1]) + row.sigma * z[:, t]
        return {"v": v}

    return _generate_rows(params.select(*keys, "x0", "kappa", "mu", "sigma"), keys, n, make, ["v"], seed)


def emission_rows(params: DataFrame, keys: Sequence[str], n: int, steps: int, seed: int = 42) -> DataFrame:
    """(keys, sim_id, t, z): independent normal draws for every row of (keys, mu, sigma)."""
    draw = lambda row, streams: {"z": row.mu + row.sigma * _normals(streams, steps)}
    return _generate_rows(params.select(*keys, "mu", "sigma"), keys, n, draw, ["z"], seed)


def driven_rows(params: DataFrame, keys: Sequence[str], n: int, steps: int, dt: float = 1 / 252, seed: int = 42) -> DataFrame:
    """(keys, sim_id, t, v, x1, x2): a level whose volatility follows two simulated drivers, for every row of parameters.

    The drivers revert to m1, m2 from there at th1, th2 with deviations s1, s2 and shocks of
    correlation rho; the level reverts from x0 to mu at kappa, with the deviation sigma0
    exp(delta1 x1 + delta2 x2). t counts the steps after the start.
    """

    def make(row, streams):
        z = _normals(streams, 3 * steps).reshape(len(streams), 3, steps)
        rho, root = max(-0.9999, min(0.9999, row.rho)), np.sqrt(dt)
        shocks = (z[:, 0], rho * z[:, 0] + np.sqrt(1 - rho**2) * z[:, 1])
        x, v, level = np.empty((2, len(streams), steps)), np.empty((len(streams), steps)), np.full(len(streams), row.x0)
        now = [np.full(len(streams), row.m1), np.full(len(streams), row.m2)]
        for t in range(steps):
            for k, (th, m, s) in enumerate(((row.th1, row.m1, row.s1), (row.th2, row.m2, row.s2))):
                now[k] = now[k] + th * (m - now[k]) * dt + s * root * shocks[k][:, t]
                x[k, :, t] = now[k]
            level = level + row.kappa * (row.mu - level) * dt + row.sigma0 * np.exp(row.delta1 * now[0] + row.delta2 * now[1]) * root * z[:, 2, t]
            v[:, t] = level
        return {"v": v, "x1": x[0], "x2": x[1]}

    names = ["th1", "m1", "s1", "th2", "m2", "s2", "rho", "x0", "kappa", "mu", "sigma0", "delta1", "delta2"]
    return _generate_rows(params.select(*keys, *(F.col(c).cast("double").alias(c) for c in names)), keys, n, make, ["v", "x1", "x2"], seed)


def _arma_garch_steps(row, streams, steps: int, intercept: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Returns and levels after a row of `arma.fits`."""
    beta, phi, theta = (np.asarray(x, float) for x in (row.beta, row.phi, row.theta))
    last = np.asarray(row.last_x, float)[None]
    ahead = last if row.ahead is None or not len(beta) else np.asarray(row.ahead, float).reshape(-1, len(beta))
    x = np.concatenate([last, ahead[np.minimum(np.arange(steps), len(ahead) - 1)]])
    level = row.const + (np.diff(x, axis=0) if row.d else x[1:]) @ beta
    student = row.nu is not None and row.nu > 2
    z = np.stack([r.standard_t(row.nu, steps) for r in streams]) * np.sqrt((row.nu - 2) / row.nu) if student else _normals(streams, steps)
    r, v = np.empty_like(z), np.empty_like(z)
    past = [np.full(len(z), k) for k in row.last_y] if intercept else []
    e = [np.full(len(z), k) for k in row.last_e]
    state = np.repeat(np.asarray(row.state, float)[None], len(z), 0)
    move, load = np.zeros((state.shape[1],) * 2), np.append(1.0, np.zeros(state.shape[1] - 1))
    move[: len(phi), 0], load[1 : 1 + len(theta)] = phi, theta
    move += np.eye(len(move), k=1)
    s2 = row.omega / (1 - row.alpha - row.garch_beta) if row.alpha + row.garch_beta < 1 else row.omega
    now, value = np.log(np.full(len(z), float(row.s0))), np.full(len(z), row.last_y[0])
    s2 = np.full(len(z), s2)
    for t in range(steps):
        s2 = np.maximum(row.omega + row.alpha * (100 * e[0]) ** 2 + row.garch_beta * s2, 1e-12)
        new = np.sqrt(s2) / 100 * z[:, t]
        if intercept:
            step = level[t] + sum((a * b for a, b in zip(phi, past, strict=False)), 0.0) + sum((a * b for a, b in zip(theta, e, strict=False)), 0.0) + new
            past = [step, *past[:-1]]
        else:
            state = state + new[:, None] * load
            step = level[t] + state[:, 0]
            state = state @ move.T
        e = [new, *e[:-1]]
        value = value + step if row.d else step
        r[:, t] = value
        now = now + value
        v[:, t] = np.exp(now)
    return r, v


def arma_garch_rows(fits: DataFrame, keys: Sequence[str], n: int, steps: int, future: DataFrame | None = None, drivers: Sequence[str] = (), order: str = "d", intercept: bool = False, seed: int = 42) -> DataFrame:
    """(keys, sim_id, t, r, v): returns and levels that go on from the end of every row of `arma.fits` (d of 0 or 1), all rows in one job.

    The first step takes the state that the fit expects next, its last error and variance equation;
    its mean is the one-step forecast. Innovations are standardised, Student's where nu is given. Future values of
    the drivers come from `future` (keys, order, drivers), in its order; where it ends, or without
    it, the last ones stay. v starts at s0, a column of `fits` (100 if there is none), before step 0.
    With `intercept` const is added to the autoregression of the values themselves, not of their
    deviations from the level.
    """
    rows = fits if "s0" in fits.columns else fits.withColumn("s0", F.lit(100.0))
    if future is not None:
        nth = F.row_number().over(Window.partitionBy(*keys).orderBy(order))
        cells = F.struct(F.col("_n"), F.array(*(F.col(c).cast("double") for c in drivers)).alias("x"))
        known = future.dropna(subset=list(drivers)).withColumn("_n", nth).filter(F.col("_n") <= steps).groupBy(*keys).agg(F.array_sort(F.collect_list(cells)).alias("_c"))
        rows = rows.join(known.select(*keys, F.flatten(F.transform("_c", lambda c: c["x"])).alias("ahead")), list(keys), "left")
    else:
        rows = rows.withColumn("ahead", F.lit(None).cast("array<double>"))

    def make(row, streams):
        r, v = _arma_garch_steps(row, streams, steps, intercept)
        return {"r": r, "v": v}

    names = ["d", "const", "beta", "phi", "theta", "omega", "alpha", "garch_beta", "nu", "state", "last_e", "last_x", "last_y", "s0", "ahead"]
    return _generate_rows(rows.select(*keys, *names), keys, n, make, ["r", "v"], seed)


def _normals(streams: list[np.random.Generator], steps: int) -> np.ndarray:
    return np.stack([r.standard_normal(steps) for r in streams])


# Kernels: a row of parameters, the streams of some simulations, and the number of steps give their paths.


def _gbm(row, streams, steps: int, dt: float) -> np.ndarray:
    r = (row.mu - row.sigma**2 / 2) * dt + row.sigma * dt**0.5 * _normals(streams, steps - 1)
    return row.s0 * np.exp(np.concatenate([np.zeros((len(r), 1)), r.cumsum(1)], 1))


def _ou(row, streams, steps: int, exact: bool = False) -> np.ndarray:
    a = np.exp(-row.kappa) if exact else 1 - row.kappa
    s = row.sigma * np.sqrt((1 - np.exp(-2 * row.kappa)) / (2 * row.kappa)) if exact else row.sigma
    z = _normals(streams, steps)
    v = np.empty_like(z)
    v[:, 0] = row.x0
    for t in range(1, steps):
        v[:, t] = row.mu + a * (v[:, t - 1] - row.mu) + s * z[:, t]
    return v


def _ou_driven(row, streams, steps: int) -> np.ndarray:
    deltas = np.asarray(row.deltas, float)
    z = np.asarray(row.drivers, float).reshape(-1, len(deltas))
    z = (z - z.mean(0)) / (z.std(0) + 1e-8)
    vol = row.sigma0 * np.exp(np.vstack([np.zeros(len(deltas)), z])[:-1] @ deltas)
    e = _normals(streams, steps)
    v = np.empty_like(e)
    v[:, 0] = row.x0
    for t in range(1, steps):
        v[:, t] = v[:, t - 1] + row.kappa * (row.mu - v[:, t - 1]) + vol[min(t, len(vol) - 1)] * e[:, t]
    return v


def _ou_threshold(row, streams, steps: int) -> np.ndarray:
    k, m, s = (np.asarray(x, float) for x in (row.kappa, row.mu, row.sigma))
    factor = np.ones((steps, 3))
    if row.drivers is not None and len(row.drivers):
        deltas = np.asarray(row.deltas, float).reshape(3, -1)
        z = np.asarray(row.drivers, float).reshape(-1, deltas.shape[1])
        factor = np.exp(z[np.minimum(np.arange(steps), len(z) - 1)] @ deltas.T)
        factor[0] = 1.0
    e = _normals(streams, steps)
    v = np.empty_like(e)
    v[:, 0] = row.x0
    for t in range(1, steps):
        x = v[:, t - 1]
        r = np.where(np.abs(x) <= row.tau, 0, np.where(x > row.tau, 1, 2))
        v[:, t] = x + k[r] * (m[r] - x) + s[r] * factor[t - 1, r] * e[:, t]
    return v


def _heston(row, streams, steps: int, dt: float) -> np.ndarray:
    z = _normals(streams, 2 * (steps - 1)).reshape(len(streams), 2, steps - 1)
    x, var = np.full((len(streams), steps), np.log(row.s0)), np.full(len(streams), row.v0)
    for t in range(1, steps):
        a, b = z[:, 0, t - 1], row.rho * z[:, 0, t - 1] + np.sqrt(1 - row.rho**2) * z[:, 1, t - 1]
        x[:, t] = x[:, t - 1] + (row.mu - var / 2) * dt + np.sqrt(var * dt) * a
        var = np.maximum(var + row.kappa * (row.theta - var) * dt + row.sigma_v * np.sqrt(var * dt) * b, 0)
    return np.exp(x)


def _merton(row, streams, steps: int) -> np.ndarray:
    comp = row.rate * (np.exp(row.mu_j + row.sigma_j**2 / 2) - 1)
    count = np.stack([r.poisson(row.rate, steps - 1) for r in streams])
    z, j = _normals(streams, steps - 1), _normals(streams, steps - 1)
    r = row.mu - row.sigma**2 / 2 - comp + row.sigma * z + count * row.mu_j + np.sqrt(count) * row.sigma_j * j
    return row.s0 * np.exp(np.concatenate([np.zeros((len(r), 1)), r.cumsum(1)], 1))


def _heston_changes(row, streams, steps: int) -> np.ndarray:
    z = _normals(streams, 2 * steps).reshape(len(streams), 2, steps)
    out, var = np.empty((len(streams), steps)), np.full(len(streams), row.v0)
    for t in range(steps):
        pos = np.maximum(var, 0)
        out[:, t] = np.sqrt(pos) * z[:, 0, t]
        var = var + row.kappa * (row.theta - pos) + row.sigma_v * np.sqrt(pos) * (row.rho * z[:, 0, t] + np.sqrt(1 - row.rho**2) * z[:, 1, t])
    return out


def _jump_volatility(row, streams, steps: int) -> np.ndarray:
    z, j = _normals(streams, steps), _normals(streams, steps)
    count = np.stack([r.poisson(row.rate, steps) for r in streams])
    level, e = np.full((len(streams), steps), float(row.s0)), np.zeros(len(streams))
    s2 = np.full(len(streams), row.omega / max(1e-6, 1 - row.alpha - row.beta))
    for t in range(1, steps):
        s2 = row.omega + row.alpha * e**2 + row.beta * s2
        e = np.sqrt(s2) * z[:, t]
        level[:, t] = level[:, t - 1] * np.exp(row.mu + e / 100 + count[:, t] * row.mu_j + np.sqrt(count[:, t]) * row.sigma_j * j[:, t])
    return level


def _one(**values):
    return SimpleNamespace(**values)


def _of_rows(params: DataFrame, keys: Sequence[str], names: Sequence[str], n: int, kernel: Callable, seed: int) -> DataFrame:
    return _generate_rows(params.select(*keys, *names), keys, n, lambda row, streams: {"v": kernel(row, streams)}, ["v"], seed)


def gbm(spark: SparkSession, n: int, steps: int, s0: float, mu: float, sigma: float, dt: float = 1 / 252, seed: int = 42) -> DataFrame:
    row = _one(s0=s0, mu=mu, sigma=sigma)
    return _generate(spark, n, steps, lambda streams, k: _gbm(row, streams, k, dt), seed)


def gbm_rows(params: DataFrame, keys: Sequence[str], n: int, steps: int, dt: float = 1 / 252, seed: int = 42) -> DataFrame:
    """(keys, sim_id, t, v) for every row of (keys, s0, mu, sigma)."""
    return _of_rows(params, keys, ["s0", "mu", "sigma"], n, lambda row, streams: _gbm(row, streams, steps, dt), seed)


def ou(spark: SparkSession, n: int, steps: int, x0: float, kappa: float, mu: float, sigma: float, seed: int = 42, exact: bool = False) -> DataFrame:
    """Per-step mean reversion; `exact` uses the exact discretisation of the continuous process."""
    row = _one(x0=x0, kappa=kappa, mu=mu, sigma=sigma)
    return _generate(spark, n, steps, lambda streams, k: _ou(row, streams, k, exact), seed)


def exact_ou_rows(params: DataFrame, keys: Sequence[str], n: int, steps: int, seed: int = 42) -> DataFrame:
    """(keys, sim_id, t, v) by the exact discretisation, for every row of (keys, x0, kappa, mu, sigma)."""
    return _of_rows(params, keys, ["x0", "kappa", "mu", "sigma"], n, lambda row, streams: _ou(row, streams, steps, True), seed)


def ou_driven(spark: SparkSession, n: int, steps: int, x0: float, kappa: float, mu: float, sigma0: float, deltas: Sequence[float], drivers: np.ndarray, seed: int = 42) -> DataFrame:
    """Mean reversion whose volatility follows standardised drivers (steps x drivers) of the step before; none at step 0."""
    row = _one(x0=x0, kappa=kappa, mu=mu, sigma0=sigma0, deltas=deltas, drivers=np.asarray(drivers, float).ravel())
    return _generate(spark, n, steps, lambda streams, k: _ou_driven(row, streams, k), seed)


def ou_driven_rows(params: DataFrame, keys: Sequence[str], n: int, steps: int, seed: int = 42) -> DataFrame:
    """As `ou_driven` for every row of (keys, x0, kappa, mu, sigma0, deltas, drivers): drivers one step after the other in one array."""
    return _of_rows(params, keys, ["x0", "kappa", "mu", "sigma0", "deltas", "drivers"], n, lambda row, streams: _ou_driven(row, streams, steps), seed)


def ou_threshold(spark: SparkSession, n: int, steps: int, x0: float, tau: float, kappa: Sequence[float], mu: Sequence[float], sigma: Sequence[float], seed: int = 42, deltas: Sequence[Sequence[float]] | None = None, drivers: np.ndarray | None = None) -> DataFrame:
    """Mean reversion that switches by the current level: inside +/- tau, above, below.

    With `deltas` (a row of each regime) the deviation follows `drivers` (steps x drivers, clipped
    z-scores; the last row is continued) of the step before; none at step 0.
    """
    row = _one(x0=x0, tau=tau, kappa=kappa, mu=mu, sigma=sigma, deltas=None if deltas is None else np.asarray(deltas, float).ravel(), drivers=None if deltas is None or drivers is None else np.asarray(drivers, float).ravel())
    return _generate(spark, n, steps, lambda streams, k: _ou_threshold(row, streams, k), seed)


def ou_threshold_rows(params: DataFrame, keys: Sequence[str], n: int, steps: int, seed: int = 42) -> DataFrame:
    """As `ou_threshold` for every row of (keys, x0, tau; kappa, mu, sigma: an entry a regime; deltas: regime by regime; drivers: step by step, or null)."""
    return _of_rows(params, keys, ["x0", "tau", "kappa", "mu", "sigma", "deltas", "drivers"], n, lambda row, streams: _ou_threshold(row, streams, steps), seed)


def heston(spark: SparkSession, n: int, steps: int, s0: float, mu: float, v0: float, kappa: float, theta: float, sigma_v: float, rho: float, dt: float = 1 / 252, seed: int = 42) -> DataFrame:
    """Stochastic volatility; the variance is floored at zero after every step."""
    row = _one(s0=s0, mu=mu, v0=v0, kappa=kappa, theta=theta, sigma_v=sigma_v, rho=rho)
    return _generate(spark, n, steps, lambda streams, k: _heston(row, streams, k, dt), seed)


def heston_rows(params: DataFrame, keys: Sequence[str], n: int, steps: int, dt: float = 1 / 252, seed: int = 42) -> DataFrame:
    """(keys, sim_id, t, v) for every row of (keys, s0, mu, v0, kappa, theta, sigma_v, rho)."""
    return _of_rows(params, keys, ["s0", "mu", "v0", "kappa", "theta", "sigma_v", "rho"], n, lambda row, streams: _heston(row, streams, steps, dt), seed)


def merton(spark: SparkSession, n: int, steps: int, s0: float, mu: float, sigma: float, rate: float, mu_j: float, sigma_j: float, seed: int = 42) -> DataFrame:
    """Jump diffusion per step with a compensated drift."""
    row = _one(s0=s0, mu=mu, sigma=sigma, rate=rate, mu_j=mu_j, sigma_j=sigma_j)
    return _generate(spark, n, steps, lambda streams, k: _merton(row, streams, k), seed)


def merton_rows(params: DataFrame, keys: Sequence[str], n: int, steps: int, seed: int = 42) -> DataFrame:
    """(keys, sim_id, t, v) for every row of (keys, s0, mu, sigma, rate, mu_j, sigma_j)."""
    return _of_rows(params, keys, ["s0", "mu", "sigma", "rate", "mu_j", "sigma_j"], n, lambda row, streams: _merton(row, streams, steps), seed)


def arma_garch(spark: SparkSession, n: int, steps: int, s0: float, const: float, phi: float, theta: float, omega: float, alpha: float, beta: float, nu: float | None = None, seed: int = 42) -> DataFrame:
    """Levels of ARMA(1,1)-GARCH(1,1) returns; the variance is in squared percent, innovations are standardised."""

    def make(streams, steps):
        if nu:
            z = np.stack([r.standard_t(nu, steps) for r in streams]) * np.sqrt((nu - 2) / nu)
        else:
            z = _normals(streams, steps)
        m = len(streams)
        level = np.full((m, steps), float(s0))
        s2, e, r = np.full(m, omega / max(1e-6, 1 - alpha - beta)), np.zeros(m), np.full(m, const / max(1e-6, 1 - phi))
        for t in range(1, steps):
            s2 = omega + alpha * (100 * e) ** 2 + beta * s2
            new = np.sqrt(s2) / 100 * z[:, t]
            r = const + phi * r + theta * e + new
            e = new
            level[:, t] = level[:, t - 1] * np.exp(r)
        return level

    return _generate(spark, n, steps, make, seed)


def dtw_series(a: np.ndarray, b: np.ndarray) -> float:
    """Dynamic time warping of two series scaled to 0..1, over the longer length; a row at a time."""
    a, b = (x - x.min() if x.max() == x.min() else (x - x.min()) / (x.max() - x.min()) for x in (a, b))
    row = np.append(0.0, np.full(len(b), np.inf))
    for x in a:
        cost, new = np.abs(x - b), np.full(len(b) + 1, np.inf)
        reach = np.minimum(row[:-1], row[1:]) + cost
        total = np.cumsum(cost)
        # new[j] = min over k <= j of reach[k] + cost[k+1..j]
        new[1:] = np.minimum.accumulate(reach - total) + total
        row = new
    return float(row[-1]) / max(len(a), len(b))


def dtw_batch(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """`dtw_series` of every row of a with the same row of b: one loop over the steps of a for the whole batch."""

    def scaled(x: np.ndarray) -> np.ndarray:
        low, spread = x.min(1, keepdims=True), np.ptp(x, axis=1, keepdims=True)
        return (x - low) / np.where(spread == 0, 1, spread)

    a, b = scaled(a), scaled(b)
    n, m = b.shape
    row = np.full((n, m + 1), np.inf)
    row[:, 0] = 0
    for t in range(a.shape[1]):
        cost = np.abs(a[:, t, None] - b)
        total = np.cumsum(cost, axis=1)
        reach = np.minimum(row[:, :-1], row[:, 1:]) + cost - total
        row = np.concatenate([np.full((n, 1), np.inf), np.minimum.accumulate(reach, axis=1) + total], 1)
    return row[:, -1] / max(a.shape[1], m)


def dtw(paths: DataFrame, actual: DataFrame, by: Sequence[str] = ("sim_id",)) -> DataFrame:
    """dtw per path against the actual series (t, a). A path is a row; those of one length are a batch of a task. Steps without a value of either go."""
    cells = F.array_sort(F.collect_list(F.struct("t", F.col("a").cast("double").alias("a"), F.col("v").cast("double").alias("v"))))
    rows = paths.join(actual, "t").filter("a is not null and v is not null").groupBy(*by).agg(cells.alias("c"))
    rows = rows.select(*by, F.transform("c", lambda c: c["a"]).alias("a"), F.transform("c", lambda c: c["v"]).alias("v"))

    def run(batches):
        for pdf in batches:
            for _, same in pdf.groupby(pdf["a"].map(len)):
                for at in range(0, len(same), BATCH):
                    part = same.iloc[at : at + BATCH]
                    d = dtw_batch(np.stack(part["a"].to_numpy()), np.stack(part["v"].to_numpy()))
                    yield part[list(by)].assign(dtw=d)

    keys = "".join(f"{k} {paths.schema[k].dataType.simpleString()}, " for k in by)
    return rows.mapInPandas(run, keys + "dtw double")


def ou_pair(spark: SparkSession, n: int, steps: int, x0: tuple[float, float], theta: tuple[float, float], mu: tuple[float, float], sigma: tuple[float, float], rho: float, dt: float = 1 / 252, seed: int = 42) -> DataFrame:
    """(sim_id, t, v, w): two mean-reverting series with correlated shocks."""
    one = spark.createDataFrame([(0, *map(float, (*x0, *theta, *mu, *sigma, rho)))], "pair int, a double, b double, ka double, kb double, ma double, mb double, sa double, sb double, rho double")
    return ou_pair_rows(one, ["pair"], n, steps, dt, seed).drop("pair")


def ou_pair_rows(params: DataFrame, keys: Sequence[str], n: int, steps: int, dt: float = 1 / 252, seed: int = 42) -> DataFrame:
    """(keys, sim_id, t, v, w) for every row of (keys, a, b: starts; ka, kb: reversion; ma, mb: levels; sa, sb: deviations; rho)."""
    root = dt**0.5

    def make(row, streams):
        rho = max(-0.9999, min(0.9999, row.rho))
        z = _normals(streams, 2 * steps).reshape(len(streams), 2, steps)
        out = {}
        for name, x, th, m, s, e in (("v", row.a, row.ka, row.ma, row.sa, z[:, 0]), ("w", row.b, row.kb, row.mb, row.sb, rho * z[:, 0] + np.sqrt(1 - rho**2) * z[:, 1])):
            level = np.empty_like(e)
            level[:, 0] = x
            for t in range(1, steps):
                level[:, t] = level[:, t - 1] + th * (m - level[:, t - 1]) * dt + s * root * e[:, t]
            out[name] = level
        return out

    return _generate_rows(params.select(*keys, "a", "b", "ka", "kb", "ma", "mb", "sa", "sb", "rho"), keys, n, make, ["v", "w"], seed)


def state_draws(spark: SparkSession, n: int, steps: int, mu: float, sigma: float, transform: str = "none", seed: int = 42) -> DataFrame:
    """Independent normal draws of a regime's emission, back on the scale before a log or log1p transform."""
    back = {"none": lambda x: x, "log": np.exp, "log1p": np.expm1}[transform]
    return _generate(spark, n, steps, lambda streams, k: back(mu + sigma * _normals(streams, k)), seed)


def heston_changes(spark: SparkSession, n: int, steps: int, v0: float, kappa: float, theta: float, sigma_v: float, rho: float, seed: int = 42) -> DataFrame:
    """Changes with stochastic variance per step, the variance truncated at zero."""
    row = _one(v0=v0, kappa=kappa, theta=theta, sigma_v=sigma_v, rho=rho)
    return _generate(spark, n, steps, lambda streams, k: _heston_changes(row, streams, k), seed)


def heston_changes_rows(params: DataFrame, keys: Sequence[str], n: int, steps: int, seed: int = 42) -> DataFrame:
    """(keys, sim_id, t, v) for every row of (keys, v0, kappa, theta, sigma_v, rho)."""
    return _of_rows(params, keys, ["v0", "kappa", "theta", "sigma_v", "rho"], n, lambda row, streams: _heston_changes(row, streams, steps), seed)


def jump_volatility(spark: SparkSession, n: int, steps: int, s0: float, garch: dict[str, float], rate: float, mu_j: float, sigma_j: float, seed: int = 42) -> DataFrame:
    """Levels of GARCH(1,1) returns (variance in squared percent) with normal jumps at Poisson counts."""
    row = _one(s0=s0, rate=rate, mu_j=mu_j, sigma_j=sigma_j, omega=garch["omega"], alpha=garch["alpha"], beta=garch["beta"], mu=garch.get("mu", 0.0))
    return _generate(spark, n, steps, lambda streams, k: _jump_volatility(row, streams, k), seed)


def jump_volatility_rows(params: DataFrame, keys: Sequence[str], n: int, steps: int, seed: int = 42) -> DataFrame:
    """(keys, sim_id, t, v) for every row of (keys, s0, mu, omega, alpha, beta, rate, mu_j, sigma_j), as `estimators.jump_garch` fits them."""
    return _of_rows(params, keys, ["s0", "mu", "omega", "alpha", "beta", "rate", "mu_j", "sigma_j"], n, lambda row, streams: _jump_volatility(row, streams, steps), seed)


#: The parts of a row of `delayed_grid_rows`: prefix, and the columns of that model's fit.
GRID = {
    "h_": ("s0", "mu", "v0", "kappa", "theta", "sigma_v", "rho"),
    "g_": ("d", "const", "beta", "phi", "theta", "omega", "alpha", "garch_beta", "nu", "state", "last_e", "last_x", "last_y", "s0", "ahead"),
    "c_": ("v0", "kappa", "theta", "sigma_v", "rho"),
    "o_": ("x0", "kappa", "mu", "sigma"),
}


def delayed_grid_rows(params: DataFrame, keys: Sequence[str], n: int, seed: int = 42) -> DataFrame:
    """(keys, nav_model, gap_model, sim_id, t, v): log changes of a fund that follows two NAV models times two premium models, for every row of fits.

    The fund starts at nav0 (1 + gap0) and follows the product by a step, over `steps` steps. The
    four paths of a simulation are made together, each model once, from a stream of its own, so that
    nothing is joined. `params` holds steps, nav0, gap0 and the columns of GRID: Heston, ARMA-GARCH,
    changes of stochastic variance, mean reversion. A change from or to a level that is not positive is left out.
    """
    pairs = [(a, b) for a in ("heston", "arma_garch") for b in ("heston_sv", "ou")]

    def make(row, streams):
        own = [[np.random.default_rng([seed + k, *r.integers(0, 2**31, 2).tolist()]) for r in streams] for k in range(4)]
        h, g, c, o = (SimpleNamespace(**{x: getattr(row, prefix + x) for x in fields}) for prefix, fields in GRID.items())
        steps = int(row.steps)
        navs = {"heston": _heston(h, own[0], steps, 1 / 252), "arma_garch": _arma_garch_steps(g, own[1], steps)[1]}
        gaps = {"heston_sv": row.gap0 + _heston_changes(c, own[2], steps).cumsum(1), "ou": _ou(o, own[3], steps)}
        out = {}
        for a, b in pairs:
            level = np.concatenate([np.full((len(streams), 1), row.nav0 * (1 + row.gap0)), navs[a] * (1 + gaps[b])], 1)
            usable = (level[:, 1:] > 0) & (level[:, :-1] > 0)
            change = np.log(np.where(usable, level[:, 1:] / level[:, :-1], 1.0))
            out[f"{a}_{b}"] = np.where(usable, change, np.nan)
        return out

    names = [f"{a}_{b}" for a, b in pairs]
    columns = [prefix + x for prefix, fields in GRID.items() for x in fields]
    rows = _generate_rows(params.select(*keys, "steps", "nav0", "gap0", *columns), keys, n, make, names, seed)
    cells = F.explode(F.array(*(F.struct(F.lit(a).alias("nav_model"), F.lit(b).alias("gap_model"), F.col(f"{a}_{b}").alias("v")) for a, b in pairs)))
    return rows.select(*keys, "sim_id", (F.col("t") + 1).alias("t"), cells.alias("_c")).select(*keys, "_c.nav_model", "_c.gap_model", "sim_id", "t", "_c.v").filter(~F.isnan("v"))
