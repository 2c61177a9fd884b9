"""Regressions with ARMA errors by exact Gaussian likelihood, GARCH of their residuals, and AR-GARCH in one likelihood.

A row of the fits is a series and an order. The series of a task are fitted in one numpy batch: the
Kalman filter's gains depend on the coefficients alone, so that one loop over time does for all
series, starting points and the steps of numerical gradients. Level, drivers and variance have closed
forms given the coefficients and are concentrated out.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.operators import regime

#: A shorter series is not fitted.
LEAST = 30
#: Series fitted in one batch; a task takes them one batch after the other.
BATCH = 32
#: Starting points: partial correlations of all autoregressive and all moving-average terms.
STARTS = ((0.0, 0.0), (0.5, -0.3), (-0.4, 0.4))


def coefficients(u: np.ndarray) -> np.ndarray:
    """Coefficients of stationary autoregressions from free numbers (batch, p): tanh gives the partial correlations, Durbin and Levinson's recursion the rest."""
    partial = np.tanh(u)
    out = np.zeros_like(partial)
    for k in range(partial.shape[1]):
        out[:, :k] = out[:, :k] - partial[:, k : k + 1] * out[:, :k][:, ::-1]
        out[:, k] = partial[:, k]
    return out


def filtered(phi: np.ndarray, theta: np.ndarray, x: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """One-step errors of x (batch, time, columns) as ARMA processes, over the roots of their variances; those roots; sums of the variances' logs; the state expected next.

    The variance of the innovations is 1; what lies behind a series' length is 0. The state is exact
    from the stationary start on.
    """
    n, time, columns = x.shape
    p, q = phi.shape[1], theta.shape[1]
    m = max(p, q + 1)
    move = np.zeros((n, m, m))
    move[:, :p, 0] = phi
    move[:, np.arange(m - 1), np.arange(1, m)] = 1
    load = np.zeros((n, m))
    load[:, 0], load[:, 1 : q + 1] = 1, theta
    noise = load[:, :, None] * load[:, None]
    system = np.eye(m * m) - np.einsum("bij,bkl->bikjl", move, move).reshape(n, m * m, m * m)
    spread = np.linalg.solve(system, noise.reshape(n, m * m, 1)).reshape(n, m, m)
    state, out, roots = np.zeros((n, m, columns)), np.zeros_like(x), np.ones((n, time))
    ahead = np.zeros_like(state)
    settled, gain, root = False, None, None
    for t in range(time):
        if not settled:
            f = spread[:, 0, 0]
            gain = (move @ spread[:, :, :1])[:, :, 0] / f[:, None]
            new = move @ spread @ move.transpose(0, 2, 1) + noise - f[:, None, None] * gain[:, :, None] * gain[:, None]
            settled, spread, root = bool(np.abs(new - spread).max() < 1e-14), new, np.sqrt(f)
        error = x[:, t] - state[:, 0]
        state = move @ state + gain[:, :, None] * error[:, None]
        out[:, t], roots[:, t] = error / root[:, None], root
        if (at := lengths == t + 1).any():
            ahead[at] = state[at]
    inside = np.arange(time) < lengths[:, None]
    out[~inside] = 0
    logs = np.where(inside, 2 * np.log(roots), 0).sum(1)
    return out, roots, logs, ahead


def concentrated(phi: np.ndarray, theta: np.ndarray, x: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Log likelihood at the best level and drivers, which are given with the variance, the one-step errors and the state expected next; column 0 of x is the value."""
    z, roots, logs, ahead = filtered(phi, theta, x, lengths)
    y, a = z[:, :, 0], z[:, :, 1:]
    if a.shape[2]:
        gram, right = np.einsum("bti,btj->bij", a, a), np.einsum("bti,bt->bi", a, y)
        beta = np.matmul(np.linalg.pinv(gram, rcond=1e-14, hermitian=True), right[:, :, None])[:, :, 0]
        y = y - np.einsum("bti,bi->bt", a, beta)
    else:
        beta = np.zeros((len(x), 0))
    variance = (y * y).sum(1) / lengths
    with np.errstate(divide="ignore"):
        ll = -0.5 * (lengths * (math.log(2 * math.pi) + np.log(variance) + 1) + logs)
    return ll, beta, variance, y * roots, ahead[:, :, 0] - np.einsum("bmi,bi->bm", ahead[:, :, 1:], beta)


def minimise(f: Callable[[np.ndarray, np.ndarray], np.ndarray], x: np.ndarray, rounds: int = 100, step: float = 1e-5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Quasi-Newton descent of a batch of problems at once: points, values, and whether the last gradient was small.

    f(which, points) gives the values of points of the problems `which`; gradients are central differences.
    """
    n, k = x.shape
    which = np.arange(n)
    value = f(which, x)
    if not k:
        return x, value, np.isfinite(value)
    x, value, done = x.copy(), value.copy(), ~np.isfinite(value)
    small = np.zeros(n, bool)

    def gradient(open_: np.ndarray) -> np.ndarray:
        moves = np.concatenate([np.eye(k), -np.eye(k)]) * step
        points = (x[open_][:, None] + moves).reshape(-1, k)
        v = f(np.repeat(open_, 2 * k), points).reshape(len(open_), 2, k)
        return (v[:, 0] - v[:, 1]) / (2 * step)

    inverse = np.repeat(np.eye(k)[None], n, 0)
    g = np.zeros((n, k))
    g[~done] = gradient(which[~done])
    inverse /= np.maximum(1, np.abs(g).max(1))[:, None, None]
    sizes = 0.5 ** np.arange(12)
    for _ in range(rounds):
        small |= ~done & (np.abs(g).max(1) < 1e-6 * np.maximum(1, np.abs(value)))
        open_ = which[~done]
        if not len(open_):
            break
        way = -np.einsum("bij,bj->bi", inverse[open_], g[open_])
        slope = (way * g[open_]).sum(1)
        up = slope >= 0
        way[up], slope[up] = -g[open_][up], -(g[open_][up] ** 2).sum(1)
        way /= np.maximum(1, np.abs(way).max(1) / 2)[:, None]
        points = x[open_][:, None] + sizes[:, None] * way[:, None]
        tried = f(np.repeat(open_, len(sizes)), points.reshape(-1, k)).reshape(len(open_), -1)
        good = tried <= value[open_][:, None] + 1e-4 * sizes * slope[:, None]
        first = good.argmax(1)
        found = good.any(1)
        rest = open_[found]
        moved = points[np.flatnonzero(found), first[found]] - x[rest]
        before = g[rest]
        gain = value[rest] - tried[np.flatnonzero(found), first[found]]
        x[rest], value[rest] = x[rest] + moved, value[rest] - gain
        done[open_[~found]] = True
        if len(rest):
            g[rest] = gradient(rest)
            turn = g[rest] - before
            along = (moved * turn).sum(1)
            fit = along > 1e-12
            if fit.any():
                r, s, y, a = rest[fit], moved[fit], turn[fit], along[fit]
                left = np.eye(k) - s[:, :, None] * y[:, None] / a[:, None, None]
                inverse[r] = left @ inverse[r] @ left.transpose(0, 2, 1) + s[:, :, None] * s[:, None] / a[:, None, None]
            done[rest[(np.abs(g[rest]).max(1) < 1e-9 * np.maximum(1, np.abs(value[rest]))) | (gain < 1e-13 * np.maximum(1, np.abs(value[rest])))]] = True
    return x, value, small | (np.abs(g).max(1) < 1e-5 * np.maximum(1, np.abs(value)))


def fit_batch(series: list[np.ndarray], p: int, d: int, q: int) -> list[dict]:
    """The fits of series (time x columns; the value first, then drivers) by one order, each the likeliest of its starts."""
    drawn = [np.diff(s, n=d, axis=0) for s in series]
    lengths = np.array([len(s) for s in drawn])
    level = int(not d)  # differences have no level of their own
    width = series[0].shape[1] + level
    x = np.zeros((len(drawn), int(lengths.max()), width))
    for row, s in zip(x, drawn, strict=True):
        row[: len(s), 0], row[: len(s), 1 + level :] = s[:, 0], s[:, 1:]
        row[: len(s), 1 : 1 + level] = 1
    scale = np.array([s[:, 0].std() or 1.0 for s in drawn])
    x[:, :, 0] /= scale[:, None]
    n = len(series)
    owner = np.tile(np.arange(n), len(STARTS))

    def loss(which: np.ndarray, u: np.ndarray) -> np.ndarray:
        own = owner[which]
        ll = concentrated(coefficients(u[:, :p]), -coefficients(u[:, p:]), x[own], lengths[own])[0]
        return np.where(np.isfinite(ll), -ll, np.inf)

    first = np.concatenate([np.tile([a] * p + [b] * q, (n, 1)).reshape(n, p + q) for a, b in np.arctanh(STARTS)])
    u, value, small = minimise(loss, first)
    best = np.where(np.isfinite(value), value, np.inf).reshape(len(STARTS), n).argmin(0)
    u, small = u.reshape(len(STARTS), n, -1)[best, np.arange(n)], small.reshape(len(STARTS), n)[best, np.arange(n)]
    phi, theta = coefficients(u[:, :p]), -coefficients(u[:, p:])
    ll, beta, variance, errors, ahead = concentrated(phi, theta, x, lengths)
    out = []
    for i, s in enumerate(drawn):
        k, size = p + q + width, int(lengths[i])
        a = x[i, :size, 1:]
        full = np.linalg.matrix_rank(a) == width - 1 if width > 1 else True
        loglik = float(ll[i] - size * math.log(scale[i]))
        b, e = beta[i] * scale[i], errors[i, :size] * scale[i]
        out.append({
            "p": p, "d": d, "q": q, "const": float(b[0]) if level else 0.0, "beta": b[level:].tolist(), "phi": phi[i].tolist(), "theta": theta[i].tolist(),
            "sigma2": float(variance[i] * scale[i] ** 2), "loglik": loglik, "aic": 2 * k - 2 * loglik, "bic": k * math.log(size) - 2 * loglik, "n": size,
            "ok": bool(full and small[i] and math.isfinite(loglik)), "errors": e,
            # What a path goes on from: the state expected next, and the last one-step errors, drivers and values, the newest first.
            "state": (ahead[i] * scale[i]).tolist(), "last_e": e[::-1][: max(q, 1)].tolist(), "last_x": series[i][-1, 1:].tolist(), "last_y": series[i][::-1, 0][: max(p, d, 1)].tolist(),
        })
    return out


# ---- GARCH with an autoregressive mean, in one likelihood ----------------------------------------


def _digamma(x: float) -> float:
    out = 0.0
    while x < 8:
        out -= 1 / x
        x += 1
    f = 1 / (x * x)
    return out + math.log(x) - 0.5 / x - f * (1 / 12 - f * (1 / 120 - f * (1 / 252 - f / 240)))


def _recursions(x: np.ndarray, a: float, block: int = 64) -> np.ndarray:
    """Columns y with y[0] = x[0] and y[t] = a y[t-1] + x[t]: a triangular product a block, a loop over blocks."""
    steps = np.arange(block)
    powers = np.tril(a ** np.maximum(steps[:, None] - steps, 0))
    inside = np.einsum("st,ntc->nsc", powers, np.pad(x, ((0, -len(x) % block), (0, 0))).reshape(-1, block, x.shape[1]))
    carry, last = (a ** (steps + 1))[:, None], np.zeros(x.shape[1])
    for part in inside:
        part += carry * last
        last = part[-1]
    return inside.reshape(-1, x.shape[1])[: len(x)]


def garch_likelihood(m: np.ndarray, omega: float, alpha: float, beta: float, nu: float | None, z: np.ndarray, a: np.ndarray, first: float) -> tuple[float, np.ndarray]:
    """Log likelihood of z with mean a m and GARCH(1,1) errors, the first variance given, and its gradient by m, omega, alpha, beta (and nu)."""
    e = z - a @ m
    squares = e * e
    inputs = np.empty((len(z), 1 + 3 + a.shape[1]))
    inputs[0], inputs[0, 0] = 0, first
    inputs[1:, 0], inputs[1:, 1], inputs[1:, 2] = omega + alpha * squares[:-1], 1, squares[:-1]
    inputs[1:, 4:] = -2 * alpha * e[:-1, None] * a[:-1]
    inputs[:, 3] = 0
    s = _recursions(inputs[:, :1], beta)[:, 0]
    inputs[1:, 3] = s[:-1]
    ds = _recursions(inputs[:, 1:], beta)
    if nu is None:
        ll = -0.5 * (np.log(2 * math.pi * s) + squares / s)
        by_s, by_e = -0.5 / s + 0.5 * squares / s**2, -e / s
    else:
        w = squares / (s * (nu - 2))
        ll = math.lgamma((nu + 1) / 2) - math.lgamma(nu / 2) - 0.5 * np.log(math.pi * (nu - 2) * s) - (nu + 1) / 2 * np.log1p(w)
        by_s, by_e = -0.5 / s + (nu + 1) / 2 * w / (1 + w) / s, -(nu + 1) * e / (s * (nu - 2)) / (1 + w)
    found = by_s @ ds
    by_m = found[3:] - by_e @ a
    gradient = [*by_m, *found[:3]]
    if nu is not None:
        gradient.append(len(z) * 0.5 * (_digamma((nu + 1) / 2) - _digamma(nu / 2) - 1 / (nu - 2)) + float((-0.5 * np.log1p(w) + (nu + 1) / 2 * w / (1 + w) / (nu - 2)).sum()))
    return float(ll.sum()), np.array(gradient)


def _descend(f: Callable[[np.ndarray], tuple[float, np.ndarray]], x: np.ndarray, rounds: int = 300) -> tuple[np.ndarray, float]:
    """Quasi-Newton descent with a given gradient; never ends above where it began."""
    value, g = f(x)
    inverse = np.eye(len(x)) / max(1.0, float(np.abs(g).max()))
    for _ in range(rounds):
        way = -inverse @ g
        if way @ g >= 0:
            inverse = np.eye(len(x)) / max(1.0, float(np.abs(g).max()))
            way = -inverse @ g
        way /= max(1.0, float(np.abs(way).max()))
        size = 1.0
        while size > 1e-10:
            tried, new = f(x + size * way)
            if math.isfinite(tried) and tried <= value + 1e-4 * size * (way @ g):
                break
            size /= 2
        else:
            return x, value
        moved, turn = size * way, new - g
        x, gain, value, g = x + moved, value - tried, tried, new
        along = moved @ turn
        if along > 1e-14:
            left = np.eye(len(x)) - np.outer(moved, turn) / along
            inverse = left @ inverse @ left.T + np.outer(moved, moved) / along
        if np.abs(g).max() < 1e-7 * max(1.0, abs(value)) or gain < 1e-13 * max(1.0, abs(value)):
            break
    return x, value


def ar_garch_series(z: np.ndarray, lags: int = 0, student: bool = False) -> dict:
    """A constant and `lags` autoregressive terms with GARCH(1,1) errors of 100 z, by one likelihood given the first `lags` values.

    The search starts from least squares for the mean and the likeliest variance of its residuals;
    that two-step likelihood is given beside the joint one. The first variance is that of these residuals.
    """
    z = 100 * np.asarray(z, float)
    a = np.column_stack([np.ones(len(z) - lags), *(z[lags - k : len(z) - k] for k in range(1, lags + 1))])
    y = z[lags:]
    m = np.linalg.lstsq(a, y, rcond=None)[0]
    first = float((y - a @ m).var()) or 1e-12

    def unpacked(u: np.ndarray) -> tuple[float, float, float, float | None, np.ndarray]:
        """omega, alpha, beta, nu and the derivatives of each by its own free numbers."""
        v = np.clip(u, -40, 40)
        ea, eb = math.exp(v[1]), math.exp(v[2])
        total = 1 + ea + eb
        alpha, beta = ea / total, eb / total
        by = np.zeros((len(u), len(u)))
        by[0, 0] = math.exp(v[0])
        by[1:3, 1:3] = [[alpha * (1 - alpha), -alpha * beta], [-alpha * beta, beta * (1 - beta)]]
        if student:
            by[3, 3] = math.exp(min(v[3], 8.0))
        return math.exp(v[0]), alpha, beta, 2.05 + by[3, 3] if student else None, by

    def loss(u: np.ndarray, mean: np.ndarray | None = None) -> tuple[float, np.ndarray]:
        k = 0 if mean is not None else a.shape[1]
        omega, alpha, beta, nu, by = unpacked(u[k:])
        ll, g = garch_likelihood(u[:k] if mean is None else mean, omega, alpha, beta, nu, y, a, first)
        return -ll, -np.append(g[: a.shape[1]] if mean is None else [], by @ g[a.shape[1] :])

    start = np.array([math.log(0.1 * first), math.log(0.08 / 0.1), math.log(0.82 / 0.1), math.log(6)][: 4 if student else 3])
    u, two = _descend(lambda v: loss(v, m), start)
    u, joint = _descend(loss, np.append(m, u))
    omega, alpha, beta, nu, _ = unpacked(u[a.shape[1] :])
    k, e = len(u), y - a @ u[: a.shape[1]]
    return {
        "const": float(u[0]) / 100, "phi": u[1 : a.shape[1]].tolist(), "omega": omega, "alpha": alpha, "beta": beta, "nu": nu if nu is not None else float("nan"),
        "loglik": -joint, "two_step": -two, "aic": 2 * k + 2 * joint, "bic": k * math.log(len(y)) + 2 * joint, "n": len(y), "last_e": (e[::-1][:1] / 100).tolist(), "last_z": (z[::-1][: max(lags, 1)] / 100).tolist(),
    }


# ---- as tables -----------------------------------------------------------------------------------


def _whole_series(df: DataFrame, columns: Sequence[str], by: Sequence[str], order: str) -> DataFrame:
    """(by, _x): a row a series, its columns one time after the other; rows with a null or a value that is not finite go."""
    cells = [F.col(c).cast("double") for c in columns]
    finite = F.lit(True)
    for c in cells:
        finite = finite & c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    rows = df.filter(finite).groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("t"), F.array(*cells).alias("x")))).alias("_s"))
    return rows.select(*by, F.flatten(F.transform("_s", lambda s: s["x"])).alias("_x"))


def _keyed(pdf: pd.DataFrame, by: Sequence[str], fits: list[dict | None]) -> Iterator[dict]:
    for key, fit in zip(pdf[list(by)].itertuples(index=False), fits, strict=True):
        if fit is not None:
            yield dict(zip(by, key, strict=True)) | fit


_FIT = "p int, d int, q int, const double, beta array<double>, phi array<double>, theta array<double>, sigma2 double, loglik double, aic double, bic double, n bigint, ok boolean, state array<double>, last_e array<double>, last_x array<double>, last_y array<double>"
_GARCH = "omega double, alpha double, garch_beta double, nu double, garch_loglik double"


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def _kinds(df: DataFrame, by: Sequence[str]) -> str:
    return "".join(f"{b} {df.schema[b].dataType.simpleString()}, " for b in by)


def fits(df: DataFrame, value: str, drivers: Sequence[str] = (), orders: Sequence[tuple[int, int, int]] = ((1, 0, 1),), variance: str | None = "t", by: Sequence[str] = ("s",), order: str = "d") -> DataFrame:
    """A row a series and order (p, d, q): a regression on `drivers` with ARMA errors, by exact likelihood, and GARCH(1,1) of its one-step errors.

    const is the level of the undifferenced process (0 where d > 0: differences have none), beta the
    drivers' coefficients, differenced like the value. `variance` is t, normal, or None for no GARCH
    columns; they are of 100 times the errors, as are all variances here. ok says that the search
    ended at a flat place, the drivers are independent and the variance is positive. state and last_* are what
    `paths.arma_garch_rows` goes on from. Series of fewer than LEAST rows have no row.
    """
    columns = 1 + len(drivers)
    names = [*by, *_names(_FIT), *(_names(_GARCH) if variance else [])]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), BATCH):
                part = pdf.iloc[at : at + BATCH]
                series = [np.asarray(x, float).reshape(-1, columns) for x in part["_x"]]
                able = [i for i, s in enumerate(series) if len(s) >= LEAST]
                out: list[dict] = []
                for p, d, q in orders:
                    found: list[dict | None] = [None] * len(series)
                    for i, fit in zip(able, fit_batch([series[i] for i in able], p, d, q) if able else [], strict=True):
                        found[i] = fit
                        if variance:
                            g = ar_garch_series(fit["errors"], 0, variance == "t") if fit["sigma2"] > 0 else dict.fromkeys(["omega", "alpha", "beta", "nu", "loglik"], float("nan"))
                            fit |= {"omega": g["omega"], "alpha": g["alpha"], "garch_beta": g["beta"], "nu": g["nu"], "garch_loglik": g["loglik"]}
                    out += _keyed(part, by, found)
                yield pd.DataFrame([{k: r[k] for k in names} for r in out], columns=names)

    schema = _kinds(df, by) + _FIT + (", " + _GARCH if variance else "")
    return regime._spread(_whole_series(df, [value, *drivers], by, order), by).mapInPandas(run, schema)


def best_orders(fits: DataFrame, criterion: str = "aic", by: Sequence[str] = ("s",)) -> DataFrame:
    """Of each series the fit of the least criterion among those that succeeded; of equal ones that of the smallest (p, d, q). Compare orders of one d only."""
    least = F.min_by(F.struct(*fits.columns), F.struct(F.when(F.col("ok"), F.col(criterion)).otherwise(float("inf")), "p", "d", "q"))
    return fits.groupBy(*by).agg(least.alias("_f")).select("_f.*")


def first_of_orders(fits: DataFrame, orders: Sequence[tuple[int, int, int]], by: Sequence[str] = ("s",)) -> DataFrame:
    """Of each series the first of `orders` whose fit succeeded, with its place as fallback (0: the wanted one); the last is taken in any case."""
    place = F.lit(None).cast("int")
    for i, o in reversed(list(enumerate(orders))):
        hit = (F.col("p") == o[0]) & (F.col("d") == o[1]) & (F.col("q") == o[2])
        place = F.when(hit, i).otherwise(place)
    rows = fits.withColumn("fallback", place).filter("fallback is not null")
    usable = F.col("ok") | (F.col("fallback") == len(orders) - 1)
    nth = F.row_number().over(Window.partitionBy(*by).orderBy("fallback"))
    return rows.filter(usable).withColumn("_n", nth).filter("_n = 1").drop("_n")


def ar_garch(df: DataFrame, value: str, lags: int = 0, student: bool = False, by: Sequence[str] = ("s",), order: str = "d") -> DataFrame:
    """const, phi, omega, alpha, garch_beta, nu of each series by one likelihood, beside that of the two-step fit; variances are of 100 times the value."""
    schema = _kinds(df, by) + "const double, phi array<double>, omega double, alpha double, garch_beta double, nu double, loglik double, two_step double, aic double, bic double, n bigint, last_e array<double>, last_z array<double>"
    names = _names(schema)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [ar_garch_series(np.asarray(x, float), lags, student) if len(x) >= LEAST and np.ptp(x) > 0 else None for x in pdf["_x"]]
            rows = [r | {"garch_beta": r["beta"]} for r in _keyed(pdf, by, found)]
            yield pd.DataFrame([{k: r[k] for k in names} for r in rows], columns=names)

    return regime._spread(_whole_series(df, [value], by, order), by).mapInPandas(run, schema)
