"""Column functions over one ordered series; every window is partitioned by the series key."""

from __future__ import annotations

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F


def ordered(by: tuple[str, ...] = ("s",), order: tuple[str, ...] = ("d",)) -> WindowSpec:
    return Window.partitionBy(*by).orderBy(*order)


def gated(value: Column, counted: Column, n: int, w: WindowSpec) -> Column:
    """`value` where the frame holds `n` non-null values, else null (a full rolling window)."""
    return F.when(F.count(counted).over(w) == n, value)


def last_rows(w: WindowSpec, n: int, until: int = 0) -> WindowSpec:
    """The `n` rows up to `until` rows before the current one."""
    return w.rowsBetween(-(n - 1) - until, -until)


def diff(x: Column, w: WindowSpec) -> Column:
    return x - F.lag(x).over(w)


def log_return(x: Column, w: WindowSpec) -> Column:
    """ln(x / previous x); null where either is not positive."""
    before = F.lag(x).over(w)
    return F.when((x > 0) & (before > 0), F.ln(x / before))


def pct_change(x: Column, w: WindowSpec) -> Column:
    before = F.lag(x).over(w)
    return x / F.nullif(before, F.lit(0.0)) - 1


def rolling_sumsq_vol(r: Column, w: WindowSpec, n: int = 30) -> Column:
    """Square root of the sum of `n` squared returns."""
    f = last_rows(w, n)
    return gated(F.sqrt(F.sum(r * r).over(f)), r, n, f)


def rolling_std(r: Column, w: WindowSpec, n: int, scale: float = 1.0) -> Column:
    f = last_rows(w, n)
    return gated(F.stddev_samp(r).over(f) * scale, r, n, f)


def rolling_mean(x: Column, w: WindowSpec, n: int, until: int = 0) -> Column:
    f = last_rows(w, n, until)
    return gated(F.avg(x).over(f), x, n, f)


def rolling_corr(x: Column, y: Column, w: WindowSpec, n: int) -> Column:
    f = last_rows(w, n)
    both = F.when(x.isNotNull() & y.isNotNull(), x)
    # By moments: corr() of a frame without variance is an error in ANSI mode.
    spread = F.stddev_pop(x).over(f) * F.stddev_pop(y).over(f)
    return gated(F.covar_pop(x, y).over(f) / F.nullif(spread, F.lit(0.0)), both, n, f)


def asvi(x: Column, w: WindowSpec, n: int = 4) -> Column:
    """Abnormal interest: distance from the mean of the `n` rows before, in their sample deviations."""
    f = last_rows(w, n, 1)
    return gated((x - F.avg(x).over(f)) / F.nullif(F.stddev_samp(x).over(f), F.lit(0.0)), x, n, f)


def spread_from_range(high: Column, low: Column, w: WindowSpec) -> Column:
    """High-low spread estimate from one row and the next."""
    b = F.pow(F.ln(high / low), 2)
    a = F.pow(F.sqrt(2 * b) - F.sqrt(b + F.lead(b).over(w)), 2)
    return 2 * (F.exp(a) - 1) / (1 + F.exp(a))


def amihud(x: Column, volume: Column, w: WindowSpec) -> Column:
    return F.abs(pct_change(x, w)) / (x * volume + 1e-12)


def ffill(x: Column, w: WindowSpec) -> Column:
    return F.last(x, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))


def bfill(x: Column, w: WindowSpec) -> Column:
    return F.first(x, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))


def fill_mean(x: Column, w: WindowSpec) -> Column:
    """The value, or the mean of the partition of `w` where there is none."""
    return F.coalesce(x, F.avg(x).over(w))


def min_max(x: Column, w: WindowSpec) -> Column:
    """0 to 100 over the partition of `w`."""
    return (x - F.min(x).over(w)) / (F.max(x).over(w) - F.min(x).over(w) + 1e-9) * 100


def zscore_clip(x: Column, w: WindowSpec, clip: float = 3.0) -> Column:
    z = (x - F.avg(x).over(w)) / F.nullif(F.stddev_pop(x).over(w), F.lit(0.0))
    return F.when(x.isNotNull(), F.greatest(F.lit(-clip), F.least(F.lit(clip), F.coalesce(z, F.lit(0.0)))))


def drawdown(x: Column, w: WindowSpec) -> Column:
    top = F.max(x).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return (x - top) / F.nullif(top, F.lit(0.0))


def compound(r: Column, start: float, w: WindowSpec) -> Column:
    """A level that grows by the exponential of its returns."""
    return F.lit(start) * F.exp(F.sum(r).over(w.rowsBetween(Window.unboundedPreceding, 0)))
