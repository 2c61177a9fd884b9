"""Scalar cleaning and grading expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def to_number(text: Column) -> Column:
    """A number from text with thousands commas, quotes, blanks, dollar signs and a percent sign; else null."""
    plain = F.regexp_replace(text, r'[,"$\s%]', "")
    value = plain.try_cast("double")
    return F.when(F.contains(text, F.lit("%")), value / 100).otherwise(value)


def strict_number(text: Column) -> Column:
    """As `to_number` for commas only; malformed text is an error."""
    return F.regexp_replace(text, ",", "").cast("double")


def is_weekday(d: Column) -> Column:
    return F.weekday(d) < 5


def monday_label(d: Column) -> Column:
    """The Monday that closes the week of `d`: weeks run from Tuesday to Monday."""
    return F.when(F.weekday(d) == 0, d).otherwise(F.next_day(d, "MON"))


def graded(x: Column, steps: Sequence[tuple[float, str]], otherwise: str) -> Column:
    """The label of the first step that `x` reaches; steps from the largest."""
    case = F
    for least, label in steps:
        case = case.when(x >= least, label)
    return F.when(x.isNotNull(), case.otherwise(otherwise))


def threshold_regime(x: Column, tau: Column | float) -> Column:
    """0 inside the band of +/- tau, 1 above it, 2 below it."""
    tau = tau if isinstance(tau, Column) else F.lit(tau)
    return F.when(F.abs(x) <= tau, 0).when(x > tau, 1).when(x < -tau, 2)


def checked_log(x: Column, kind: str = "log") -> Column:
    """log (x > 0) or log1p (x >= 0); other values are an error."""
    if kind == "log":
        return F.when(x.isNull() | (x > 0), F.ln(x)).otherwise(F.raise_error(F.lit("log needs positive values")).cast("double"))
    return F.when(x.isNull() | (x >= 0), F.log1p(x)).otherwise(F.raise_error(F.lit("log1p needs non-negative values")).cast("double"))


def kimchi_premium(local: Column, world: Column, fx: Column) -> Column:
    return local / (world * fx) - 1


def premium_pct(price: Column, nav: Column) -> Column:
    return (price - nav) / (nav + 1e-12) * 100


def not_both_zero(x: Column, y: Column) -> Column:
    """Both values are there, and at least one is not zero."""
    return x.isNotNull() & y.isNotNull() & ((x != 0) | (y != 0))


def turnover(volume: Column, shares: Column) -> Column:
    """Volume per share outstanding; null without shares."""
    return volume / F.nullif(shares.cast("double"), F.lit(0.0))
