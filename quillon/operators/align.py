"""Joins and alignment on dates: as-of, calendars, N-way outer merges, gaps, resampling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions import scalar, series


def asof_backward(target: DataFrame, source: DataFrame, value: str, by: Sequence[str] = ("s",), order: str = "d") -> DataFrame:
    """For each target row the last non-null source value at or before it.

    One union and one window instead of an inequality join: both sides are hashed by the key once.
    """
    keys = [*by, order]
    t = target.select(*keys, F.lit(1).alias("_side"), F.lit(None).cast(source.schema[value].dataType).alias(value))
    s = source.select(*keys, F.lit(0).alias("_side"), value)
    w = Window.partitionBy(*by).orderBy(order, "_side")
    return t.unionByName(s).withColumn(value, series.ffill(F.col(value), w)).filter("_side = 1").drop("_side")


def calendar_ffill(calendar: DataFrame, source: DataFrame, value: str, by: Sequence[str] = ("s",), order: str = "d") -> DataFrame:
    """Source values on the calendar's dates only, then filled forward: dates outside it are dropped first."""
    joined = calendar.select(*by, order).join(source.select(*by, order, value), [*by, order], "left")
    return joined.withColumn(value, series.ffill(F.col(value), series.ordered(tuple(by), (order,))))


def outer_merge(tables: Sequence[tuple[DataFrame, str]], keys: Sequence[str]) -> DataFrame:
    """N-way full outer merge of (table, value column) by one union and one aggregation: one shuffle for any N.

    Keys must be unique in each table.
    """
    names = [v for _, v in tables]
    rows = None
    for df, v in tables:
        part = df.select(*keys, *(F.col(v) if n == v else F.lit(None).cast(df.schema[v].dataType).alias(n) for n in names))
        rows = part if rows is None else rows.unionByName(part)
    return rows.groupBy(*keys).agg(*(F.max(n).alias(n) for n in names))


def interpolate_linear(df: DataFrame, value: str, by: Sequence[str] = ("s",), order: Sequence[str] = ("d",)) -> DataFrame:
    """Linear in the row number between neighbours; leading nulls stay, trailing ones take the last value."""
    w = Window.partitionBy(*by).orderBy(*order)
    df = df.withColumn("_n", F.row_number().over(w))
    at = F.when(F.col(value).isNotNull(), F.struct(F.col("_n").alias("n"), F.col(value).alias("v")))
    df = df.withColumns({"_a": series.ffill(at, w), "_b": series.bfill(at, w)})
    a, b = F.col("_a"), F.col("_b")
    between = a["v"] + (b["v"] - a["v"]) * (F.col("_n") - a["n"]) / F.nullif(b["n"] - a["n"], F.lit(0))
    filled = F.when(F.col(value).isNotNull(), F.col(value)).when(b.isNull(), a["v"]).when(a.isNotNull(), between)
    return df.withColumn(value, filled).drop("_n", "_a", "_b")


def resample_monday(df: DataFrame, last: Sequence[str] = (), total: Sequence[str] = (), by: Sequence[str] = ("s",), order: str = "d") -> DataFrame:
    """Weeks that close on Monday: last non-null value or sum of each column."""
    week = scalar.monday_label(F.col(order)).alias("week")
    aggs = [F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in last]
    return df.groupBy(*by, week).agg(*aggs, *(F.coalesce(F.sum(c), F.lit(0.0)).alias(c) for c in total))


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key; the order must be total."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def pad_to_length(df: DataFrame, length: int, by: Sequence[str] = ("sim_id",), t: str = "t", value: str = "v") -> DataFrame:
    """Each path cut, or continued with its last value, to `length` steps from 0."""
    ends = df.filter(F.col(t) < length).groupBy(*by).agg(F.max(t).alias("_end"))
    grid = ends.withColumn(t, F.explode(F.sequence(F.lit(0), F.lit(length - 1))))
    at = grid.withColumn("_at", F.least(F.col(t), F.col("_end")))
    return at.join(df.select(*by, F.col(t).alias("_at"), value), [*by, "_at"], "left").select(*by, t, value)


def split_by_position(df: DataFrame, ratio: float, by: Sequence[str] = ("s",), order: Sequence[str] = ("d",)) -> DataFrame:
    """Adds is_train: the first int(n * ratio) rows of each series."""
    w = Window.partitionBy(*by)
    n = F.count("*").over(w)
    return df.withColumn("is_train", F.row_number().over(w.orderBy(*order)) <= F.floor(n * ratio))


def split_levels(df: DataFrame, ratio: float, by: Sequence[str] = ("s",), order: Sequence[str] = ("d",)) -> DataFrame:
    """Adds train and valid to levels of which n - 1 changes are split at int((n - 1) * ratio): the level between both parts is in both."""
    w = Window.partitionBy(*by)
    cut = F.floor((F.count("*").over(w) - 1) * ratio)
    i = F.row_number().over(w.orderBy(*order)) - 1
    return df.withColumns({"train": i <= cut, "valid": i >= cut})


def date_chunks(start: Column, end: Column, months: int) -> Column:
    """Array of (from, to): a date range in pieces of `months` months, the last one cut at the end."""
    starts = F.sequence(start, end, F.make_interval(F.lit(0), F.lit(months)))
    return F.transform(starts, lambda s: F.struct(s.cast("date").alias("from"), F.least(F.date_add(F.add_months(s, months), -1), end).alias("to")))
