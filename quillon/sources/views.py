"""The named views of the stored tables: what each model is fitted on, the true fund, and the regime variables by day and by week."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.functions import series
from quillon.operators import align
from quillon.sources import readers

# File, target and drivers of each model's view.
VIEWS = {
    "nav": ("nav_train.csv", "Log Return", ("Hash Rate (TH/s)", "Unique Addresses")),
    "gap": ("gap_train.csv", "etf_premium", ("value", "btc_volatility")),
    "kp": ("kp_train.csv", "Kimchi Premium", ("volume_btc", "KOSPI_Volatility", "bitcoin_kr")),
}
# The regime variables, as (name, view, column), and what a week takes of those that have a weekly form.
VARIABLES = (
    ("global_btc_svi", "gap", "value"),
    ("domestic_btc_svi", "kp", "bitcoin_kr"),
    ("btc_volume_btc", "kp", "volume_btc"),
    ("VKOSPI", "kp", "KOSPI_Volatility"),
    ("Global_RV", "gap", "btc_volatility"),
)
WEEKLY_LAST, WEEKLY_TOTAL = ("global_btc_svi", "domestic_btc_svi"), ("btc_volume_btc",)


def numbers(spark: SparkSession, path: str, columns: Sequence[str], date: str = "Date", units: Mapping[str, float] | None = None) -> DataFrame:
    """The date and the columns of a CSV as numbers, each times its unit (0.01 for percent); a column that is not there is an error, a row without a date goes."""
    rows = spark.read.option("header", True).csv(path)
    readers.require(rows, [date, *columns])
    cells = [(F.col(f"`{c}`").try_cast("double") * (units or {}).get(c, 1.0)).alias(c) for c in columns]
    return rows.select(F.to_date(date).alias(date), *cells).filter(F.col(date).isNotNull())


def model_views(spark: SparkSession, train: str, raw: str, units: Mapping[str, float] | None = None, views: Mapping[str, tuple[str, str, Sequence[str]]] = VIEWS) -> dict[str, DataFrame]:
    """Of each model the target of the raw table with its drivers, on common dates, incomplete rows dropped; `units` scales columns that are stored in other units."""
    out = {}
    for name, (file, target, drivers) in views.items():
        targets = numbers(spark, f"{raw}/y_variables.csv", [target], units=units)
        out[name] = readers.model_view(targets, numbers(spark, f"{train}/{file}", drivers, units=units), target, drivers)
    return out


def true_fund(spark: SparkSession, raw: str, units: Mapping[str, float] | None = None) -> DataFrame:
    """(Date, etf_true, nav_true) as stored, times their units."""
    return numbers(spark, f"{raw}/y_true_variables.csv", ["etf_true", "nav_true"], units=units)


def daily_and_weekly(spark: SparkSession, train: str) -> tuple[DataFrame, DataFrame]:
    """The five regime variables on days that have all of them, and by weeks that close on Monday: last interest, total volume."""
    rows = None
    for view in ("kp", "gap"):
        own = [(name, column) for name, of, column in VARIABLES if of == view]
        part = numbers(spark, f"{train}/{VIEWS[view][0]}", [column for _, column in own]).select(F.col("Date").alias("d"), *(F.col(column).alias(name) for name, column in own))
        rows = part if rows is None else rows.join(part, "d", "full_outer")
    daily = rows.select("d", *(name for name, _, _ in VARIABLES)).dropna()
    weekly = align.resample_monday(daily.withColumn("s", F.lit(0)), WEEKLY_LAST, WEEKLY_TOTAL).drop("s").withColumnRenamed("week", "d").dropna()
    return daily, weekly


def level_and_change(df: DataFrame, value: str, by: Sequence[str] = ("s",), order: str = "d") -> DataFrame:
    """(by, order, y, z): a series and its changes; z is null in the first row."""
    w = Window.partitionBy(*by).orderBy(order)
    return df.select(*by, order, F.col(value).alias("y"), series.diff(F.col(value), w).alias("z"))
