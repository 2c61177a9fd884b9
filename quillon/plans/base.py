"""The base views of the queries, as DataFrames and as SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return register


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def r(x: Column | str, digits: int = 6) -> Column:
    return F.round(x, digits)


#: Daily value and count of orders; one series per order priority.
DAILY = "daily AS (SELECT o_orderpriority AS s, CAST(o_orderdate AS DATE) AS d, CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS x, CAST(COUNT(*) AS DOUBLE) AS y FROM orders GROUP BY 1, 2)"


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("s"), F.to_date("o_orderdate").alias("d"), F.col("o_totalprice").cast("decimal(18,2)").alias("p"))
    return rows.groupBy("s", "d").agg(F.sum("p").cast("double").alias("x"), F.count("*").cast("double").alias("y"))


#: Log returns of the daily value.
RETURNS = DAILY + ", ret AS (SELECT *, ln(x / lag(x) OVER (PARTITION BY s ORDER BY d)) AS r FROM daily)"

#: High, low, close and volume of orders by day.
BARS = "bars AS (SELECT o_orderpriority AS s, CAST(o_orderdate AS DATE) AS d, MAX(o_totalprice) AS hi, MIN(o_totalprice) AS lo, MAX_BY(o_totalprice, o_orderkey) AS c, CAST(COUNT(*) AS DOUBLE) AS vol FROM orders GROUP BY 1, 2)"


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("s"), F.to_date("o_orderdate").alias("d"), "o_totalprice", "o_orderkey")
    return rows.groupBy("s", "d").agg(F.max("o_totalprice").alias("hi"), F.min("o_totalprice").alias("lo"), F.max_by("o_totalprice", "o_orderkey").alias("c"), F.count("*").cast("double").alias("vol"))


#: Paths: user as simulation, day as step, mean value; simulation 0 is the actual series.
PATHS = (
    "cells AS (SELECT user_id AS sim_id, CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS INTEGER) AS t, CAST(SUM(CAST(value AS DECIMAL(18,4))) AS DOUBLE) / COUNT(*) AS v FROM events WHERE value IS NOT NULL GROUP BY 1, 2), "
    "paths AS (SELECT * FROM cells WHERE sim_id <> 0), actual AS (SELECT t, v AS a FROM cells WHERE sim_id = 0)"
)


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "events").filter("value is not null").select(F.col("user_id").alias("sim_id"), F.date_diff(F.to_date("ts"), F.lit("2024-01-01").cast("date")).alias("t"), F.col("value").cast("decimal(18,4)").alias("p"))
    return rows.groupBy("sim_id", "t").agg((F.sum("p").cast("double") / F.count("*")).alias("v"))


def paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cells(spark, sf_dir).filter("sim_id <> 0")


def actual(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cells(spark, sf_dir).filter("sim_id = 0").select("t", F.col("v").alias("a"))
