"""Readers: delimited exports with preambles, landed JSON responses of the usual shapes, HTML tables, views."""

from __future__ import annotations

from collections.abc import Sequence
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.functions import scalar
from quillon.operators import align


def require(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """`df`, or an error that names the columns it lacks."""
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"missing columns: {missing}; there are {df.columns}")
    return df


def optional(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Those of the columns that exist, in the given order."""
    return df.select(*[c for c in columns if c in df.columns])


def table_csv(spark: SparkSession, path: str, schema: str, date: str = "Date") -> DataFrame:
    """A CSV with a header row, read with a fixed schema; rows without a date go."""
    return spark.read.schema(schema).option("header", True).csv(path).filter(F.col(date).isNotNull())


def trend_export(spark: SparkSession, path: str) -> DataFrame:
    """(d, value, file) of search-trend exports of any preamble: rows whose first field is no date are not data."""
    rows = spark.read.schema("date string, value string").csv(path)
    rows = rows.select(F.col("date").try_cast("date").alias("d"), scalar.to_number(F.col("value")).alias("value"), F.input_file_name().alias("file"))
    return rows.filter("d is not null")


def trend_merged(spark: SparkSession, path: str, mean: bool = False) -> DataFrame:
    """Exports of one region as one series: of overlapping days the row of the first file by name stays, or with `mean` their mean."""
    rows = trend_export(spark, path)
    if mean:
        return rows.groupBy("d").agg(F.avg("value").alias("value"))
    return align.keep_first(rows, ["d"], [F.col("file"), F.col("value")]).select("d", "value")


def _json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    # A page is one JSON document, whatever its line breaks.
    return spark.read.text(path, wholetext=True).select(F.from_json("value", schema).alias("j"), F.input_file_name().alias("file"))


def chart_json(spark: SparkSession, path: str, label: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """(d, label) of {values: [{x: epoch seconds, y}]}; the last value of a day, between the dates."""
    rows = _json(spark, path, "values array<struct<x:bigint,y:double>>").select(F.explode("j.values").alias("v"))
    rows = rows.select(F.timestamp_seconds("v.x").alias("ts"), F.col("v.y").alias("y")).withColumn("d", F.to_date("ts"))
    rows = rows.groupBy("d").agg(F.max_by("y", "ts").alias(label))
    return rows.filter(F.col("d").between(F.lit(start or "0001-01-01").cast("date"), F.lit(end or "9999-12-31").cast("date")))


def price_pairs_json(spark: SparkSession, path: str, label: str) -> DataFrame:
    """(d, label) of {prices: [[epoch milliseconds, price]]}."""
    rows = _json(spark, path, "prices array<array<double>>").select(F.explode("j.prices").alias("p"))
    rows = rows.select(F.timestamp_millis(F.element_at("p", 1).cast("bigint")).alias("ts"), F.element_at("p", 2).alias("v"))
    return rows.groupBy(F.to_date("ts").alias("d")).agg(F.max_by("v", "ts").alias(label))


def klines_json(spark: SparkSession, path: str, position: int, label: str) -> DataFrame:
    """(d, label) of positional rows [[epoch milliseconds, ...]]: one field of each."""
    rows = _json(spark, path, "array<array<string>>").select(F.explode("j").alias("k"))
    return rows.select(F.to_date(F.timestamp_millis(F.element_at("k", 1).cast("bigint"))).alias("d"), F.element_at("k", position + 1).try_cast("double").alias(label))


def candle_pages_json(spark: SparkSession, path: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """(d, price, value) of pages of candles that overlap: one row a day."""
    schema = "array<struct<candle_date_time_utc:string,trade_price:double,candle_acc_trade_price:double>>"
    rows = _json(spark, path, schema).select(F.explode("j").alias("c"), "file")
    rows = rows.select(F.to_date("c.candle_date_time_utc").alias("d"), F.col("c.trade_price").alias("price"), F.col("c.candle_acc_trade_price").alias("value"), "file")
    rows = align.keep_first(rows, ["d"], [F.col("file"), F.col("price"), F.col("value")]).drop("file")
    return rows.filter(F.col("d").between(F.lit(start or "0001-01-01").cast("date"), F.lit(end or "9999-12-31").cast("date")))


def observations_json(spark: SparkSession, path: str, last: int | None = None) -> DataFrame:
    """(d, value) of {observations: [{date, value}]}; values that are no numbers go; the last rows if asked for."""
    rows = _json(spark, path, "observations array<struct<date:string,value:string>>").select(F.explode("j.observations").alias("o"))
    rows = rows.select(F.col("o.date").try_cast("date").alias("d"), scalar.to_number(F.col("o.value")).alias("value")).dropna()
    return rows.orderBy(F.desc("d")).limit(last) if last else rows


def nested_rows_json(spark: SparkSession, path: str, field: str, key: str, value: str, pattern: str = "yyyyMMdd") -> DataFrame:
    """(d, value) of {outer: {rows: [{key: date text, value: number text}]}}; `field` is 'outer.rows'."""
    outer, inner = field.split(".")
    rows = _json(spark, path, f"{outer} struct<{inner}:array<struct<{key}:string,{value}:string>>>").select(F.explode(f"j.{outer}.{inner}").alias("o"))
    return rows.select(F.try_to_timestamp(f"o.{key}", F.lit(pattern)).cast("date").alias("d"), scalar.to_number(F.col(f"o.{value}")).alias("value")).dropna()


class _Tables(HTMLParser):
    """All tables of a page as lists of rows of cell texts."""

    def __init__(self):
        super().__init__()
        self.tables: list[list[list[str]]] = []
        self.cell: list[str] | None = None

    def handle_starttag(self, tag, attrs):
        if tag == "table":
            self.tables.append([])
        elif tag == "tr" and self.tables:
            self.tables[-1].append([])
        elif tag in ("td", "th") and self.tables and self.tables[-1]:
            self.cell = []

    def handle_data(self, data):
        if self.cell is not None:
            self.cell.append(data)

    def handle_endtag(self, tag):
        if tag in ("td", "th") and self.cell is not None:
            self.tables[-1][-1].append("".join(self.cell).strip())
            self.cell = None


def html_table(spark: SparkSession, path: str, words: Sequence[str]) -> DataFrame:
    """(row, column, text) of the first table of each page whose header holds all the words; long, as headers differ."""

    def parse(batches):
        for pdf in batches:
            out = []
            for page in pdf["value"]:
                parser = _Tables()
                parser.feed(page)
                for table in parser.tables:
                    head = [h.lower() for h in table[0]] if table else []
                    if all(any(w in h for h in head) for w in words):
                        out += [(i, table[0][j], text) for i, row in enumerate(table[1:]) for j, text in enumerate(row[: len(head)])]
                        break
            yield pd.DataFrame(out, columns=["row", "column", "text"])

    return spark.read.text(path, wholetext=True).select("value").mapInPandas(parse, "row int, column string, text string")


def row_sum(columns: Sequence[str]) -> Column:
    """Sum over columns of text numbers; what is no number counts as zero."""
    return sum((F.coalesce(scalar.to_number(F.col(c)), F.lit(0.0)) for c in columns[1:]), F.coalesce(scalar.to_number(F.col(columns[0])), F.lit(0.0)))


def percent_aware(df: DataFrame, column: str) -> DataFrame:
    """A text column as numbers, all divided by 100 if any value of the column has a percent sign."""
    any_percent = df.agg(F.coalesce(F.bool_or(F.contains(F.col(column), F.lit("%"))), F.lit(False)).alias("_p"))
    plain = F.regexp_replace(F.regexp_replace(column, "%", ""), r'[,"\s]', "").try_cast("double")
    return df.crossJoin(F.broadcast(any_percent)).withColumn(column, F.when(F.col("_p"), plain / 100).otherwise(plain)).drop("_p")  # one row


def model_view(targets: DataFrame, drivers: DataFrame, target: str, columns: Sequence[str], date: str = "Date") -> DataFrame:
    """The target with its drivers on common dates, incomplete rows dropped."""
    require(targets, [date, target])
    require(drivers, [date, *columns])
    return targets.select(date, target).join(drivers.select(date, *columns), date).dropna()


def validation_view(truth: DataFrame, variables: DataFrame, percent: bool, date: str = "Date") -> DataFrame:
    """Log changes of the true NAV and changes of the premium on common dates; the premium in percent if asked."""
    j = truth.join(variables, date)
    w = Window.partitionBy(F.lit(0)).orderBy(date)  # one daily series
    gap = F.col("etf_premium") / 100 if percent else F.col("etf_premium")
    return j.select(date, "nav_true", "etf_true", gap.alias("gap")).withColumns({"r": F.ln(F.col("nav_true") / F.lag("nav_true").over(w)), "dgap": F.col("gap") - F.lag("gap").over(w)})


def positional_csv(spark: SparkSession, path: str, columns: Sequence[str], date: str, value: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """(d, value) of an export whose header is localised: columns are named by position, blanks in dates go, rows without both go."""
    rows = spark.read.schema(", ".join(f"`{c}` string" for c in columns)).option("header", True).option("enforceSchema", True).csv(path)
    rows = rows.select(F.regexp_replace(date, r"\s", "").try_cast("date").alias("d"), scalar.to_number(F.col(value)).alias(value)).dropna()
    return rows.filter(F.col("d").between(F.lit(start or "0001-01-01").cast("date"), F.lit(end or "9999-12-31").cast("date")))


def csv_folder(spark: SparkSession, folder: str, pattern: str = "*.csv") -> dict[str, DataFrame]:
    """Every file of a folder as a table of its own schema, by file name; the file list is what the driver holds."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    place = hadoop.Path(f"{folder}/{pattern}")
    found = place.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(place)
    return {f.getPath().getName(): spark.read.option("header", True).option("inferSchema", True).csv(f.getPath().toString()) for f in sorted(found or [], key=lambda f: f.getPath().getName())}


def base_results(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The stored results of a base run: validation (a JSON document) and, where they are there, gap and kp (CSV); nothing without the document."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    there = lambda name: (p := hadoop.Path(f"{folder}/{name}")).getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)
    if not there("validation_results.json"):
        return {}
    out = {"validation": spark.read.option("multiLine", True).json(f"{folder}/validation_results.json")}
    for key, name in (("gap", "gap_simulation_results.csv"), ("kp", "kp_simulation_results.csv")):
        if there(name):
            out[key] = spark.read.option("header", True).option("inferSchema", True).csv(f"{folder}/{name}")
    return out


def raw_view(tables: Sequence[tuple[DataFrame, str]], start: str | None = None, end: str | None = None) -> DataFrame:
    """All dates of all tables (d, value column) between two days, with what each has; no row is dropped for a gap."""
    rows = align.outer_merge(tables, ["d"])
    return rows.filter(F.col("d").between(F.lit(start or "0001-01-01").cast("date"), F.lit(end or "9999-12-31").cast("date")))
