import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quillon.functions import scalar, series
from quillon.operators import align, stats


@pytest.fixture(scope="module")
def daily(spark):
    r = np.random.default_rng(0)
    days = pd.bdate_range("2023-01-02", periods=180)
    rows = []
    for s in ("a", "b"):
        x = 100 * np.exp(np.cumsum(r.normal(0, 0.02, len(days))))
        y = r.integers(0, 5, len(days)).astype(float)
        y[r.random(len(days)) < 0.2] = np.nan
        rows += [(s, d.date(), float(p), None if math.isnan(q) else float(q)) for d, p, q in zip(days, x, y)]
    df = spark.createDataFrame(rows, "s string, d date, x double, y double")
    return df, df.toPandas().sort_values(["s", "d"]).reset_index(drop=True)


def column(df, c):
    return df.select("s", "d", c.alias("v")).toPandas().sort_values(["s", "d"])["v"].to_numpy(float)


def same(a, b):
    np.testing.assert_allclose(a, np.asarray(b, float), rtol=1e-9, atol=1e-9, equal_nan=True)


def test_rolling_features_as_pandas(daily):
    df, pdf = daily
    w, g = series.ordered(), pdf.groupby("s")
    ret = g["x"].transform(lambda x: np.log(x / x.shift(1)))
    same(column(df, series.log_return(F.col("x"), w)), ret)
    with_r = df.withColumn("r", series.log_return(F.col("x"), w))
    pdf = pdf.assign(r=ret)
    same(column(with_r, series.rolling_sumsq_vol(F.col("r"), w, 30)), pdf.groupby("s")["r"].transform(lambda x: np.sqrt((x * x).rolling(30).sum())))
    same(column(with_r, series.rolling_std(F.col("r"), w, 20, 2.0)), pdf.groupby("s")["r"].transform(lambda x: 2 * x.rolling(20).std()))
    same(column(df, series.asvi(F.col("x"), w, 4)), g["x"].transform(lambda x: (x - x.shift(1).rolling(4).mean()) / x.shift(1).rolling(4).std()))
    same(column(df, series.rolling_mean(F.col("x"), w, 5, 1)), g["x"].transform(lambda x: x.shift(1).rolling(5).mean()))
    same(column(df, series.ffill(F.col("y"), w)), g["y"].transform(lambda x: x.ffill()))
    same(column(df, series.bfill(F.col("y"), w)), g["y"].transform(lambda x: x.bfill()))
    same(column(df, series.drawdown(F.col("x"), w)), g["x"].transform(lambda x: x / x.cummax() - 1))


def test_rolling_corr_without_variance_is_null(spark):
    df = spark.createDataFrame([("a", i, 1.0, float(i)) for i in range(5)], "s string, d int, x double, y double")
    assert all(v is None for (v,) in df.select(series.rolling_corr(F.col("x"), F.col("y"), series.ordered(), 3)).collect())


def test_interpolate_as_pandas(daily):
    df, pdf = daily
    want = pdf.groupby("s")["y"].transform(lambda x: x.interpolate("linear"))
    same(align.interpolate_linear(df, "y").toPandas().sort_values(["s", "d"])["y"], want)


def test_resample_as_pandas(daily):
    df, pdf = daily
    got = align.resample_monday(df.withColumn("t", F.col("x")), last=["y"], total=["t"]).toPandas().sort_values(["s", "week"])
    part = pdf[pdf.s == "a"].set_index(pd.to_datetime(pdf[pdf.s == "a"]["d"]))
    want = part["x"].resample("W-MON").sum()
    same(got[got.s == "a"]["t"], want)
    same(got[got.s == "a"]["y"], part["y"].resample("W-MON").last())


def test_asof_and_calendar_fill_differ(spark):
    target = spark.createDataFrame([("a", d) for d in (1, 2, 4, 5)], "s string, d int")
    source = spark.createDataFrame([("a", 1, 10.0), ("a", 3, 30.0), ("a", 5, None)], "s string, d int, v double")
    assert [r.v for r in align.asof_backward(target, source, "v").orderBy("d").collect()] == [10.0, 10.0, 30.0, 30.0]
    assert [r.v for r in align.calendar_ffill(target, source, "v").orderBy("d").collect()] == [10.0, 10.0, 10.0, 10.0]


def test_clean_numbers(spark):
    rows = ['"1,234.5"', " 7 % ", "$3", "n/a", None, "", "-2e3"]
    df = spark.createDataFrame([(r,) for r in rows], "t string")
    assert [r[0] for r in df.select(scalar.to_number(F.col("t"))).collect()] == [1234.5, 0.07, 3.0, None, None, None, -2000.0]


def test_statistics_as_pandas(daily):
    df, pdf = daily
    got = df.groupBy("s").agg(stats.adjusted_skew(F.col("x")).alias("a"), stats.adjusted_kurtosis(F.col("x")).alias("b")).orderBy("s").toPandas()
    same(got["a"], pdf.groupby("s")["x"].skew())
    same(got["b"], pdf.groupby("s")["x"].apply(lambda x: x.kurt()))
    full = pdf.dropna()
    same(stats.spearman(df, "x", "y", ["s"]).orderBy("s").toPandas()["spearman"], [p["x"].rank().corr(p["y"].rank()) for _, p in full.groupby("s")])


def test_running_sums(spark):
    r = np.random.default_rng(1)
    v = r.integers(0, 500, 4000).astype(float)
    df = spark.createDataFrame([(float(x), 1) for x in v], "v double, one int").groupBy("v").agg(F.sum("one").alias("n")).repartition(5)
    got = stats.running_sums(df, "v", ["n"], 20).orderBy("v").toPandas()
    same(got["run_n"], got["n"].cumsum())


def test_empty_tables(spark):
    e = spark.createDataFrame([], "s string, d date, x double")
    assert align.interpolate_linear(e, "x").count() == 0
    assert stats.duplicate_rows(e).first().n_rows == 0
    assert stats.describe(e, ["x"]).count() in (0, 1)


def test_quantiles_are_those_of_one_buffer(spark, monkeypatch):
    r = np.random.default_rng(6)
    x = np.where(r.random(3000) < 0.3, 7.0, np.round(r.normal(0, 50, 3000), 1)) * 10.0 ** r.integers(0, 4, 3000)
    rows = [(float(v), float(i % 3), None if i % 5 else float("nan") if i < 40 else float(-i), float("inf") if i % 2 else 1.0, i, None) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double, e int, f double").repartition(4)
    levels = (0.0, 0.05, 0.25, 1 / 3, 0.5, 0.75, 0.999, 1.0)
    for n in (1, 2, 7, 3000):
        part = df.filter(F.col("e") < n)
        want = part.agg(*(F.percentile(F.col(c).cast("double"), F.array(*map(F.lit, levels))).alias(c) for c in "abcdef")).first().asDict()
        for margin in (stats.MARGIN, 0.0):  # also where the cuts miss the level
            monkeypatch.setattr(stats, "MARGIN", margin)
            got = {x.col: x.q for x in stats.quantiles(part, list("abcdef"), levels).collect()}
            assert {k: str(v) for k, v in got.items()} == {k: str(v) for k, v in want.items() if v is not None}
        monkeypatch.undo()


def test_no_task_of_a_description_holds_all_values(spark):
    df = spark.range(200_000).select((F.xxhash64("id") / 1e9).alias("x")).repartition(4)
    plan = stats.describe(df, ["x"])
    assert "percentile(" not in plan._jdf.queryExecution().toString()
    got, want = plan.first(), df.agg(F.percentile("x", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q")).first().q
    assert [got.p25, got.p50, got.p75] == want and got.n == 200_000
