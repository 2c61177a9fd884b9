import json
import os

import pytest
from pyspark.sql import functions as F

from quillon.settings import Settings
from quillon.sources import readers, views, writers
from quillon.streaming import features


def test_trend_exports_with_preamble(spark, tmp_path):
    (tmp_path / "a_1.csv").write_text("Category: all\n\nDay,word: (KR)\n2024-01-01,10\n2024-01-02,20\n", encoding="utf-8")
    (tmp_path / "a_2.csv").write_text("﻿Day,word\n2024-01-02,99\n2024-01-03,30\n", encoding="utf-8")
    got = readers.trend_merged(spark, str(tmp_path / "a_*.csv")).orderBy("d").collect()
    assert [r.value for r in got] == [10, 20, 30]
    assert [r.value for r in readers.trend_merged(spark, str(tmp_path / "a_*.csv"), mean=True).orderBy("d").collect()] == [10, 59.5, 30]


def test_json_shapes(spark, tmp_path):
    def put(name, doc):
        (tmp_path / name).write_text(json.dumps(doc, indent=1))
        return str(tmp_path / name)

    chart = put("chart.json", {"values": [{"x": 1704067200, "y": 1.0}, {"x": 1704070800, "y": 2.0}, {"x": 1704153600, "y": 3.0}]})
    assert [tuple(r)[1] for r in readers.chart_json(spark, chart, "n", "2024-01-01", "2024-01-01").collect()] == [2.0]
    pairs = put("pairs.json", {"prices": [[1704067200000, 5.5], [1704153600000, 6.5]]})
    assert sorted(r.p for r in readers.price_pairs_json(spark, pairs, "p").collect()) == [5.5, 6.5]
    lines = put("k.json", [[1704067200000, "1", "2", "3"]])
    assert readers.klines_json(spark, lines, 2, "v").first().v == 2.0
    obs = put("o.json", {"observations": [{"date": "2024-01-01", "value": "."}, {"date": "2024-01-02", "value": "4.5"}, {"date": "2024-01-03", "value": "4.6"}]})
    assert [r.value for r in readers.observations_json(spark, obs, last=1).collect()] == [4.6]
    rate = put("r.json", {"StatisticSearch": {"row": [{"TIME": "20240101", "DATA_VALUE": "3.5"}, {"TIME": "bad", "DATA_VALUE": "1"}]}})
    assert [r.value for r in readers.nested_rows_json(spark, rate, "StatisticSearch.row", "TIME", "DATA_VALUE").collect()] == [3.5]
    pages = put("p1.json", [{"candle_date_time_utc": "2024-01-02T00:00:00", "trade_price": 2.0, "candle_acc_trade_price": 20.0}, {"candle_date_time_utc": "2024-01-01T00:00:00", "trade_price": 1.0, "candle_acc_trade_price": 10.0}])
    put("p2.json", [{"candle_date_time_utc": "2024-01-01T00:00:00", "trade_price": 1.0, "candle_acc_trade_price": 10.0}])
    assert readers.candle_pages_json(spark, pages.replace("p1", "p*")).count() == 2


def test_html_table(spark, tmp_path):
    (tmp_path / "f.html").write_text("<table><tr><th>x</th></tr></table><table><tr><th>Date</th><th>NAV ($)</th></tr><tr><td>2024-01-01</td><td>$1,234.5</td></tr></table>")
    got = {(r.row, r.column): r.text for r in readers.html_table(spark, str(tmp_path / "f.html"), ["nav", "date"]).collect()}
    assert got == {(0, "Date"): "2024-01-01", (0, "NAV ($)"): "$1,234.5"}


def test_percent_flag_is_of_the_column(spark):
    df = spark.createDataFrame([("5 %",), ("10",), ("x",)], "a string")
    assert [r.a for r in readers.percent_aware(df, "a").collect()] == [0.05, 0.1, None]
    with pytest.raises(ValueError, match="missing"):
        readers.require(df, ["b"])


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([("S01", 1, 2.0), ("S02", 2, 3.0)], "scenario_id string, t int, v double")
    writers.scenario_paths(df, str(tmp_path / "s"))
    assert spark.read.parquet(str(tmp_path / "s")).filter("scenario_id = 'S02'").count() == 1
    writers.json_documents(df, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 2
    made = []
    key = writers.cache_key({"seed": 1})
    for _ in range(2):
        writers.cached(spark, str(tmp_path / "c"), key, lambda: made.append(1) or df)
    assert made == [1] and key != writers.cache_key({"seed": 2})


def test_streaming_features(spark, tmp_path):
    rows = [(i, f"2024-01-01 00:{i:02d}:00", float(v)) for i, v in enumerate([1, 2, 3, 4, 10, 2])]
    df = spark.createDataFrame(rows, "event_id int, ts string, value double").select("event_id", F.to_timestamp("ts").alias("ts"), F.lit(1).cast("bigint").alias("user_id"), "value")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = features.abnormal_interest(stream).writeStream.format("memory").queryName("asvi").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    got = {r.value: r.asvi for r in spark.sql("select * from asvi").collect() if r.asvi is not None}
    assert got[10.0] == pytest.approx((10 - 2.5) / 1.2909944487358056)
    assert features.windowed_volatility(df).first().n == 6


def test_folders_and_localised_headers(spark, tmp_path):
    (tmp_path / "b.csv").write_text("날짜,종가,시가\n2024- 01- 02,\"1,5.5\",1\n2024- 01- 03,x,1\n2025- 01- 01,7,1\n", encoding="utf-8")
    (tmp_path / "a.csv").write_text("k,v\n1,2.5\n")
    got = readers.positional_csv(spark, str(tmp_path / "b.csv"), ["Date", "close", "open"], "Date", "close", end="2024-12-31").collect()
    assert [(str(q.d), q.close) for q in got] == [("2024-01-02", 15.5)]
    tables = readers.csv_folder(spark, str(tmp_path))
    assert list(tables) == ["a.csv", "b.csv"] and dict(tables["a.csv"].dtypes) == {"k": "int", "v": "double"}
    assert readers.csv_folder(spark, str(tmp_path), "*.none") == {}
    assert readers.base_results(spark, str(tmp_path)) == {}
    (tmp_path / "validation_results.json").write_text(json.dumps({"gap": {"kappa": 0.5}}, indent=1))
    (tmp_path / "kp_simulation_results.csv").write_text("t,v\n0,1.0\n")
    found = readers.base_results(spark, str(tmp_path))
    assert set(found) == {"validation", "kp"} and found["validation"].first().gap.kappa == 0.5
    writers.workbook(tables, str(tmp_path / "book"))
    assert spark.read.parquet(str(tmp_path / "book" / "a.csv")).count() == 1
    one = spark.createDataFrame([("2024-01-01", 1.0)], "d string, a double").withColumn("d", F.to_date("d"))
    two = spark.createDataFrame([("2024-01-02", 2.0)], "d string, b double").withColumn("d", F.to_date("d"))
    assert readers.raw_view([(one, "a"), (two, "b")]).count() == 2
    made = Settings(result_folder=str(tmp_path / "r")).ensure_directories(spark)
    assert all(os.path.isdir(p) for p in made)


def test_named_views(spark, tmp_path):
    days = [f"2024-01-{d:02d}" for d in range(1, 16)]

    def put(name, columns):
        lines = [",".join(["Date", *columns]), *(",".join([d, *(str(f(i)) for f in columns.values())]) for i, d in enumerate(days))]
        (tmp_path / name).write_text("\n".join(lines) + "\n", encoding="utf-8")

    put("nav_train.csv", {"Hash Rate (TH/s)": lambda i: i, "Unique Addresses": lambda i: "" if i == 3 else 2 * i})
    put("gap_train.csv", {"value": lambda i: i, "btc_volatility": lambda i: 0.1})
    put("kp_train.csv", {"volume_btc": lambda i: 10, "KOSPI_Volatility": lambda i: "" if i == 0 else 1, "bitcoin_kr": lambda i: 5 * i})
    put("y_variables.csv", {"Log Return": lambda i: 0.01, "etf_premium": lambda i: i, "Kimchi Premium": lambda i: 0.5})
    put("y_true_variables.csv", {"etf_true": lambda i: 100 + i, "nav_true": lambda i: 99})
    found = views.model_views(spark, str(tmp_path), str(tmp_path), {"etf_premium": 0.01})
    assert found["nav"].count() == 14 and found["nav"].columns == ["Date", "Log Return", "Hash Rate (TH/s)", "Unique Addresses"]
    assert found["gap"].orderBy("Date").collect()[14].etf_premium == pytest.approx(0.14) and found["kp"].count() == 14
    assert views.true_fund(spark, str(tmp_path)).agg(F.max("etf_true")).first()[0] == 114
    daily, weekly = views.daily_and_weekly(spark, str(tmp_path))
    assert daily.count() == 14 and [(str(w.d), w.global_btc_svi, w.btc_volume_btc) for w in weekly.orderBy("d").collect()] == [("2024-01-08", 7.0, 70.0), ("2024-01-15", 14.0, 70.0)]
    with pytest.raises(ValueError):
        views.numbers(spark, str(tmp_path / "nav_train.csv"), ["nothing"])
