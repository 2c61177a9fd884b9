import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quillon.operators import scenario, stats, wmcr
from quillon.sources import collect, writers


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_many_scenarios_meet_days_without_a_nested_loop(spark, monkeypatch):
    r = random.Random(1)
    state = lambda: r.choice([0, 1, 2, None])
    days = spark.createDataFrame([(i, state(), state(), state()) for i in range(300)], "d int, a int, b int, c int")
    scenarios = spark.createDataFrame([(f"S{i}", state(), state(), state()) for i in range(400)], "scenario_id string, a int, b int, c int")
    few = scenario.scenario_days(days, scenarios, ["a", "b", "c"])
    monkeypatch.setattr(scenario, "BROADCAST_SCENARIOS", 100)
    many = scenario.scenario_days(days, scenarios, ["a", "b", "c"])
    assert "NestedLoop" not in _plan(many) and "Cartesian" not in _plan(many)
    assert many.columns == few.columns and sorted(map(str, many.collect())) == sorted(map(str, few.collect())) and many.count() > 1000


def test_twenty_thousand_scenarios(spark):
    rows = spark.range(20_000).select(F.concat(F.lit("S"), "id").alias("scenario_id"), (F.col("id") % 150).cast("int").alias("a"), F.when(F.col("id") % 2 == 0, (F.col("id") % 140).cast("int")).alias("b"))
    days = spark.range(50).select(F.col("id").cast("int").alias("a"), F.col("id").cast("int").alias("b"))
    out = scenario.scenario_days(days, rows, ["a", "b"])
    assert "NestedLoop" not in _plan(out) and "Cartesian" not in _plan(out)
    want = sum(1 for i in range(20_000) if i % 150 < 50 and (i % 2 or i % 140 == i % 150))
    assert out.count() == want


def test_many_shifts(spark, monkeypatch):
    y = spark.createDataFrame([(t, float(t * t)) for t in range(12)], "t int, y double")
    shifts = spark.createDataFrame([(b, 5 * b - 7) for b in range(30)], "b int, shift int")
    few = wmcr.circular_shifts(y, shifts, 12)
    monkeypatch.setattr(wmcr, "BROADCAST_SHIFTS", 10)
    many = wmcr.circular_shifts(y, shifts, 12)
    assert "NestedLoop" not in _plan(many) and "Cartesian" not in _plan(many)
    assert few.exceptAll(many).isEmpty() and many.exceptAll(few).isEmpty()


def test_rolling_correlation_of_series_of_several_lengths(spark):
    r = np.random.default_rng(3)
    rows, want = [], {}
    for s, n in (("a", 200), ("b", 45), ("c", 5), ("d", 2)):
        x, y = 1e6 + r.normal(size=n).cumsum(), r.normal(size=n)
        y[n // 2 : n // 2 + 16] = 3.0
        k = min(30, n // 3)
        corr = pd.Series(x).rolling(k).corr(pd.Series(y)) if k else pd.Series([np.nan] * n)
        flat = pd.Series(y).rolling(k).std(ddof=0) < 1e-9 if k else pd.Series([True] * n)
        want |= {(s, i): None if np.isnan(c) or flat[i] else c for i, c in enumerate(corr)}
        rows += [(s, i, float(a), float(b)) for i, (a, b) in enumerate(zip(x, y))]
    rows.append(("a", 999, None, 1.0))
    got = {(q.s, q.d): q["corr"] for q in stats.rolling_pearson(spark.createDataFrame(rows, "s string, d int, x double, y double"), "x", "y", ["s"], ["d"]).collect()}
    assert set(got) == set(want)
    for key, c in want.items():
        assert (got[key] is None) == (c is None) and (c is None or got[key] == pytest.approx(c, abs=1e-6)), key


def _wanted(spark, n: int):
    return spark.createDataFrame([(i, f"2024-{i:02d}-01", f"2024-{i:02d}-28") for i in range(1, n + 1)], "chunk int, first string, last string")


def test_collection_goes_on_where_it_was_stopped(spark, tmp_path):
    folder, asked = str(tmp_path / "interest"), []

    def fetch(session, chunk, stop=None):
        if chunk["chunk"] == stop:
            raise KeyboardInterrupt
        asked.append(chunk["chunk"])
        days = [(f"{chunk['first'][:8]}{d:02d}", float(chunk["chunk"])) for d in (1, 2)] + [("2024-01-01", -1.0 * chunk["chunk"])]  # a day that every chunk has
        return session.createDataFrame(days if chunk["chunk"] != 4 else [], "date string, value double")

    wanted = _wanted(spark, 5)
    with pytest.raises(KeyboardInterrupt):
        collect.collect(wanted, lambda s, c: fetch(s, c, 3), folder)
    assert asked == [1, 2] and not collect.is_complete(wanted, folder)
    assert collect.merged(spark, folder).count() == 4
    asked.clear()
    there = collect.collect(wanted, fetch, folder)
    assert asked == [3, 4, 5] and sorted(r.chunk for r in there.collect()) == [1, 2, 3, 5]  # an empty answer is asked for again
    asked.clear()
    collect.collect(wanted, lambda s, c: fetch(s, c).union(s.createDataFrame([("2024-04-09", 4.0)], "date string, value double")), folder)
    assert asked == [4] and collect.is_complete(wanted, folder)
    rows = {r.date: r.value for r in collect.merged(spark, folder).collect()}
    assert rows["2024-01-01"] == -1.0 and len(rows) == 2 + 2 + 2 + 1 + 2  # of a date the first chunk counts
    assert not collect.is_complete(_wanted(spark, 6), folder)
    collect.clean_up(spark, folder)
    assert collect.manifest(spark, folder).count() == 0


def test_a_chunk_that_was_written_without_its_line_is_fetched_again(spark, tmp_path):
    folder = str(tmp_path / "x")
    spark.createDataFrame([("2024-01-01", 9.0)], "date string, value double").write.parquet(f"{folder}/chunks/chunk=1")
    collect.collect(_wanted(spark, 1), lambda s, c: s.createDataFrame([("2024-01-02", 1.0)], "date string, value double"), folder)
    assert [r.date for r in collect.merged(spark, folder).collect()] == ["2024-01-02"]


def test_terms_are_stored_once_they_are_complete(spark, tmp_path):
    folder, calls = str(tmp_path / "terms"), []

    def fetch(session, name, chunk):
        calls.append((name, chunk["chunk"]))
        return None if name == "late" and chunk["chunk"] == 2 else session.createDataFrame([(chunk["first"], 1.0)], "date string, value double")

    stored = collect.collect_terms(spark, [("coin", ""), ("late", "KR")], _wanted(spark, 2), fetch, folder)
    assert stored == [f"{folder}/coin_"] and spark.read.option("header", True).csv(stored[0]).count() == 2
    assert collect.manifest(spark, f"{folder}/cache/coin_").count() == 0 and collect.manifest(spark, f"{folder}/cache/late_KR").count() == 1
    calls.clear()
    collect.collect_terms(spark, [("late", "KR")], _wanted(spark, 2), fetch, folder)
    assert calls == [("late", 2)]


def test_scenario_files(spark, tmp_path):
    df = spark.range(1000).select(F.concat(F.lit("S"), F.col("id") % 2).alias("scenario_id"), F.col("id").alias("sim_id"), F.lit(1.0).alias("v"))
    writers.scenario_paths(df, str(tmp_path / "p"))
    assert spark.read.parquet(str(tmp_path / "p")).filter("scenario_id = 'S1'").count() == 500
