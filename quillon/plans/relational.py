"""Queries of the cleaning, alignment, feature and statistics operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions import scalar, series
from quillon.operators import align, stats
from quillon.plans.base import BARS, DAILY, RETURNS, bars, daily, query, r, read

W = series.ordered  # called where a query is built, as a window needs a session
_OVER = "PARTITION BY s ORDER BY d"


def _returns(spark, sf_dir) -> DataFrame:
    return daily(spark, sf_dir).withColumn("r", series.log_return(F.col("x"), W()))


def _wfn(expr: str, n: int, until: int = 0) -> str:
    return f"{expr} OVER ({_OVER} ROWS BETWEEN {n - 1 + until} PRECEDING AND {f'{until} PRECEDING' if until else 'CURRENT ROW'})"


def _full(value: str, counted: str, n: int, until: int = 0) -> str:
    return f"CASE WHEN {_wfn(f'count({counted})', n, until)} = {n} THEN {value} END"


@query("daily_series", f"WITH {DAILY} SELECT s, d, round(x, 2) AS x, y FROM daily")
def daily_series(spark, sf_dir):
    return daily(spark, sf_dir).select("s", "d", r("x", 2).alias("x"), "y")


@query("last_per_day", "SELECT user_id, CAST(ts AS DATE) AS d, max_by(value, (ts, event_id)) AS v FROM events GROUP BY 1, 2")
def last_per_day(spark, sf_dir):
    rows = read(spark, sf_dir, "events").select("user_id", F.to_date("ts").alias("d"), "value", F.struct("ts", "event_id").alias("o"))
    return rows.groupBy("user_id", "d").agg(F.max_by("value", "o").alias("v"))


@query("dedupe_keep_first", "SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS n FROM events) WHERE n = 1")
def dedupe_keep_first(spark, sf_dir):
    return align.keep_first(read(spark, sf_dir, "events"), ["user_id", "event_type"], [F.col("ts"), F.col("event_id")]).select("user_id", "event_type", "event_id", "value")


@query("union_mean_by_date", "SELECT d, CAST(sum(CAST(v AS DECIMAL(18,2))) AS DOUBLE) / count(*) AS v FROM (SELECT CAST(o_orderdate AS DATE) AS d, o_totalprice AS v FROM orders UNION ALL SELECT CAST(l_shipdate AS DATE), l_extendedprice FROM lineitem) GROUP BY 1")
def union_mean_by_date(spark, sf_dir):
    a = read(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("d"), F.col("o_totalprice").alias("v"))
    b = read(spark, sf_dir, "lineitem").select(F.to_date("l_shipdate").alias("d"), F.col("l_extendedprice").alias("v"))
    return a.unionByName(b).groupBy("d").agg((F.sum(F.col("v").cast("decimal(18,2)")).cast("double") / F.count("*")).alias("v"))


@query("weekday_filter", f"WITH {DAILY} SELECT s, d, y FROM daily WHERE isodow(d) <= 5")
def weekday_filter(spark, sf_dir):
    return daily(spark, sf_dir).filter(scalar.is_weekday(F.col("d"))).select("s", "d", "y")


@query("calendar_semi", f"WITH {DAILY} SELECT s, d, y FROM daily WHERE d IN (SELECT CAST(l_shipdate AS DATE) FROM lineitem WHERE l_returnflag = 'R')")
def calendar_semi(spark, sf_dir):
    days = read(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").select(F.to_date("l_shipdate").alias("d")).distinct()
    return daily(spark, sf_dir).join(days, "d", "left_semi").select("s", "d", "y")


@query("calendar_anti", f"WITH {DAILY} SELECT s, d, y FROM daily WHERE d NOT IN (SELECT CAST(l_shipdate AS DATE) FROM lineitem WHERE l_returnflag = 'R' AND l_shipdate IS NOT NULL)")
def calendar_anti(spark, sf_dir):
    days = read(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").select(F.to_date("l_shipdate").alias("d")).distinct()
    return daily(spark, sf_dir).join(days, "d", "left_anti").select("s", "d", "y")


@query(
    "string_clean_numeric",
    "SELECT o_orderkey, round(o_totalprice, 2) AS v, round(CAST(o_orderkey % 97 AS DOUBLE) / 100, 6) AS share, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE CAST(o_orderkey AS DOUBLE) END AS k FROM orders",
)
def string_clean_numeric(spark, sf_dir):
    rows = read(spark, sf_dir, "orders")
    price = F.concat(F.lit('"$'), F.format_number("o_totalprice", 2), F.lit('" '))
    share = F.concat((F.col("o_orderkey") % 97).cast("string"), F.lit(" %"))
    key = F.when(F.col("o_orderkey") % 3 == 0, "n/a").otherwise(F.col("o_orderkey").cast("string"))
    return rows.select("o_orderkey", r(scalar.to_number(price), 2).alias("v"), r(scalar.to_number(share)).alias("share"), scalar.to_number(key).alias("k"))


@query(
    "outer_merge_dates",
    "SELECT coalesce(a.d, b.d) AS d, a.n_orders, b.n_items FROM (SELECT CAST(o_orderdate AS DATE) AS d, count(*) AS n_orders FROM orders WHERE o_orderstatus = 'P' GROUP BY 1) a FULL OUTER JOIN (SELECT CAST(l_shipdate AS DATE) AS d, count(*) AS n_items FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) b ON a.d = b.d",
)
def outer_merge_dates(spark, sf_dir):
    a = read(spark, sf_dir, "orders").filter("o_orderstatus = 'P'").groupBy(F.to_date("o_orderdate").alias("d")).agg(F.count("*").alias("n_orders"))
    b = read(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").groupBy(F.to_date("l_shipdate").alias("d")).agg(F.count("*").alias("n_items"))
    return align.outer_merge([(a, "n_orders"), (b, "n_items")], ["d"])


@query("left_merge_dates", f"WITH {DAILY} SELECT a.s, a.d, a.y, b.n FROM daily a LEFT JOIN (SELECT CAST(l_shipdate AS DATE) AS d, count(*) AS n FROM lineitem GROUP BY 1) b ON a.d = b.d")
def left_merge_dates(spark, sf_dir):
    n = read(spark, sf_dir, "lineitem").groupBy(F.to_date("l_shipdate").alias("d")).agg(F.count("*").alias("n"))
    return daily(spark, sf_dir).join(n, "d", "left").select("s", "d", "y", "n")


WEEKLY = "weekly AS (SELECT s, d + CAST((8 - isodow(d)) % 7 AS INTEGER) AS week, max_by(y, d) AS y, sum(y) AS total FROM daily GROUP BY 1, 2)"


@query("weekly_resample_mon", f"WITH {DAILY}, {WEEKLY} SELECT s, CAST(week AS DATE) AS week, y, total FROM weekly")
def weekly_resample_mon(spark, sf_dir):
    days = daily(spark, sf_dir).withColumn("total", F.col("y"))
    return align.resample_monday(days, last=["y"], total=["total"])


@query("asof_weekly_to_daily", f"WITH {DAILY}, {WEEKLY} SELECT a.s, a.d, w.y AS v FROM daily a ASOF LEFT JOIN weekly w ON a.s = w.s AND a.d >= w.week")
def asof_weekly_to_daily(spark, sf_dir):
    days = daily(spark, sf_dir)
    weeks = align.resample_monday(days, last=["y"]).select("s", F.col("week").alias("d"), F.col("y").alias("v"))
    return align.asof_backward(days, weeks, "v").select("s", "d", "v")


@query(
    "calendar_align_ffill",
    f"WITH {DAILY}, {WEEKLY}, j AS (SELECT a.s, a.d, w.y AS v FROM daily a LEFT JOIN weekly w ON a.s = w.s AND a.d = w.week) SELECT s, d, last_value(v IGNORE NULLS) OVER (PARTITION BY s ORDER BY d ROWS UNBOUNDED PRECEDING) AS v FROM j",
)
def calendar_align_ffill(spark, sf_dir):
    days = daily(spark, sf_dir)
    weeks = align.resample_monday(days, last=["y"]).select("s", F.col("week").alias("d"), F.col("y").alias("v"))
    return align.calendar_ffill(days, weeks, "v").select("s", "d", "v")


_HOLES = "holes AS (SELECT user_id AS s, event_id AS d, CASE WHEN event_id % 3 = 0 THEN NULL ELSE value END AS v FROM events)"


def _holes(spark, sf_dir):
    return read(spark, sf_dir, "events").select(F.col("user_id").alias("s"), F.col("event_id").alias("d"), F.when(F.col("event_id") % 3 != 0, F.col("value")).alias("v"))


@query("ffill", f"WITH {_HOLES} SELECT s, d, last_value(v IGNORE NULLS) OVER ({_OVER} ROWS UNBOUNDED PRECEDING) AS v FROM holes")
def ffill(spark, sf_dir):
    return _holes(spark, sf_dir).withColumn("v", series.ffill(F.col("v"), W()))


@query("bfill", f"WITH {_HOLES} SELECT s, d, first_value(v IGNORE NULLS) OVER ({_OVER} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS v FROM holes")
def bfill(spark, sf_dir):
    return _holes(spark, sf_dir).withColumn("v", series.bfill(F.col("v"), W()))


@query(
    "interpolate_linear",
    f"""WITH {_HOLES}, n AS (SELECT *, row_number() OVER ({_OVER}) AS n FROM holes),
    e AS (SELECT *, last_value(v IGNORE NULLS) OVER (PARTITION BY s ORDER BY n ROWS UNBOUNDED PRECEDING) AS va, last_value(CASE WHEN v IS NOT NULL THEN n END IGNORE NULLS) OVER (PARTITION BY s ORDER BY n ROWS UNBOUNDED PRECEDING) AS na,
      first_value(v IGNORE NULLS) OVER (PARTITION BY s ORDER BY n ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS vb, first_value(CASE WHEN v IS NOT NULL THEN n END IGNORE NULLS) OVER (PARTITION BY s ORDER BY n ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS nb FROM n)
    SELECT s, d, round(CASE WHEN v IS NOT NULL THEN v WHEN vb IS NULL THEN va WHEN va IS NOT NULL THEN va + (vb - va) * (n - na) / (nb - na) END, 6) AS v FROM e""",
)
def interpolate(spark, sf_dir):
    return align.interpolate_linear(_holes(spark, sf_dir), "v").select("s", "d", r("v").alias("v"))


@query("log_return", f"WITH {RETURNS} SELECT s, d, round(r, 6) AS r FROM ret")
def log_return(spark, sf_dir):
    return _returns(spark, sf_dir).select("s", "d", r("r").alias("r"))


@query("diff_series", f"WITH {DAILY} SELECT s, d, round(x - lag(x) OVER ({_OVER}), 2) AS dx, lead(y) OVER ({_OVER}) AS next_y FROM daily")
def diff_series(spark, sf_dir):
    return daily(spark, sf_dir).select("s", "d", r(series.diff(F.col("x"), W()), 2).alias("dx"), F.lead("y").over(W()).alias("next_y"))


@query("pct_change_abs", f"WITH {DAILY} SELECT s, d, round(abs(x / lag(x) OVER ({_OVER}) - 1), 6) AS c FROM daily")
def pct_change_abs(spark, sf_dir):
    return daily(spark, sf_dir).select("s", "d", r(F.abs(series.pct_change(F.col("x"), W()))).alias("c"))


@query("rv_sumsq_30", f"WITH {RETURNS} SELECT s, d, round({_full(f'sqrt({_wfn("sum(r * r)", 30)})', 'r', 30)}, 6) AS rv FROM ret")
def rv_sumsq_30(spark, sf_dir):
    return _returns(spark, sf_dir).select("s", "d", r(series.rolling_sumsq_vol(F.col("r"), W(), 30)).alias("rv"))


@query("rv_annual_365", f"WITH {RETURNS} SELECT s, d, round({_full(f'{_wfn("stddev_samp(r)", 30)} * sqrt(365)', 'r', 30)}, 5) AS rv FROM ret")
def rv_annual_365(spark, sf_dir):
    return _returns(spark, sf_dir).select("s", "d", r(series.rolling_std(F.col("r"), W(), 30, 365**0.5), 5).alias("rv"))


@query(
    "rv_20_filled",
    f"WITH {RETURNS}, v AS (SELECT s, d, {_full(f'{_wfn("stddev_samp(r)", 20)} * sqrt(252)', 'r', 20)} AS rv FROM ret) SELECT s, d, round(coalesce(first_value(rv IGNORE NULLS) OVER ({_OVER} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0), 5) AS rv FROM v",
)
def rv_20_filled(spark, sf_dir):
    rows = _returns(spark, sf_dir).withColumn("rv", series.rolling_std(F.col("r"), W(), 20, 252**0.5))
    return rows.select("s", "d", r(F.coalesce(series.bfill(F.col("rv"), W()), F.lit(0.0)), 5).alias("rv"))


@query(
    "liquidity_features",
    f"""WITH {BARS}, v AS (SELECT *, c * vol AS dv FROM bars) SELECT s, d, round(dv, 6) AS dv, round({_wfn('avg(dv)', 5)}, 6) AS ma5, round({_wfn('avg(dv)', 20)}, 6) AS ma20,
    round((dv - {_wfn('avg(dv)', 20)}) / ({_wfn('stddev_samp(dv)', 20)} + 1e-12), 5) AS z20 FROM v""",
)
def liquidity_features(spark, sf_dir):
    rows = bars(spark, sf_dir).withColumn("dv", F.col("c") * F.col("vol"))
    w5, w20 = series.last_rows(W(), 5), series.last_rows(W(), 20)
    z = (F.col("dv") - F.avg("dv").over(w20)) / (F.stddev_samp("dv").over(w20) + 1e-12)
    return rows.select("s", "d", r("dv").alias("dv"), r(F.avg("dv").over(w5)).alias("ma5"), r(F.avg("dv").over(w20)).alias("ma20"), r(z, 5).alias("z20"))


@query("amihud", f"WITH {BARS} SELECT s, d, round(abs(c / lag(c) OVER ({_OVER}) - 1) / (c * vol + 1e-12) * 1e6, 6) AS illiq FROM bars")
def amihud(spark, sf_dir):
    return bars(spark, sf_dir).select("s", "d", r(series.amihud(F.col("c"), F.col("vol"), W()) * 1e6).alias("illiq"))


@query(
    "hl_spread",
    f"WITH {BARS}, b AS (SELECT s, d, pow(ln(hi / lo), 2) AS b FROM bars), a AS (SELECT s, d, pow(sqrt(2 * b) - sqrt(b + lead(b) OVER ({_OVER})), 2) AS a FROM b) SELECT s, d, round(2 * (exp(a) - 1) / (1 + exp(a)), 5) AS spread FROM a",
)
def hl_spread(spark, sf_dir):
    return bars(spark, sf_dir).select("s", "d", r(series.spread_from_range(F.col("hi"), F.col("lo"), W()), 5).alias("spread"))


@query("volume_share", f"WITH {BARS}, t AS (SELECT CAST(l_shipdate AS DATE) AS d, sum(l_quantity) AS q FROM lineitem GROUP BY 1) SELECT s, b.d, round(vol / (vol + q + 1e-12), 6) AS share, round(c * vol / (c * q + 1e-12), 6) AS turnover FROM bars b JOIN t ON b.d = t.d")
def volume_share(spark, sf_dir):
    q = read(spark, sf_dir, "lineitem").groupBy(F.to_date("l_shipdate").alias("d")).agg(F.sum("l_quantity").alias("q"))
    j = bars(spark, sf_dir).join(q, "d")
    return j.select("s", "d", r(F.col("vol") / (F.col("vol") + F.col("q") + 1e-12)).alias("share"), r(F.col("c") * F.col("vol") / (F.col("c") * F.col("q") + 1e-12)).alias("turnover"))


@query("premium", f"WITH {BARS} SELECT s, d, round((c - hi) / (hi + 1e-12) * 100, 6) AS gap, round(c / (hi * 1.25) - 1, 6) AS kp FROM bars")
def premium(spark, sf_dir):
    return bars(spark, sf_dir).select("s", "d", r(scalar.premium_pct(F.col("c"), F.col("hi"))).alias("gap"), r(scalar.kimchi_premium(F.col("c"), F.col("hi"), F.lit(1.25))).alias("kp"))


@query("asvi_4", f"WITH {DAILY} SELECT s, d, round({_full(f'(y - {_wfn("avg(y)", 4, 1)}) / nullif({_wfn("stddev_samp(y)", 4, 1)}, 0)', 'y', 4, 1)}, 5) AS asvi FROM daily")
def asvi_4(spark, sf_dir):
    return daily(spark, sf_dir).select("s", "d", r(series.asvi(F.col("y"), W(), 4), 5).alias("asvi"))


@query("har_features", f"WITH {DAILY} SELECT s, d, lag(y) OVER ({_OVER}) AS day, round({_full(_wfn('avg(y)', 5, 1), 'y', 5, 1)}, 6) AS week, round({_full(_wfn('avg(y)', 22, 1), 'y', 22, 1)}, 6) AS month FROM daily")
def har_features(spark, sf_dir):
    y = F.col("y")
    return daily(spark, sf_dir).select("s", "d", F.lag(y).over(W()).alias("day"), r(series.rolling_mean(y, W(), 5, 1)).alias("week"), r(series.rolling_mean(y, W(), 22, 1)).alias("month"))


@query("rolling_corr_30", f"WITH {DAILY} SELECT s, d, round({_full(_wfn('corr(x, y)', 30), 'x', 30)}, 5) AS c FROM daily")
def rolling_corr_30(spark, sf_dir):
    return daily(spark, sf_dir).select("s", "d", r(series.rolling_corr(F.col("x"), F.col("y"), W(), 30), 5).alias("c"))


@query(
    "minmax_rmse",
    f"WITH {DAILY}, m AS (SELECT s, (x - min(x) OVER (PARTITION BY s)) / (max(x) OVER (PARTITION BY s) - min(x) OVER (PARTITION BY s) + 1e-9) * 100 AS a, (y - min(y) OVER (PARTITION BY s)) / (max(y) OVER (PARTITION BY s) - min(y) OVER (PARTITION BY s) + 1e-9) * 100 AS b FROM daily) SELECT s, round(sqrt(avg(pow(a - b, 2))), 6) AS rmse, round(avg(abs(a - b)), 6) AS mae FROM m GROUP BY 1",
)
def minmax_rmse(spark, sf_dir):
    every = Window.partitionBy("s")
    rows = daily(spark, sf_dir).select("s", (series.min_max(F.col("x"), every) - series.min_max(F.col("y"), every)).alias("e"))
    return rows.groupBy("s").agg(r(F.sqrt(F.avg(F.pow("e", F.lit(2))))).alias("rmse"), r(F.avg(F.abs("e"))).alias("mae"))


@query(
    "describe_numeric",
    " UNION ALL ".join(
        f"SELECT '{c}' AS col, count({c}) AS n, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std, CAST(min({c}) AS DOUBLE) AS lo, round(quantile_cont(CAST({c} AS DOUBLE), 0.25), 4) AS p25, round(quantile_cont(CAST({c} AS DOUBLE), 0.5), 4) AS p50, round(quantile_cont(CAST({c} AS DOUBLE), 0.75), 4) AS p75, CAST(max({c}) AS DOUBLE) AS hi FROM lineitem"
        for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
    ),
)
def describe_numeric(spark, sf_dir):
    out = stats.describe(read(spark, sf_dir, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount", "l_tax"])
    return out.select("col", "n", r("mean", 4).alias("mean"), r("std", 4).alias("std"), "lo", *(r(c, 4).alias(c) for c in ("p25", "p50", "p75")), "hi")


@query(
    "missing_profile",
    " UNION ALL ".join(f"SELECT '{c}' AS col, count(*) FILTER ({e}) AS n_missing, round(count(*) FILTER ({e}) * 100.0 / count(*), 6) AS pct FROM events" for c, e in (("event_id", "event_id IS NULL"), ("ts", "ts IS NULL"), ("user_id", "user_id IS NULL"), ("event_type", "event_type IS NULL"), ("value", "value IS NULL OR isnan(value)"), ("props", "props IS NULL"))),
)
def missing_profile(spark, sf_dir):
    return stats.missing_profile(read(spark, sf_dir, "events")).select("col", "n_missing", r("pct").alias("pct"))


@query("top_values", "SELECT o_orderpriority AS value, count(*) AS n FROM orders GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 3")
def top_values(spark, sf_dir):
    return stats.top_values(read(spark, sf_dir, "orders"), "o_orderpriority", 3)


@query("duplicate_rows", "SELECT CAST(sum(n) AS BIGINT) AS n_rows, CAST(sum(n - 1) AS BIGINT) AS n_duplicates FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_suppkey, l_quantity, l_returnflag)")
def duplicate_rows(spark, sf_dir):
    return stats.duplicate_rows(read(spark, sf_dir, "lineitem").select("l_suppkey", "l_quantity", "l_returnflag"))


_CORR = ["l_discount", "l_extendedprice", "l_quantity", "l_tax"]


@query("corr_matrix_long", " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS corr FROM lineitem" for i, a in enumerate(_CORR) for b in _CORR[i:]))
def corr_matrix_long(spark, sf_dir):
    return stats.correlation_matrix(read(spark, sf_dir, "lineitem"), _CORR).select("a", "b", r("corr").alias("corr"))


@query("adjusted_skew_kurt", f"WITH {DAILY} SELECT s, round(skewness(x), 5) AS skew, round(kurtosis(x), 5) AS kurt FROM daily GROUP BY 1")
def adjusted_skew_kurt(spark, sf_dir):
    return daily(spark, sf_dir).groupBy("s").agg(r(stats.adjusted_skew(F.col("x")), 5).alias("skew"), r(stats.adjusted_kurtosis(F.col("x")), 5).alias("kurt"))


@query(
    "spearman",
    f"WITH {DAILY}, k AS (SELECT s, rank() OVER (PARTITION BY s ORDER BY x) + (count(*) OVER (PARTITION BY s, x) - 1) / 2.0 AS a, rank() OVER (PARTITION BY s ORDER BY y) + (count(*) OVER (PARTITION BY s, y) - 1) / 2.0 AS b FROM daily) SELECT s, round(corr(a, b), 6) AS spearman FROM k GROUP BY 1",
)
def spearman(spark, sf_dir):
    return stats.spearman(daily(spark, sf_dir), "x", "y", ["s"]).select("s", r("spearman").alias("spearman"))


@query("date_chunks", "SELECT CAST(c AS DATE) AS chunk_from, least(CAST(c + INTERVAL 3 MONTH - INTERVAL 1 DAY AS DATE), DATE '2025-05-23') AS chunk_to FROM generate_series(TIMESTAMP '2024-01-12', TIMESTAMP '2025-05-23', INTERVAL 3 MONTH) g(c)")
def date_chunks(spark, sf_dir):
    chunks = align.date_chunks(F.lit("2024-01-12").cast("date"), F.lit("2025-05-23").cast("date"), 3)
    return spark.range(1).select(F.explode(chunks).alias("c")).select(F.col("c.from").alias("chunk_from"), F.col("c.to").alias("chunk_to"))


@query(
    "position_split",
    f"WITH {DAILY} SELECT s, d, row_number() OVER ({_OVER}) <= floor(count(*) OVER (PARTITION BY s) * 0.8) AS is_train FROM daily",
)
def position_split(spark, sf_dir):
    return align.split_by_position(daily(spark, sf_dir), 0.8).select("s", "d", "is_train")


@query("zscore_clip", f"WITH {DAILY} SELECT s, d, round(greatest(-2, least(2, coalesce((y - avg(y) OVER (PARTITION BY s)) / nullif(stddev_pop(y) OVER (PARTITION BY s), 0), 0))), 6) AS z FROM daily")
def zscore_clip(spark, sf_dir):
    return daily(spark, sf_dir).select("s", "d", r(series.zscore_clip(F.col("y"), Window.partitionBy("s"), 2.0)).alias("z"))


@query("minimum_slice", f"WITH {RETURNS}, v AS (SELECT *, {_full(f'sqrt({_wfn("sum(r * r)", 30)})', 'r', 30)} AS rv FROM ret) SELECT s, d, round(r, 6) + 0.0 AS r, round(rv, 6) AS rv, round({_full(_wfn('corr(r, rv)', 30), 'rv', 30)}, 4) + 0.0 AS c FROM v")
def minimum_slice(spark, sf_dir):
    rows = _returns(spark, sf_dir).withColumn("rv", series.rolling_sumsq_vol(F.col("r"), W(), 30))
    return rows.select("s", "d", r("r").alias("r"), r("rv").alias("rv"), r(series.rolling_corr(F.col("r"), F.col("rv"), W(), 30), 4).alias("c"))
