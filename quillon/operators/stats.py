"""Exploratory statistics, correlation and profiling."""

from __future__ import annotations

import bisect
import math
from collections.abc import Sequence
from functools import reduce
from itertools import combinations_with_replacement
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Of the approximate percentiles around an exact one, and how far from it they lie.
ACCURACY, MARGIN = 2_000, 0.0015


def quantiles(df: DataFrame, columns: Sequence[str], levels: Sequence[float]) -> DataFrame:
    """col and q (an array, one value a level): exact percentiles of whole columns, as `F.percentile` has them; columns without values have no row.

    Approximate percentiles on both sides of every level cut a column into ranges. A count of the
    rows beyond each cut tells in which range the values of a level lie and how many come before it,
    so that only those few are counted by value and put in order. A cut that is far off costs time only.
    """
    cells = df.select(*(F.col(c).cast("double").alias(f"_{i}") for i, c in enumerate(columns)))
    around = sorted({min(1.0, max(0.0, p + d)) for p in levels for d in (-MARGIN, MARGIN)})
    near = cells.agg(*(F.struct(F.count(c).alias("n"), F.percentile_approx(c, around, ACCURACY).alias("cuts")).alias(c) for c in cells.columns)).first() if columns else None
    full = {c: sorted(near[c].cuts, key=lambda x: (math.isnan(x), x)) for c in cells.columns if near[c].n} if columns else {}
    if not full:
        return df.sparkSession.createDataFrame([], "col string, q array<double>")
    beyond = cells.agg(*(F.array(*(F.count_if(F.col(c) > cut) for cut in cuts)).alias(c) for c, cuts in full.items())).first()
    wanted, ranges = [], {}
    for c, cuts in full.items():
        n = near[c].n
        before = [0, *(n - x for x in beyond[c]), n]
        for k, p in enumerate(levels):
            place = p * (n - 1)
            for rank in {math.floor(place), math.ceil(place)}:
                j = bisect.bisect_right(before, rank) - 1
                wanted.append((columns[int(c[1:])], c, j, k, rank - before[j], rank - place))
                ranges[c, j] = ([F.col(c) > cuts[j - 1]] if j else []) + ([~(F.col(c) > cuts[j])] if j < len(cuts) else [])
    inside = [F.when(reduce(and_, terms, F.col(c).isNotNull()), F.struct(F.lit(c).alias("c"), F.lit(j).alias("range"), F.col(c).alias("v"))) for (c, j), terms in ranges.items()]
    counts = cells.select(F.explode(F.array(*inside)).alias("p")).filter("p is not null").select("p.*").groupBy("c", "range", "v").agg(F.count("*").alias("same"))
    counts = counts.withColumn("upto", F.sum("same").over(Window.partitionBy("c", "range").orderBy("v")))
    targets = df.sparkSession.createDataFrame(wanted, "col string, c string, range int, k int, rank bigint, off double")
    found = counts.join(F.broadcast(targets), ["c", "range"]).filter((F.col("rank") < F.col("upto")) & (F.col("rank") >= F.col("upto") - F.col("same")))
    # The nearer of the two values around a level weighs more; equal ones are taken as they are.
    lo, hi = F.min("v"), F.max("v")
    value = F.when(lo == hi, lo).otherwise(F.max("off") * lo - F.min("off") * hi)
    each = found.groupBy("col", "k").agg(value.alias("q"))
    return each.groupBy("col").agg(F.array(*(F.max(F.when(F.col("k") == k, F.col("q"))) for k in range(len(levels)))).alias("q"))


def describe(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row per column: n, mean, std, min, quartiles, max."""
    v = lambda c: F.col(c).cast("double")
    facts = [F.struct(F.lit(c).alias("col"), F.count(v(c)).alias("n"), F.avg(v(c)).alias("mean"), F.stddev_samp(v(c)).alias("std"), F.min(v(c)).alias("lo"), F.max(v(c)).alias("hi")) for c in columns]
    one = df.agg(F.array(*facts).alias("p")).select(F.explode("p").alias("p")).select("p.*")
    out = one.join(quantiles(df, columns, (0.25, 0.5, 0.75)), "col", "left")
    return out.select("col", "n", "mean", "std", "lo", *(F.col("q")[i].alias(n) for i, n in enumerate(("p25", "p50", "p75"))), "hi")


def missing_profile(df: DataFrame) -> DataFrame:
    """One row per column: nulls (NaN counts as one) and their percentage."""
    n = F.count("*")

    def missing(c: str) -> Column:
        null = F.col(c).isNull()
        return F.sum((null | F.isnan(c)).cast("long") if dict(df.dtypes)[c] in ("double", "float") else null.cast("long"))

    one = df.agg(n.alias("_n"), *(missing(c).alias(c) for c in df.columns))
    cells = F.array(*(F.struct(F.lit(c).alias("col"), F.coalesce(F.col(c), F.lit(0)).alias("n_missing")) for c in df.columns))
    return one.select("_n", F.explode(cells).alias("p")).select("p.col", "p.n_missing", (F.col("p.n_missing") * 100.0 / F.nullif(F.col("_n"), F.lit(0))).alias("pct"))


def top_values(df: DataFrame, column: str, k: int) -> DataFrame:
    return df.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value").limit(k)


def duplicate_rows(df: DataFrame) -> DataFrame:
    """n_rows and how many repeat an earlier row; partial aggregation before the shuffle."""
    groups = df.groupBy(*df.columns).agg(F.count("*").alias("_n"))
    return groups.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("n_rows"), F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("n_duplicates"))


def correlation_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Long (a, b, corr) for a <= b: all pairs in one aggregation."""
    pairs = list(combinations_with_replacement(sorted(columns), 2))
    one = df.agg(*(F.corr(a, b).alias(f"{a}|{b}") for a, b in pairs))
    return one.select(F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"`{a}|{b}`").alias("corr")) for a, b in pairs))).alias("p")).select("p.*")


def report(df: DataFrame, top: int = 10) -> DataFrame:
    """(col, stat, value) of a table: rows and columns; per column its missing values; of numbers the description and correlations; of texts their number and the `top` ones; repeated rows.

    Facts of the table have an empty col. Correlations are of rows that hold both values.
    """
    numbers = [c for c, t in df.dtypes if t in ("tinyint", "smallint", "int", "bigint", "float", "double") or t.startswith("decimal")]
    texts = [c for c, t in df.dtypes if t == "string"]

    def long(rows: DataFrame, key: Column, stats: dict[str, str]) -> DataFrame:
        cells = F.array(*(F.struct(F.lit(name).alias("stat"), F.col(c).cast("double").alias("value")) for c, name in stats.items()))
        return rows.select(key.alias("col"), F.explode(cells).alias("p")).select("col", "p.*")

    repeated = duplicate_rows(df).withColumns({"pct": F.col("n_duplicates") * 100 / F.nullif(F.col("n_rows"), F.lit(0)), "n_columns": F.lit(len(df.columns))})
    parts = [long(repeated, F.lit(""), {"n_rows": "rows", "n_columns": "columns", "n_duplicates": "duplicates", "pct": "duplicates_pct"}), long(missing_profile(df), F.col("col"), {"n_missing": "missing", "pct": "missing_pct"})]
    if numbers:
        parts.append(long(describe(df, numbers), F.col("col"), {"n": "count", "mean": "mean", "std": "std", "lo": "min", "p25": "25%", "p50": "50%", "p75": "75%", "hi": "max"}))
    if len(numbers) > 1:
        corr = correlation_matrix(df, numbers)
        parts.append(corr.select(F.col("a").alias("col"), F.concat(F.lit("corr:"), "b").alias("stat"), F.col("corr").alias("value")))
        parts.append(corr.filter("a <> b").select(F.col("b").alias("col"), F.concat(F.lit("corr:"), "a").alias("stat"), F.col("corr").alias("value")))
    if texts:
        values = df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("col"), F.col(c).alias("text")) for c in texts))).alias("p")).select("p.*").filter("text is not null").groupBy("col", "text").agg(F.count("*").alias("n"))
        parts.append(values.groupBy("col").agg(F.count("*").cast("double").alias("value")).select("col", F.lit("unique").alias("stat"), "value"))
        first = values.withColumn("_i", F.row_number().over(Window.partitionBy("col").orderBy(F.desc("n"), "text"))).filter(F.col("_i") <= top)
        parts.append(first.select("col", F.concat(F.lit("top:"), "text").alias("stat"), F.col("n").cast("double").alias("value")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def before_after(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """Mean, deviation, extremes, adjusted skewness and kurtosis and the share without a value, of each column before and after a transformation."""
    names = [(a, step, c) for a, b in pairs for step, c in (("before", a), ("after", b))]
    cells = F.explode(F.array(*(F.struct(F.lit(a).alias("col"), F.lit(step).alias("step"), F.col(c).cast("double").alias("v")) for a, step, c in names))).alias("p")
    rows = df.select(cells).select("p.*")
    v = F.col("v")
    return rows.groupBy("col", "step").agg(F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.min(v).alias("lo"), F.max(v).alias("hi"), adjusted_skew(v).alias("skew"), adjusted_kurtosis(v).alias("kurt"), ((F.count("*") - F.count(v)) * 100 / F.count("*")).alias("nan_pct"))


def adjusted_skew(x: Column) -> Column:
    """Bias-adjusted skewness; null below three values."""
    n = F.count(x)
    return F.when(n > 2, F.skewness(x) * F.sqrt(n * (n - 1)) / F.nullif(n - 2, F.lit(0)))


def adjusted_kurtosis(x: Column) -> Column:
    """Bias-adjusted excess kurtosis; null below four values."""
    n = F.count(x)
    return F.when(n > 3, ((n + 1) * F.kurtosis(x) + 6) * (n - 1) / F.nullif((n - 2) * (n - 3), F.lit(0)))


def average_rank(x: Column, by: Sequence[str]) -> Column:
    """Rank with ties averaged."""
    w = Window.partitionBy(*by)
    return F.rank().over(w.orderBy(x)) + (F.count("*").over(w.partitionBy(*by, x)) - 1) / 2


def spearman(df: DataFrame, x: str, y: str, by: Sequence[str]) -> DataFrame:
    """Rank correlation of each group, on rows where both are set."""
    df = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    ranked = df.select(*by, average_rank(F.col(x), by).alias("_rx"), average_rank(F.col(y), by).alias("_ry"))
    return ranked.groupBy(*by).agg(F.corr("_rx", "_ry").alias("spearman"))


def autocorrelation(df: DataFrame, value: str, lags: int, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Autocorrelation for lags 0 to `lags`: the lags of a row are an array in one window pass."""
    w = Window.partitionBy(*by)
    rows = df.withColumn("_c", F.col(value) - F.avg(value).over(w))
    o = w.orderBy(*order)
    rows = rows.withColumn("_lags", F.array(*(F.lag("_c", k).over(o) if k else F.col("_c") for k in range(lags + 1))))
    rows = rows.select(*by, "_c", F.posexplode("_lags").alias("lag", "_l"))
    total = rows.groupBy(*by, "lag").agg(F.sum(F.col("_c") * F.col("_l")).alias("_s"), F.sum(F.col("_c") * F.col("_c")).alias("_v"))
    return total.select(*by, "lag", (F.coalesce("_s", F.lit(0.0)) / F.nullif(F.col("_v"), F.lit(0.0))).alias("acf"))


def rolling_moments(df: DataFrame, x: str, y: str, width: Column, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Adds mean_x, mean_y, var_x, var_y and cov_xy (divisor: the width) and vary (both take several values) of the `width` rows up to each, null before there are as many.

    The width may differ from row to row, as windows of Spark cannot: sums are differences of running
    sums of values centred on their series, so that they lose no digits to its level. Rows without a
    value of either go.
    """
    every = Window.partitionBy(*by)
    w = every.orderBy(*order)
    rows = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    rows = rows.withColumns({"_mx": F.avg(x).over(every), "_my": F.avg(y).over(every), "_i": F.row_number().over(w), "_n": F.count("*").over(every)}).withColumn("_w", width.cast("bigint"))
    cx, cy = F.col(x) - F.col("_mx"), F.col(y) - F.col("_my")
    # Whether the next row has another value: exact, where a variance from sums is not.
    turns = {f"_t{c}": F.coalesce((F.lead(v).over(w) != F.col(v)).cast("double"), F.lit(0.0)) for c, v in (("x", x), ("y", y))}
    rows = rows.withColumns(turns)
    parts = {"x": cx, "y": cy, "xx": cx * cx, "yy": cy * cy, "xy": cx * cy, "tx": F.col("_tx"), "ty": F.col("_ty")}
    running = w.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_c", F.struct(*(F.sum(v).over(running).alias(k) for k, v in parts.items()))).withColumn("_from", F.col("_i") - F.col("_w"))
    before = rows.select(*by, F.col("_i").alias("_from"), F.col("_c").alias("_b"))
    rows = rows.join(before, [*by, "_from"], "left")
    m = {k: (F.col("_c")[k] - F.coalesce(F.col("_b")[k], F.lit(0.0))) / F.nullif(F.col("_w"), F.lit(0)) for k in parts}
    vary = [F.col("_c")[f"t{c}"] - F.col(f"_t{c}") - F.coalesce(F.col("_b")[f"t{c}"], F.lit(0.0)) > 0 for c in "xy"]
    full = lambda v: F.when((F.col("_w") > 0) & (F.col("_i") >= F.col("_w")), v)
    found = {"mean_x": full(F.col("_mx") + m["x"]), "mean_y": full(F.col("_my") + m["y"]), "var_x": full(F.greatest(F.lit(0.0), m["xx"] - m["x"] * m["x"])), "var_y": full(F.greatest(F.lit(0.0), m["yy"] - m["y"] * m["y"])), "cov_xy": full(m["xy"] - m["x"] * m["y"]), "vary": full(vary[0] & vary[1])}
    return rows.select(*df.columns, *(v.alias(k) for k, v in found.items()))


def rolling_pearson(df: DataFrame, x: str, y: str, by: Sequence[str], order: Sequence[str], most: int = 30, share: int = 3) -> DataFrame:
    """Adds corr: that of the rows of a window of min(most, n / share) rows, n being the complete rows of a series; null where the window is not full or one of both does not vary in it."""
    n = F.col("_n")
    rows = rolling_moments(df, x, y, F.least(F.lit(most), F.floor(n / share)), by, order)
    found = F.col("cov_xy") / F.nullif(F.sqrt(F.col("var_x") * F.col("var_y")), F.lit(0.0))
    return rows.withColumn("corr", F.when(F.col("vary"), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), found)))).drop("mean_x", "mean_y", "var_x", "var_y", "cov_xy", "vary")


def histogram(df: DataFrame, value: str, bins: int, by: Sequence[str] = ()) -> DataFrame:
    """Density of equal bins between the extremes of each group; the last bin is closed."""
    ends = df.filter(F.col(value).isNotNull()).groupBy(*by).agg(F.min(value).alias("lo"), F.max(value).alias("hi"), F.count(value).alias("n"))
    rows = df.join(ends, list(by)) if by else df.crossJoin(F.broadcast(ends))  # one row
    width = (F.col("hi") - F.col("lo")) / bins
    at = F.least(F.lit(bins - 1), F.floor((F.col(value) - F.col("lo")) / F.nullif(width, F.lit(0.0)))).cast("int")
    rows = rows.filter(F.col(value).isNotNull()).withColumn("bin", F.coalesce(at, F.lit(0)))
    return rows.groupBy(*by, "bin").agg((F.count("*") / F.nullif(F.max("n") * F.max(width), F.lit(0.0))).alias("density"))


def running_sums(df: DataFrame, order: str, columns: Sequence[str], buckets: int = 200) -> DataFrame:
    """Running sums `run_<c>` of each column by `order`, without a window over the whole table.

    Approximate quantiles cut the order into buckets (a bounded list reaches the driver); sums run
    inside a bucket, on top of the totals of the buckets before it. Equal values share a bucket.
    """
    cuts = sorted(set(df.approxQuantile(order, [i / buckets for i in range(1, buckets)], 0.001)))
    bucket = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c < F.col(order))) if cuts else F.lit(0)
    df = df.withColumn("_bucket", bucket)
    w = Window.partitionBy("_bucket").orderBy(order).rangeBetween(Window.unboundedPreceding, 0)
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)  # a row per bucket
    total = df.groupBy("_bucket").agg(*(F.sum(c).alias(f"_t_{c}") for c in columns))
    total = total.select("_bucket", *(F.coalesce(F.sum(f"_t_{c}").over(before), F.lit(0)).alias(f"_b_{c}") for c in columns))
    out = df.join(F.broadcast(total), "_bucket")
    out = out.withColumns({f"run_{c}": F.sum(c).over(w) + F.col(f"_b_{c}") for c in columns})
    return out.drop("_bucket", *(f"_b_{c}" for c in columns))
