"""Calibration of weighted multi-band capture rates."""

from __future__ import annotations

import math
from collections.abc import Sequence
from statistics import NormalDist

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: At most so many replicates are broadcast; of more, Spark plans the join.
BROADCAST_SHIFTS = 100_000


def capture(y: DataFrame, bands: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """c per band: the share of steps of y (t, y) inside the band (k, t, lo, hi)."""
    return y.join(bands, "t").groupBy(*by, "k").agg(F.avg(F.col("y").between(F.col("lo"), F.col("hi")).cast("double")).alias("c"))


def calibrated(capture_rates: DataFrame, nominal: DataFrame, mode: str = "linear", by: Sequence[str] = ()) -> DataFrame:
    """Weighted mean over bands of how near c is to its nominal share p (nominal: k, p, weight)."""
    d = F.abs(F.col("c") - F.col("p"))
    worst = F.greatest(F.col("p"), 1 - F.col("p"))
    near = {"linear": 1 - d, "quadratic": 1 - d * d / (worst * worst), "normalised": 1 - d / worst}[mode]
    return capture_rates.join(nominal, "k").groupBy(*by).agg((F.sum(F.col("weight") * near) / F.sum("weight")).alias("wmcr"))


def circular_shifts(y: DataFrame, shifts: DataFrame, length: int) -> DataFrame:
    """(b, t, y): y rolled by each shift (b, shift).

    A few shifts are broadcast; more of them list the steps that each of theirs comes from and meet y there.
    """
    if shifts.limit(BROADCAST_SHIFTS + 1).count() <= BROADCAST_SHIFTS:
        moved = y.crossJoin(F.broadcast(shifts))
        return moved.select("b", F.pmod(F.col("t") + F.col("shift"), F.lit(length)).cast("int").alias("t"), "y")
    steps = shifts.withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(length - 1)))).withColumn("_t", F.pmod(F.col("t") - F.col("shift"), F.lit(length)).cast("int"))
    return steps.join(y.select(F.pmod(F.col("t"), F.lit(length)).cast("int").alias("_t"), "y"), "_t").select("b", F.col("t").cast("int").alias("t"), "y")


def block_bootstrap(y: DataFrame, starts: DataFrame, block: int, length: int) -> DataFrame:
    """(b, t, y): circular blocks from the starts (b, i, start), cut to the length."""
    steps = starts.select("b", (F.col("i") * block).alias("_at"), "start", F.explode(F.sequence(F.lit(0), F.lit(block - 1))).alias("_k"))
    steps = steps.select("b", (F.col("_at") + F.col("_k")).cast("int").alias("_t"), F.pmod(F.col("start") + F.col("_k"), F.lit(length)).cast("int").alias("t"))
    return steps.filter(F.col("_t") < length).join(y, "t").select("b", F.col("_t").alias("t"), "y")


def p_value(null: DataFrame, observed: float, alternative: str = "two-sided") -> DataFrame:
    """(1 + replicates at least as extreme) / (replicates + 1); two-sided by the distance from 1."""
    w, obs = F.col("wmcr"), F.lit(observed)
    extreme = {"two-sided": F.abs(w - 1) >= F.abs(obs - 1), "greater": w >= obs, "less": w <= obs}[alternative]
    return null.agg(((1 + F.sum(extreme.cast("int"))) / (F.count("*") + 1)).alias("p"))


def calibration(y: DataFrame, bands: DataFrame, nominal: DataFrame, resampled: DataFrame, alternative: str = "two-sided", mode: str = "linear") -> DataFrame:
    """wmcr, p and replicates: the observed rate against those of the resampled series (b, t, y) of `circular_shifts` or `block_bootstrap`."""
    observed = calibrated(capture(y, bands), nominal, mode).withColumnRenamed("wmcr", "_w")
    null = calibrated(capture(resampled, bands, ["b"]), nominal, mode, ["b"]).crossJoin(F.broadcast(observed))  # one row
    w, obs = F.col("wmcr"), F.col("_w")
    extreme = {"two-sided": F.abs(w - 1) >= F.abs(obs - 1), "greater": w >= obs, "less": w <= obs}[alternative]
    return null.agg(F.max("_w").alias("wmcr"), ((1 + F.sum(extreme.cast("int"))) / (F.count("*") + 1)).alias("p"), F.count("*").alias("replicates"))


def random_starts(spark: SparkSession, replicates: int, blocks: int, length: int, seed: int = 42) -> DataFrame:
    """(b, i, start): the starts of the blocks of every replicate, the same for the same seed however they are partitioned."""
    pairs = spark.range(replicates).select(F.col("id").alias("b"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("i"))
    return pairs.withColumn("start", F.pmod(F.xxhash64(F.lit(seed), "b", "i"), F.lit(length)).cast("int"))


def binomial_test(spark: SparkSession, n: int, nominal: Sequence[float], captured: Sequence[float], alpha: float = 0.05) -> DataFrame:
    """Standard error, tolerance and verdict of each band."""
    z = NormalDist().inv_cdf(1 - alpha / 2)
    rows = [(i, float(p), float(c), math.sqrt(p * (1 - p) / n)) for i, (p, c) in enumerate(zip(nominal, captured, strict=True))]
    df = spark.createDataFrame(rows, "k int, p double, c double, se double").withColumn("tol", F.lit(z) * F.col("se"))
    return df.withColumn("verdict", F.when(F.abs(F.col("c") - F.col("p")) <= F.col("tol"), "ACCEPTABLE").otherwise("NOT ACCEPTABLE"))
