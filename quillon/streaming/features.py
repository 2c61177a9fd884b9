"""Streaming features: windowed realised volatility with a watermark, and abnormal interest per key with state."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_volatility(events: DataFrame, ts: str = "ts", value: str = "value", key: str = "user_id", width: str = "1 day", late: str = "2 hours") -> DataFrame:
    """Per key and window: rows, mean, and the deviation of the values; late rows up to `late` still count."""
    rows = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    out = rows.groupBy(F.window(ts, width), key).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"))
    return out.select(key, F.col("window.start").alias("start"), "n", "mean", "sd")


def abnormal_interest(events: DataFrame, n: int = 4, ts: str = "ts", value: str = "value", key: str = "user_id") -> DataFrame:
    """Each value's distance from the mean of the `n` before it of its key, in their deviations; state is those `n` values.

    Rows of a micro-batch are taken in time order; the state of a key is n numbers.
    """

    def step(k: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        last = list(state.get[0]) if state.exists else []
        for pdf in batches:
            out = []
            for row in pdf.sort_values([ts, value]).itertuples(index=False):
                x = getattr(row, value)
                z = None
                if len(last) == n:
                    mean = sum(last) / n
                    sd = math.sqrt(sum((v - mean) ** 2 for v in last) / (n - 1))
                    z = (x - mean) / sd if sd > 0 else None
                out.append((k[0], getattr(row, ts), x, z))
                last = [*last, x][-n:]
            yield pd.DataFrame(out, columns=[key, ts, value, "asvi"]).astype({"asvi": "float64"})
        state.update((last,))

    kind = events.schema[key].dataType.simpleString()
    rows = events.select(key, F.col(ts).cast("timestamp").alias(ts), F.col(value).cast("double").alias(value)).filter(F.col(value).isNotNull())
    return rows.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, {ts} timestamp, {value} double, asvi double", "last array<double>", "append", "NoTimeout")
