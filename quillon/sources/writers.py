"""Writers: result tables, nested documents, scenario partitions, keyed caches and snapshots."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Mapping
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Files of a scenario, each written by a task of its own.
SCENARIO_FILES = 16


def csv_table(df: DataFrame, path: str, one_file: bool = False) -> None:
    """CSV with a header; `one_file` is for small result tables only."""
    (df.coalesce(1) if one_file else df).write.mode("overwrite").option("header", True).csv(path)


def json_documents(df: DataFrame, path: str) -> None:
    """One nested document per row."""
    df.select(F.to_json(F.struct(*df.columns)).alias("value")).write.mode("overwrite").text(path)


def scenario_paths(df: DataFrame, path: str) -> None:
    """A folder per scenario: a reader that picks scenarios reads theirs only. The simulations of one are dealt over SCENARIO_FILES tasks, a file each."""
    part = F.pmod(F.xxhash64("sim_id"), F.lit(SCENARIO_FILES)) if "sim_id" in df.columns else F.lit(0)
    df.repartition(F.col("scenario_id"), part).write.mode("overwrite").partitionBy("scenario_id").parquet(path)


def workbook(tables: Mapping[str, DataFrame], path: str, kind: str = "parquet") -> None:
    """Several result tables under one folder, a sheet each."""
    for name, df in tables.items():
        df.write.mode("overwrite").format(kind).option("header", True).save(f"{path}/{name}")


def cache_key(params: Mapping[str, object], inputs: Mapping[str, str] | None = None) -> str:
    """A content key of parameters and input fingerprints."""
    return hashlib.sha256(json.dumps([dict(params), dict(inputs or {})], sort_keys=True, default=str).encode()).hexdigest()[:32]


def cached(spark: SparkSession, folder: str, key: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The table of a key, made and written first if it is not there or was not finished."""
    path = f"{folder}/{key}"
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def snapshot(df: DataFrame, folder: str, name: str) -> str:
    """A new version of a table; earlier ones stay for comparison. Returns its path."""
    path = f"{folder}/{name}/version={datetime.now(timezone.utc):%Y%m%dT%H%M%S%f}"
    df.write.parquet(path)
    return path
