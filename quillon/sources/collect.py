"""Collection in chunks that goes on where it was stopped.

What is there is a table: a row of the manifest for each chunk, written after the chunk's rows. A run
anti-joins the wanted chunks with it, so that it fetches what is missing only; once all are there,
the chunks are put together and cleaned up.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

_MANIFEST = "chunk int, first string, last string, n_rows bigint"


def _place(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """(chunk, first, last, n_rows) of the chunks that are there."""
    place, system = _place(spark, f"{folder}/manifest")
    if not system.exists(place):
        return spark.createDataFrame([], _MANIFEST)
    return spark.read.schema(_MANIFEST).parquet(f"{folder}/manifest").distinct()


def missing(wanted: DataFrame, there: DataFrame) -> DataFrame:
    """Wanted chunks (chunk, first, last) that are not there with these ends, in their order."""
    ends = ["chunk", "first", "last"]
    return wanted.select(F.col("chunk").cast("int").alias("chunk"), F.col("first").cast("string").alias("first"), F.col("last").cast("string").alias("last")).join(there.select(*ends), ends, "left_anti").orderBy("chunk")


def collect(wanted: DataFrame, fetch: Callable[[SparkSession, Row], DataFrame | None], folder: str) -> DataFrame:
    """Fetches what is missing of `wanted` (chunk, first, last), a commit a chunk, and gives the manifest.

    `fetch` gives the rows of a chunk, or None. A chunk without rows is left out of the manifest, so
    that a later run asks for it again; a chunk whose rows were written but not its line of the
    manifest is written anew. An error ends the run; what was fetched before it stays.
    """
    spark = wanted.sparkSession
    for chunk in missing(wanted, manifest(spark, folder)).toLocalIterator():  # a row a call of the source
        rows = fetch(spark, chunk)
        if rows is None:
            continue
        path = f"{folder}/chunks/chunk={chunk['chunk']}"
        rows.write.mode("overwrite").parquet(path)
        n = spark.read.parquet(path).count()
        if n:
            line = [(chunk["chunk"], chunk["first"], chunk["last"], n)]
            spark.createDataFrame(line, _MANIFEST).coalesce(1).write.mode("append").parquet(f"{folder}/manifest")
    return manifest(spark, folder)


def is_complete(wanted: DataFrame, folder: str) -> bool:
    return missing(wanted, manifest(wanted.sparkSession, folder)).isEmpty()


def merged(spark: SparkSession, folder: str, date: str = "date", by: Iterable[str] = ()) -> DataFrame:
    """The rows of all chunks of the manifest; of several of one date (and key) that of the first chunk, in it the smallest."""
    keys = [*by, date]
    rows = spark.read.option("basePath", f"{folder}/chunks").parquet(f"{folder}/chunks")
    rows = rows.withColumn("chunk", F.col("chunk").cast("int")).join(manifest(spark, folder).select("chunk").distinct(), "chunk", "left_semi")
    others = [c for c in rows.columns if c not in (*keys, "chunk")]
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy("chunk", *others))
    return rows.withColumn("_n", nth).filter("_n = 1").drop("_n", "chunk")


def clean_up(spark: SparkSession, folder: str) -> None:
    """Removes chunks and manifest of a collection that is complete and stored elsewhere."""
    for name in ("chunks", "manifest"):
        place, system = _place(spark, f"{folder}/{name}")
        system.delete(place, True)


def collect_terms(spark: SparkSession, terms: Iterable[tuple[str, str]], wanted: DataFrame, fetch: Callable[[SparkSession, str, Row], DataFrame | None], folder: str, date: str = "date") -> list[str]:
    """Daily interest (date, value) of each term (name, region) in chunks, each stored as a table of its own under `folder` once it is complete.

    Gives the paths of the stored tables; a term that is not complete is left for the next run.
    """
    stored = []
    for name, region in terms:
        own = f"{folder}/cache/{name}_{region}"
        collect(wanted, lambda s, chunk, name=name: fetch(s, name, chunk), own)
        if is_complete(wanted, own):
            path = f"{folder}/{name}_{region}"
            merged(spark, own, date).orderBy(date).write.mode("overwrite").option("header", True).csv(path)
            clean_up(spark, own)
            stored.append(path)
    return stored
