"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept, and returns a
DataFrame that is written as Parquet and read again before the next one. All but the last return
the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import _lineage, decontaminate, jaccard_join, packing, pii, quality


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learnt from the labels, does not reject; a null text is scored as an empty one."""
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = quality.score(docs.select(F.struct(*docs.columns).alias("row"), "text"), model)
    return scored.filter(F.col("quality_score") >= quality.THRESHOLD).select("row.*")


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of every near-duplicate group (five words, similarity 0.8).

    Texts without words are in no group and stay. Rows with one id are one document, of which the
    row with the smallest text hash stays, then that with the smallest hash of all columns; rows
    with a null id stay.
    """
    found = _lineage.cut(jaccard_join.components(docs, ngram=5, num=80, den=100))
    ids = found.filter("doc_id is not null").groupBy("doc_id").agg(F.min("component_id").alias("component_id"), F.count("*").alias("n"))
    gone = ids.filter("doc_id <> component_id").select("doc_id")
    kept = docs.join(gone, "doc_id", "left_anti").select(docs.columns)
    many = _lineage.cut(ids.filter("n > 1").select("doc_id"))
    if many.isEmpty():
        return kept
    row = F.min_by(F.struct(*docs.columns), F.struct(F.xxhash64("text"), F.xxhash64(*docs.columns))).alias("row")
    single = kept.join(many, "doc_id", "left_anti").select(docs.columns)
    return single.unionByName(kept.join(many, "doc_id", "left_semi").groupBy("doc_id").agg(row).select("row.*"))


def not_in_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(docs.columns)


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data and the terms that reveal it replaced, and n_chars brought up to date."""
    clean = pii.sanitise(docs)
    if "n_chars" in docs.columns:
        clean = clean.withColumn("n_chars", F.coalesce(F.length("text").cast(docs.schema["n_chars"].dataType), F.col("n_chars")))
    return clean.select(docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences of at most 4096 tokens."""
    import public_tokenizers

    return packing.best_fit_packing(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality", good_quality),
    ("near_duplicates", one_of_each_group),
    ("decontamination", not_in_benchmark),
    ("personal_data", without_personal_data),
    ("packing", packed),
]

#: SQL cannot express the classifier, the group search and the packing; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage, over all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = _lineage.table(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
