"""Importance resampling towards a target corpus, with an exact distributed selection.

Features are all runs of one to three consecutive words, hashed into buckets by crc32. Buckets are
counted over all documents and all target texts; a document's weight is the sum of the gains of its
features' buckets, an integer. With Gumbel noise from a hash of its id added, the documents of the
highest scores are a draw without replacement in proportion to the exponential of the weights.

The draw's cutoff is found by a weighted median of medians: every partition gives the median of its
keys that are still open, and how many are; the median of these, weighted by the numbers, has at
least a quarter of the open keys on either side, so every round discards a guaranteed fraction until
the pivot is the key of the wanted rank. Only the winners are sorted, by ranges, and numbered.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.llm import _batches, _lineage

BUCKETS = 10_000
LEAST_WORDS, PERCENT, SEED = 20, 5, 42
#: Bytes that are no part of a word become spaces, A-Z become lower case; bytes beyond ASCII stay.
_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))


def feature_buckets(raw: bytes, buckets: int = BUCKETS) -> tuple[np.ndarray, int]:
    """The bucket of every run of one to three words of a text, and how many words it has.

    A run's crc32 goes on from that of its beginning, so that no run is put together.
    """
    words = raw.translate(_WORDS).split()
    if not words:
        return np.zeros(0, np.int64), 0
    spaced = b"\n ".join(words).split(b"\n")[1:]  # the second word on, each after a space
    one = list(map(zlib.crc32, words))
    two = list(map(zlib.crc32, spaced, one))
    three = list(map(zlib.crc32, spaced[1:], two))
    return np.array(one + two + three, np.int64) % buckets, len(words)


def _counter(text_col: str, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in _batches.slices(batches):
            total += np.bincount(np.concatenate([feature_buckets(raw, buckets)[0] for raw in _batches.raw(batch, text_col)]), minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.record_batch([pa.array(at), pa.array(total[at])], names=["bucket", "n"])

    return run


def bucket_counts(rows: DataFrame, text_col: str = "text", buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all texts fall into each bucket: one array a task, added up by bucket."""
    counts = rows.select(text_col).mapInArrow(_counter(text_col, buckets), "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))
    total = np.zeros(buckets, np.int64)
    for r in counts.collect():  # a row a bucket
        total[r.bucket] = r.n
    return total


def bucket_gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln((t + 1)(S + B) / ((s + 1)(T + B)))) of every bucket, B being their number; the product in doubles."""
    held, wanted, b = int(source.sum()), int(target.sum()), len(source)
    return np.array([math.floor(1000 * math.log((float(t + 1) * float(held + b)) / (float(s + 1) * float(wanted + b)))) for s, t in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def noise(doc_id: int | None, seed: int = SEED) -> int:
    """floor(-1000 ln(-ln u)), u from the first 32 bits of sha256 of seed:id; a null id is an empty one."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def _scorer(gains: np.ndarray, id_col: str, text_col: str, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _batches.slices(batches):
            found = [feature_buckets(raw, len(gains)) for raw in _batches.raw(batch, text_col)]
            sizes = np.array([len(b) for b, _ in found], np.int64)
            weight = np.array([gains[b].sum() for b, _ in found], np.int64)
            score = weight + np.array([noise(i, seed) for i in batch.column(id_col).to_pylist()], np.int64)
            yield pa.record_batch([*batch.columns, *map(pa.array, (sizes, weight, score, np.array([n for _, n in found], np.int64)))], names=[*batch.schema.names, *_ADDED])

    return run


_ADDED = ["n_features", "weight", "score", "n_words"]


def weigh(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """All columns and rows of `docs` with n_features, weight, score and n_words.

    Columns of these names are replaced; a null text has no words; equal rows score alike.
    """
    gains = bucket_gains(bucket_counts(docs, text_col, buckets), bucket_counts(target, text_col, buckets))
    docs = docs.drop(*_ADDED)
    schema = T.StructType([*docs.schema.fields, *(T.StructField(c, T.LongType()) for c in _ADDED)])
    return docs.mapInArrow(_scorer(gains, id_col, text_col, seed), schema)


# ---- selection: keys are (score, id), the highest score first, then the smallest id, null ids last ----------

_KEY = "score bigint, id bigint, n bigint, above bigint, equal bigint, below_score bigint, below_id bigint, n_below bigint"
_LAST = 2**63 - 1


def _sides(pivot: tuple[int, int] | None):
    """For the open keys of a partition: how many are above and at the pivot, and the median of those above and of those below."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(b.column("score").to_numpy(), b.column("id").to_numpy()) for b in batches if b.num_rows]
        if not held:
            return
        score, ident = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.lexsort((ident, -score))
        score, ident = score[order], ident[order]
        if pivot is None:
            first, last = len(score), len(score)  # every key counts as above
        else:
            first = int(((score > pivot[0]) | ((score == pivot[0]) & (ident < pivot[1]))).sum())
            last = first + int(((score == pivot[0]) & (ident == pivot[1])).sum())
        middle = lambda a, z: (int(score[(a + z) // 2]), int(ident[(a + z) // 2])) if z > a else (None, None)
        row = [*middle(0, first), len(score), first, last - first, *middle(last, len(score)), len(score) - last]
        yield pa.record_batch([pa.array([x], pa.int64()) for x in row], names=[c.split()[0] for c in _KEY.split(", ")])

    return run


def _weighted_median(medians: list[tuple[tuple[int, int], int]]) -> tuple[int, int]:
    """The key at which half of the weight is reached, keys in falling order."""
    medians = sorted(medians, key=lambda x: (-x[0][0], x[0][1]))
    half, reached = sum(n for _, n in medians) / 2, 0
    for key, n in medians:
        reached += n
        if reached >= half:
            return key
    raise ValueError("no keys")


def cutoff(keys: DataFrame, k: int) -> tuple[int, int]:
    """The key of rank k (from 1) of (score, id: bigint, not null); there must be k rows at least.

    Every round is one pass over the keys still open, a row a partition comes to the driver.
    """
    before = F.struct((-F.col("score")).alias("score"), F.col("id").alias("id"))
    at = lambda key: F.struct(F.lit(-key[0]).cast("bigint").alias("score"), F.lit(key[1]).cast("bigint").alias("id"))
    pivot, high, low, rank = None, None, None, k  # open keys lie strictly between `high` and `low`
    while True:
        left = keys
        if high is not None:
            left = left.filter(before > at(high))
        if low is not None:
            left = left.filter(before < at(low))
        found = left.mapInArrow(_sides(pivot), _KEY).collect()  # a row a partition
        if pivot is None:
            pivot = _weighted_median([((r.score, r.id), r.above) for r in found])
            continue
        above, equal = sum(r.above for r in found), sum(r.equal for r in found)
        if above < rank <= above + equal:
            return pivot
        if rank <= above:
            low, pivot = pivot, _weighted_median([((r.score, r.id), r.above) for r in found if r.above])
        else:
            rank -= above + equal
            high, pivot = pivot, _weighted_median([((r.below_score, r.below_id), r.n_below) for r in found if r.n_below])


def numbered(rows: DataFrame, *order) -> DataFrame:
    """`rows` with rank (from 1) in the given order: ranges sorted on their own, and the sizes of the ranges before."""
    ranges = max(1, rows.sparkSession.sparkContext.defaultParallelism)
    rows = _lineage.table(rows.repartitionByRange(ranges, *order).sortWithinPartitions(*order).withColumns({"_range": F.spark_partition_id(), "_at": F.monotonically_increasing_id().bitwiseAND(F.lit(2**33 - 1))}))
    sizes = sorted(map(tuple, rows.groupBy("_range").count().collect()))  # a row a range
    first = np.append(0, np.cumsum([n for _, n in sizes]))
    offsets = rows.sparkSession.createDataFrame([(int(p), int(x)) for (p, _), x in zip(sizes, first, strict=False)], "_range int, _first bigint")
    return rows.join(F.broadcast(offsets), "_range").withColumn("rank", F.col("_first") + F.col("_at") + 1).drop("_range", "_at", "_first")


def draw(scored: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, id_col: str = "doc_id") -> DataFrame:
    """All rows and columns of `scored` (score, n_words and the id, as `weigh` gives them) with rank, null where a row is not drawn.

    Of the N rows of `least_words` words at least, floor(percent N / 100) are drawn: the highest
    scores, of equal ones the smallest id, null ids last. Rows of one id are rows of their own; of
    equal scores and ids at the cutoff as many are drawn as there is room for. A column rank is
    replaced. The rows are written once to the shared folder: leave texts out that are not needed.
    """
    scored = _lineage.table(scored.drop("rank"))
    able = F.col("n_words") >= least_words
    k = scored.filter(able).count() * percent // 100
    none = F.lit(None).cast("bigint").alias("rank")
    if not k:
        return scored.select("*", none)
    ident = F.coalesce(F.col(id_col).cast("bigint"), F.lit(_LAST))
    score, last = cutoff(scored.filter(able).select("score", ident.alias("id")), k)
    wins = able & ((F.col("score") > score) | ((F.col("score") == score) & (ident <= last)))
    ranked = numbered(scored.filter(wins), F.desc("score"), ident)
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= k, F.col("rank")))
    return scored.filter(~wins).select("*", none).unionByName(ranked)


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, least_words: int = LEAST_WORDS, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """All rows and columns of `docs`, weighed and drawn; an empty target or corpus gives weights all the same."""
    return draw(weigh(docs, target, id_col, text_col, buckets, seed), percent, least_words, id_col)
