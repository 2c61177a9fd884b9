import hashlib
import math
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from quillon.llm import importance as I
from quillon.llm import queries

SF = "/root/testdata/sf0.001"


def _features(text: str | None) -> list[int]:
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
    return [zlib.crc32(" ".join(words[i : i + k]).encode()) % 10000 for k in (1, 2, 3) for i in range(len(words) - k + 1)], len(words)


def brute_force(docs: list[tuple], target: list[str]) -> dict[int, tuple]:
    held, wanted = [0] * 10000, [0] * 10000
    for _, text in docs:
        for b in _features(text)[0]:
            held[b] += 1
    for text in target:
        for b in _features(text)[0]:
            wanted[b] += 1
    s, t = sum(held), sum(wanted)
    gain = [math.floor(1000 * math.log((wanted[b] + 1) * (s + 10000) / ((held[b] + 1) * (t + 10000)))) for b in range(10000)]
    rows = {}
    for ident, text in docs:
        found, n = _features(text)
        h = int(hashlib.sha256(f"42:{ident}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in found)
        rows[ident] = [len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n]
    able = sorted((i for i in rows if rows[i][4] >= 20), key=lambda i: (-rows[i][2], i))
    for rank, i in enumerate(able[: 5 * len(able) // 100], 1):
        rows[i][3] = rank
    return {i: tuple(r[:4]) for i, r in rows.items()}


def test_query_against_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    target = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    got = {r.doc_id: (r.n_features, r.weight, r.score, r["rank"]) for r in queries.QUERIES["op12_importance_resampling"](spark, SF).collect()}
    assert got == brute_force(docs, target)
    assert sum(r[3] is not None for r in got.values()) > 3


def test_odd_texts():
    for text in ["", " \t", "One", "a-b", "été ÀB  x9", "x" * 100_000, "\U0001f600 a\x00b", "A " * 5000]:
        found, n = I.feature_buckets(text.encode())
        want, m = _features(text)
        assert found.tolist() == want and n == m


@pytest.mark.parametrize("parts", [1, 3, 17])
def test_cutoff_with_ties_and_uneven_partitions(spark, parts):
    r = random.Random(parts)
    keys = [(r.choice([r.randrange(-50, 50), 7]), r.randrange(40)) for _ in range(700)]  # many equal scores and equal keys
    df = spark.createDataFrame(keys, "score bigint, id bigint")
    df = df.repartition(parts).union(df.limit(0))
    order = sorted(keys, key=lambda x: (-x[0], x[1]))
    for k in (1, 2, 35, 350, 699, 700):
        assert I.cutoff(df, k) == order[k - 1]


def test_draw_numbers_rows_that_clash_or_repeat(spark):
    rows = [(None, "a " * 30, 1), (1, None, 1), (2, "", 1), *[(3, "b " * 30, k % 2) for k in range(60)], *[(k, f"w{k} " * 25, None) for k in range(10, 60)]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, rank int")
    target = spark.createDataFrame([("b " * 20000,), (None,)], "text string")
    got = I.resample(docs, target).collect()
    assert len(got) == len(rows)
    drawn = sorted(r["rank"] for r in got if r["rank"] is not None)
    assert drawn == list(range(1, 111 * 5 // 100 + 1))
    assert all(r["doc_id"] == 3 for r in got if r["rank"] is not None)  # equal rows: as many as there is room for
    assert all(r.n_features == r.weight == 0 and r["rank"] is None for r in got if r.doc_id in (1, 2))
    assert I.resample(docs.limit(0), target).count() == 0
    none = I.resample(docs, target.limit(0)).collect()
    assert len(none) == len(rows) and all(r.weight <= 0 for r in none if r.n_features > 60)


def test_ranks_over_many_ranges(spark):
    rows = spark.range(2000).select((F.col("id") * 37 % 101).alias("score"), F.col("id").alias("id"))
    got = [r["rank"] for r in I.numbered(rows, F.desc("score"), "id").orderBy(F.desc("score"), "id").collect()]
    assert got == list(range(1, 2001))
