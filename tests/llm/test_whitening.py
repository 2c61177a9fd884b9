import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.llm import queries, whitening

SF = "/root/testdata/sf0.001"


def test_query_against_numpy(spark):
    source = spark.read.parquet(f"{SF}/embeddings.parquet").toPandas()
    ids = source["vec_id"].to_numpy()
    x = (np.floor(64 * np.stack(source["embedding"]).astype(float)) + 1_000_000).astype(np.int64)
    n, total = len(x), x.sum(0)
    centred = x - total / n
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    values, axes = values[::-1], axes[:, ::-1]
    exact = {int(i): sum(int(d) ** 2 for d in n * row - total) for i, row in zip(ids, x, strict=True)}
    got = queries.QUERIES["op13_whitening"](spark, SF).toPandas()
    assert len(got) == n * 32 and set(got["component"]) == set(range(1, 33)) and (got["n"] == n).all()
    assert {i: d for i, d in zip(got["vec_id"], got["deviation"], strict=True)} == exact
    assert got["identity_error"].nunique() == 1 and got["identity_error"].iloc[0] < 1e-9
    np.testing.assert_allclose(got.groupby("component")["explained"].first(), values[:32] / values.sum(), rtol=1e-9)
    wide = got.pivot(index="vec_id", columns="component", values="whitened").loc[ids].to_numpy()
    want = centred @ axes[:, :32] / np.sqrt(values[:32])
    want *= np.sign((want * wide).sum(0))  # an axis may point either way
    np.testing.assert_allclose(wide, want, atol=1e-6)


def test_edge_rows(spark):
    rows = [(None, [1.0, 2.0], 1), (1, None, 1), (2, [], 1), (3, [float("nan"), 1.0], 1), (4, [float("inf"), 1.0], 1), (5, [None, 1.0], 1), (6, [3.0, -1.0], 1), (6, [3.0, -1.0], 1), (7, [0.0, 0.5], None), (8, [1.0, 2.0, 3.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, v array<double>, whitened int")
    out, fit, error = whitening.whiten(df, "v")
    got = out.select("row.*", F.col("whitened").alias("z")).collect()
    assert fit.n == 4 and sorted((r.vec_id or 0) for r in got) == [0, 6, 6, 7] and error < 1e-9
    z = np.array([r.z for r in got])
    np.testing.assert_allclose(z.mean(0), 0, atol=1e-9)
    np.testing.assert_allclose(z.T @ z / 4, np.eye(2), atol=1e-9)
    alike, fit, error = whitening.whiten(df.filter("vec_id = 6"), "v")  # no variance, no direction
    assert [list(r.whitened) for r in alike.collect()] == [[], []] and fit.explained == [] and error == 0
    none, fit, _ = whitening.whiten(df.limit(0), "v")
    assert none.count() == 0 and fit.n == 0


def test_a_dimension_without_variance_and_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(whitening, "BLOCK_ROWS", 7)
    r = np.random.default_rng(3)
    x = np.column_stack([r.normal(5, 2, 150), np.full(150, 4.0), r.normal(size=150)])
    df = spark.createDataFrame([(i, list(map(float, row))) for i, row in enumerate(x)], "vec_id long, v array<double>").repartition(5)
    out, fit, error = whitening.whiten(df, "v")
    z = np.array([row.whitened for row in out.collect()])
    assert z.shape == (150, 2) and error < 1e-9 and sum(fit.explained) == pytest.approx(1)
    np.testing.assert_allclose(z.T @ z / 150, np.eye(2), atol=1e-9)


def test_indices_are_consecutive(spark):
    rows = spark.range(0, 1000, 1, 7).filter("id % 3 = 0")
    got = sorted(r["index"] for r in whitening.indexed(rows).collect())
    assert got == list(range(334))
