"""Nearest neighbours by score-aware anisotropic quantisation, four-bit table scans and exact reranking.

Vectors are normalised, so that the largest cosine is the largest inner product. A coarse k-means
(fitted on a bounded sample) deals them into cells. The residual to the cell's centre is coded with
four bits for each block of dimensions; codes minimise the anisotropic loss, in which the part of
the quantisation error that is parallel to the vector weighs more than the orthogonal part, since
it is the parallel part that shifts large inner products. For a query, a table of its products with
the sixteen code words of each block is looked up for every code.

Every vector is indexed, with both parts of its error: they bound its product with a query from the
approximate one. The exact cosines of the best approximate candidates give a threshold, and what the
bound leaves above it is ranked exactly as well. So the nearest are found whatever the rows are like;
rows that the codes tell apart badly only cost more exact products.

Vectors and queries are dealt into tasks by bounded chunks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

#: Vectors that the index is fitted on, those with the smallest id hashes.
SAMPLE = 8_000
BLOCK_DIMENSIONS = 2
#: Weight of the parallel error over the orthogonal error.
ANISOTROPY = 4.0
#: Approximate candidates of a chunk that are ranked exactly first, for each result asked for.
RERANK = 30
#: Components of the vectors, and of the queries, of one chunk; small tables have up to LEAST_PARTS chunks of 1,000 vectors.
CHUNK_VALUES, LEAST_PARTS = 1_280_000, 16
#: What rounding may add to a bound: of single precision for each block, and of double precision.
SINGLE, DOUBLE = 2.5e-7, 1e-9


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """vec_id and a double vector, without vectors that are null, zero or hold null or non-finite components."""
    v = F.col("v")
    rows = vectors.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.filter(v.isNotNull() & finite & F.exists(v, lambda x: x != 0) & F.col("vec_id").isNotNull())


def _of_each_id(vectors: DataFrame) -> DataFrame:
    """The smallest vector of each id, so that every step sees the same one."""
    return vectors.groupBy("vec_id").agg(F.min("v").alias("v"))


def _matrix(column, width: int | None = None) -> np.ndarray:
    rows = [np.asarray(x, np.float64) for x in column]
    return np.stack(rows) if rows else np.zeros((0, width or 0))


def _rows(column, dim: int) -> np.ndarray:
    return np.asarray(column.flatten(), np.float64).reshape(-1, dim)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _kmeans(x: np.ndarray, k: int, rounds: int, r: np.random.Generator) -> np.ndarray:
    centres = x[r.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        near = ((centres**2).sum(1) / 2 - x @ centres.T).argmin(1)
        total = np.zeros_like(centres)
        np.add.at(total, near, x)
        count = np.bincount(near, minlength=len(centres))
        centres = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], centres)
    return centres


class Index:
    """Coarse centres and the four-bit code books of each block of dimensions."""

    def __init__(self, sample: np.ndarray, cells: int, seed: int = 11):
        r = np.random.default_rng(seed)
        self.dim = sample.shape[1]
        self.blocks = -(-self.dim // BLOCK_DIMENSIONS)
        self.centres = _kmeans(sample, cells, 8, r).astype(np.float32)
        cell = self.cell(sample)
        residual = self._blocks(sample - self.centres[cell])
        self.words = np.zeros((self.blocks, 16, BLOCK_DIMENSIONS), np.float32)
        for b in range(self.blocks):
            book = _kmeans(residual[:, b], 16, 12, r)
            self.words[b, : len(book)] = book
            self.words[b, len(book) :] = book[0]
        for _ in range(3):  # words that minimise the anisotropic loss for the codes at hand, block by block
            self._refit(sample, residual, self.codes(sample, cell))

    def _blocks(self, x: np.ndarray) -> np.ndarray:
        x = np.pad(x, ((0, 0), (0, self.blocks * BLOCK_DIMENSIONS - self.dim)))
        return x.reshape(len(x), self.blocks, BLOCK_DIMENSIONS)

    def cell(self, x: np.ndarray) -> np.ndarray:
        return ((self.centres**2).sum(1) / 2 - x @ self.centres.T).argmin(1)

    def codes(self, x: np.ndarray, cell: np.ndarray, rounds: int = 3) -> np.ndarray:
        """Codes by coordinate descent on |e|^2 + (anisotropy - 1) <e, x>^2, e being the error of the unit vector x."""
        residual, unit = self._blocks(x - self.centres[cell]), self._blocks(x)
        error = residual[:, :, None, :] - self.words[None]
        plain, along = (error**2).sum(-1), np.einsum("nbwd,nbd->nbw", error, unit)
        code = plain.argmin(-1)
        rows = np.arange(len(x))
        parallel = np.take_along_axis(along, code[:, :, None], 2)[:, :, 0].sum(1)
        for _ in range(rounds):
            for b in range(self.blocks):
                rest = parallel - along[rows, b, code[:, b]]
                code[:, b] = (plain[:, b] + (ANISOTROPY - 1) * (rest[:, None] + along[:, b]) ** 2).argmin(1)
                parallel = rest + along[rows, b, code[:, b]]
        return code.astype(np.uint8)

    def _refit(self, x: np.ndarray, residual: np.ndarray, code: np.ndarray) -> None:
        unit = self._blocks(x)
        chosen = np.stack([self.words[b, code[:, b]] for b in range(self.blocks)], 1)
        parallel = ((residual - chosen) * unit).sum((1, 2))
        for b in range(self.blocks):
            rest = parallel - ((residual[:, b] - chosen[:, b]) * unit[:, b]).sum(1)
            for w in range(16):
                own = code[:, b] == w
                if own.any():
                    u, t = unit[own, b], residual[own, b]
                    left = own.sum() * np.eye(BLOCK_DIMENSIONS) + (ANISOTROPY - 1) * u.T @ u
                    right = t.sum(0) + (ANISOTROPY - 1) * ((rest[own] + (t * u).sum(1))[:, None] * u).sum(0)
                    self.words[b, w] = np.linalg.solve(left, right)

    def errors(self, x: np.ndarray, cell: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The parallel part of each error and the length of the orthogonal one."""
        words = self.words[np.arange(self.blocks), code].reshape(len(x), -1)[:, : self.dim]
        error = x - self.centres[cell] - words
        along = (error * x).sum(1)
        return along, np.linalg.norm(error - along[:, None] * x, axis=1)

    def packed(self, code: np.ndarray) -> np.ndarray:
        """Two codes a byte."""
        if code.shape[1] % 2:
            code = np.pad(code, ((0, 0), (0, 1)))
        return (code[:, ::2] | (code[:, 1::2] << 4)).astype(np.uint8)

    def tables(self, queries: np.ndarray) -> np.ndarray:
        """For every query and byte of codes, the product of each of the 256 byte values."""
        one = np.einsum("qbd,bwd->qbw", self._blocks(queries).astype(np.float32), self.words)
        if one.shape[1] % 2:
            one = np.pad(one, ((0, 0), (0, 1), (0, 0)))
        return (one[:, ::2, None, :] + one[:, 1::2, :, None]).reshape(len(queries), -1, 256)


def _coder(index: Index, kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 2048):
                part = batch.slice(start, 2048)
                given = _rows(part.column("v"), index.dim)
                x = _unit(given)
                cell = index.cell(x)
                code = index.codes(x, cell)
                along, across = index.errors(x, cell, code)
                cells = [pa.array(cell, pa.int32()), pa.array([c.tobytes() for c in index.packed(code)], pa.binary()), pa.array(along), pa.array(across)]
                yield pa.record_batch([part.column("vec_id"), *cells, pa.array([v.tobytes() for v in given.astype(kind)], pa.binary())], names=["vec_id", "cell", "code", "along", "across", "v"])

    return run


def _cosines(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Cosines of rows in double precision; powers of two keep squares in range and change no result."""
    q, v = (np.ldexp(x, -np.frexp(np.abs(x).max(1, keepdims=True))[1]) for x in (q, v))
    return (q * v).sum(1) / (np.sqrt((q * q).sum(1)) * np.sqrt((v * v).sum(1)))


def _scanner(index: Index, kind: str, k: int):
    """The `k` nearest of a chunk for each of its queries, ties to the smaller id."""
    slack = SINGLE * (index.blocks + 8)

    def run(queries: pd.DataFrame, codes: pd.DataFrame) -> pd.DataFrame:
        if not len(queries) or not len(codes):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})
        codes = codes.sort_values("vec_id")
        ids, cell = codes["vec_id"].to_numpy(), codes["cell"].to_numpy()
        code = np.frombuffer(b"".join(codes["code"]), np.uint8).reshape(len(ids), -1)
        along, across = codes["along"].to_numpy(), codes["across"].to_numpy()
        given = np.frombuffer(b"".join(codes["v"]), kind).reshape(len(ids), -1)
        unit = _unit(given.astype(np.float64))
        asked, raw = queries["query_id"].to_numpy(), _matrix(queries["v"])
        q = _unit(raw)
        place = np.minimum(np.searchsorted(ids, asked), len(ids) - 1)
        own = ids[place] == asked
        first = min(RERANK * k, len(ids))
        out = []
        for at in range(0, len(q), 64):
            tables = index.tables(q[at : at + 64])
            score = (q[at : at + 64] @ index.centres.T).astype(np.float32)[:, cell]
            for b in range(code.shape[1]):
                score += np.take(tables[:, b], code[:, b], axis=1)
            for row, one in enumerate(score, at):
                if own[row]:
                    one[place[row]] = -np.inf
                best = np.argpartition(one, len(one) - first)[len(one) - first :]
                exact = unit[best[one[best] > -np.inf]] @ q[row]
                if len(exact) > k:
                    # The error e of x has parts p = <e, x> and g: s (1 - p) <= approximate s + g sqrt(1 - s^2).
                    least = np.partition(exact, -k)[-k] - DOUBLE
                    spread = np.sqrt(max(0.0, 1 - least * least)) if least > 0 else 1.0
                    best = np.flatnonzero(one + spread * across + slack >= np.minimum(least * (1 - along), 1 - along))
                    exact = unit[best] @ q[row]
                    best = best[exact >= np.partition(exact, -k)[-k] - DOUBLE]
                else:
                    best = best[one[best] > -np.inf]
                cosine = _cosines(raw[row : row + 1], given[best].astype(np.float64))
                order = np.lexsort((ids[best], -cosine))[:k]
                out.append((np.full(len(order), asked[row]), ids[best][order], cosine[order]))
        return pd.DataFrame({name: np.concatenate(c) for name, c in zip(("query_id", "vec_id", "score"), zip(*out, strict=True), strict=True)})

    return run


def search(queries: DataFrame, vectors: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", sample: int = SAMPLE) -> DataFrame:
    """query_id, rank, vec_id, score: each query's `k` nearest others, by cosine in double precision.

    Nearest first, ties to the smaller vec_id. Fewer candidates than `k` give all. Vectors that are
    null, zero, hold null or non-finite components, or have no id take no part; of repeated ids one
    row counts, that with the smallest vector. Vectors of another length than the commonest one take no
    part. Other columns are not read.
    """
    base = usable(vectors, id_col, vector_col)
    # The sample's bound holds for the driver's table too.
    fitted = base.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).toArrow().column("v").to_pylist()
    if not fitted:
        return vectors.sparkSession.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    # The commonest length of all vectors, the smaller of two as common.
    dim, rows = base.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    fitted = _matrix([x for x in fitted if len(x) == dim], dim)
    base = base.filter(F.size("v") == dim)
    asked = usable(queries.filter(F.size(vector_col) == dim), id_col, vector_col)
    if not len(fitted):  # none of the sample has the commonest length
        fitted = _matrix(base.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).toArrow().column("v").to_pylist())
    index = Index(_unit(fitted), int(max(1, min(2048, len(fitted) // 16, rows**0.5 / 2))))
    kind = "<f4" if vectors.schema[vector_col].dataType.elementType == FloatType() else "<f8"

    # Chunks of vectors meet chunks of queries, both bounded.
    parts = max(-(-rows * dim // CHUNK_VALUES), min(LEAST_PARTS, rows // 1000), 1)
    turns = max(-(-asked.count() * dim // CHUNK_VALUES), 1)
    dealt = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    codes = _of_each_id(base).mapInArrow(_coder(index, kind), "vec_id bigint, cell int, code binary, along double, across double, v binary")
    codes = codes.withColumn("part", dealt("vec_id", parts)).withColumn("turn", every(turns))
    ask = _of_each_id(asked).select(F.col("vec_id").alias("query_id"), "v")
    ask = ask.withColumn("turn", dealt("query_id", turns)).withColumn("part", every(parts))
    found = ask.groupBy("part", "turn").cogroup(codes.groupBy("part", "turn")).applyInPandas(_scanner(index, kind, k), "query_id bigint, vec_id bigint, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
