"""Whitening of embeddings with distributed block matrices.

Centred rows get consecutive indices and are dealt into blocks of a BlockMatrix. The product of its
transpose with itself is the scatter; its eigenvectors are found on the driver, as the scatter is as
wide as a vector, whatever the number of rows. Multiplying the blocks by the whitening matrix
projects the rows. The inner dimension of every product is split, so that each task multiplies a
few blocks and only products of the width of a vector are added up.

Which rows take part: those whose vector is neither null nor empty, holds no null and no non-finite
entry, and has the commonest length of all such vectors (of equally common ones the shortest).
Others are left out. Repeated rows and ids count as often as they stand. Without any row, or where
all vectors are equal, there is no component and the result is empty of components.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import Matrices
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm import _lineage

COMPONENTS = 32
#: Rows of a block at least, blocks at most (the rows of a block grow beyond), and blocks that a task multiplies.
BLOCK_ROWS, BLOCKS, TASK_BLOCKS = 1_024, 65_536, 8
#: Components whose variance is no more than this share of the largest have no direction of their own.
LEAST_SHARE = 1e-12
_LOW = 2**33 - 1


@dataclass(frozen=True)
class Whitening:
    """n rows with the sums of each dimension; eigenvalues and unit axes (columns) by falling eigenvalue; the trace of the covariance."""

    n: int
    sums: Sequence[float]
    values: np.ndarray
    axes: np.ndarray
    trace: float

    @property
    def explained(self) -> list[float]:
        return (self.values / self.trace).tolist() if len(self.values) else []


def usable(rows: DataFrame, vector_col: str) -> DataFrame:
    """The rows that take part, see above."""
    v = F.col(vector_col)
    entry = lambda x: x.cast("double")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(entry(x)) & (F.abs(entry(x)) < float("inf")))
    rows = rows.filter(v.isNotNull() & (F.size(v) > 0) & finite)
    length = rows.groupBy(F.size(v).alias("k")).count().orderBy(F.desc("count"), "k").first()
    return rows.filter(F.size(v) == (length.k if length else 0))


def indexed(rows: DataFrame) -> DataFrame:
    """`rows` as a struct `row`, with consecutive numbers `index` from 0; written once, so that the numbers stay."""
    rows = _lineage.table(rows.select(F.struct("*").alias("row"), F.monotonically_increasing_id().alias("at")))
    sizes = sorted(map(tuple, rows.groupBy(F.shiftright("at", 33)).count().collect()))  # a row a partition
    first = np.append(0, np.cumsum([n for _, n in sizes]))
    offsets = rows.sparkSession.createDataFrame([(int(p), int(at)) for (p, _), at in zip(sizes, first, strict=False)], "part bigint, first bigint")
    rows = rows.withColumn("part", F.shiftright("at", 33)).join(F.broadcast(offsets), "part")
    return rows.select((F.col("first") + F.col("at").bitwiseAND(F.lit(_LOW))).alias("index"), "row")


def sums(rows: DataFrame, vector) -> tuple[int, list]:
    """The number of rows and the sum of each dimension, in the type of the entries (exact for integers)."""
    flat = rows.select(F.posexplode(vector).alias("dimension", "x")).groupBy("dimension").agg(F.sum("x").alias("x"), F.count("*").alias("n"))
    found = flat.orderBy("dimension").collect()  # a row a dimension
    return (found[0].n, [r.x for r in found]) if found else (0, [])


def blocks(rows: DataFrame, n: int, width: int) -> BlockMatrix:
    """The block matrix of (index, vector as array<double>)."""
    table = MLUtils.convertVectorColumnsFromML(rows.select("index", array_to_vector("vector").alias("vector")), "vector")
    return IndexedRowMatrix(table, n, width).toBlockMatrix(max(BLOCK_ROWS, -(-n // BLOCKS)), width)


def scatter(matrix: BlockMatrix) -> np.ndarray:
    """The transpose times the matrix; TASK_BLOCKS of the blocks along the inner dimension meet in a task."""
    splits = max(1, -(-matrix.numRowBlocks // TASK_BLOCKS))
    found = matrix.transpose()._java_matrix_wrapper.call("multiply", matrix._java_matrix_wrapper._java_model, splits)
    return BlockMatrix(found, matrix.colsPerBlock, matrix.colsPerBlock).toLocalMatrix().toArray()


def project(matrix: BlockMatrix, weights: np.ndarray) -> BlockMatrix:
    """The matrix times a small one of as many rows as it has columns."""
    context = matrix.blocks.context
    height, width = weights.shape
    one = BlockMatrix(context.parallelize([((0, 0), Matrices.dense(height, width, weights.ravel(order="F")))], 1), height, width)
    return matrix.multiply(one)


def whiten(rows: DataFrame, vector_col: str = "embedding", components: int = COMPONENTS) -> tuple[DataFrame, Whitening, float]:
    """(row, whitened), the fit, and the largest entry of the whitened covariance minus the identity.

    `row` is a struct of all columns of a row that takes part, `whitened` its centred vector on the
    first `components` axes, each over the root of its eigenvalue. Integers are summed exactly.
    """
    table = indexed(usable(rows, vector_col))
    v = F.col(f"row.{vector_col}")
    n, total = sums(table, v)
    if not n:
        return table.select("row", F.array().cast("array<double>").alias("whitened")), Whitening(0, [], np.zeros(0), np.zeros((0, 0)), 0.0), 0.0
    # n x - S is exact where the entries are integers.
    centred = F.zip_with(v, F.array(*map(F.lit, total)), lambda x, s: (x * F.lit(n) - s) / F.lit(n)).cast("array<double>")
    matrix = blocks(table.select("index", centred.alias("vector")), n, len(total))
    covariance = scatter(matrix) / n
    values, axes = np.linalg.eigh((covariance + covariance.T) / 2)
    values, axes = values[::-1], axes[:, ::-1]
    keep = int((values[:components] > LEAST_SHARE * max(values[0], 0)).sum()) if values[0] > 0 else 0
    fit = Whitening(n, total, values[:keep], axes[:, :keep], float(np.trace(covariance)))
    if not keep:
        return table.select("row", F.array().cast("array<double>").alias("whitened")), fit, 0.0
    white = project(matrix, fit.axes / np.sqrt(fit.values))
    found = callMLlibFunc("getIndexedRows", white.toIndexedRowMatrix()._java_matrix_wrapper._java_model).select("index", vector_to_array("vector").alias("whitened"))
    found = _lineage.table(found)
    of_whole = found.select(F.posexplode("whitened").alias("dimension", "x")).groupBy("dimension").agg(F.avg("x").alias("x")).orderBy("dimension")
    mean = np.array([r.x for r in of_whole.collect()])  # a row a component
    error = float(np.abs(scatter(white) / n - np.outer(mean, mean) - np.eye(keep)).max())
    return table.join(found, "index").select("row", "whitened"), fit, error
