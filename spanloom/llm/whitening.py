"""Whitening of embeddings with distributed block matrices.

Centred rows get a running index and are cut into blocks of a ``BlockMatrix``.  Its
transpose times itself is the scatter, a small matrix of the dimension squared; its
eigenvectors come from a local ``eigh``, and a second block multiplication, with the
eigenvectors over the roots of the eigenvalues, projects all rows.  The same scatter of
the projected rows tells how far they are from white.

The product that gives the scatter is cut along the rows (``numMidDimSplits``), since all
of it belongs to one block of the result and would be one task's work otherwise.  The
driver holds matrices of the dimension squared and one key a block, of which there are
about ``KEYS`` at most, as blocks grow with the table up to ``CELLS`` numbers.

Defined results: vectors that are null, empty, hold null or non-finite components or such
of 2**52 and more, or have another length than most, take no part; rows with the same
vec_id and null ones count each on their own; a component without variance (fewer rows than
dimensions, equal vectors) has a null whitened value and no part in the error, and explains
0; vectors of fewer than 8 dimensions have as many components; an empty table gives no
rows; columns besides vec_id and embedding are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark import StorageLevel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import Matrices
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame, SparkSession, functions as F

from spanloom.llm.common import stored
from spanloom.llm.whole_vectors import whole_vectors

OFFSET, COMPONENTS = 100_000, 8
# Rows of a block: 1,024, and more where the table would have more blocks than KEYS, within CELLS numbers a block.
ROWS, KEYS, CELLS, COLUMNS = 1_024, 1 << 16, 1 << 22, 1_024
# Blocks whose products one task of the scatter adds up.
SUMMED = 16
# An eigenvalue below this share of the trace, a dimension, is rounding only.
FLAT = 1e-13

EXACT = "decimal(38,0)"


@dataclass(frozen=True)
class Whitener:
    """What the fit list says: its size, sums and mean, and unit eigenvectors (columns) by falling eigenvalue."""

    n: int
    sums: list[int]
    mean: np.ndarray
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    def varied(self) -> np.ndarray:
        return self.values > FLAT * len(self.sums) * self.trace

    def projection(self, components: int) -> np.ndarray:
        """dimension x components; a component without variance is a column of zeros."""
        varied = self.varied()[:components]
        roots = np.sqrt(np.where(varied, self.values[:components], 1.0))
        return self.vectors[:, :components] * (varied / roots)


def indexed(rows: DataFrame) -> DataFrame:
    """``rows`` with an index: parts one after another, each by its places."""
    part, place = F.shiftright("row_id", 33), F.col("row_id").bitwiseAND((1 << 33) - 1)
    ends = rows.groupBy(part.alias("part")).agg((F.max(place) + 1).alias("n")).orderBy("part").collect()
    starts = np.concatenate([[0], np.cumsum([r["n"] for r in ends])]).tolist()
    offsets = rows.sparkSession.createDataFrame(
        [(r["part"], start) for r, start in zip(ends, starts)], "part long, start long")
    return rows.withColumn("part", part).join(offsets, "part").withColumn("index", F.col("start") + place).drop("part", "start")


def block_matrix(rows: DataFrame, values: str, n: int, dim: int) -> BlockMatrix:
    """The rows (index, array of doubles) in blocks; an index without row is a row of zeros."""
    per_block = int(np.clip(-(-n // KEYS), ROWS, max(CELLS // dim, ROWS)))
    named = rows.select("index", array_to_vector(values).alias("vector"))
    # Held, since the transpose, the product's layout and the projection all read the blocks; lost ones are cut again.
    return IndexedRowMatrix(MLUtils.convertVectorColumnsFromML(named, "vector")).toBlockMatrix(
        per_block, min(dim, COLUMNS)).persist(StorageLevel.MEMORY_AND_DISK)


def released(matrix: BlockMatrix) -> None:
    matrix._java_matrix_wrapper.call("blocks").unpersist(False)


def scatter(matrix: BlockMatrix) -> np.ndarray:
    """Transpose times matrix, of the dimension squared."""
    splits = max(1, -(-(matrix.numRows() // matrix.rowsPerBlock + 1) // SUMMED))
    product = matrix.transpose()._java_matrix_wrapper.call("multiply", matrix._java_matrix_wrapper._java_model, splits)
    return BlockMatrix(product, matrix.colsPerBlock, matrix.colsPerBlock).toLocalMatrix().toArray()


def projected(matrix: BlockMatrix, weights: np.ndarray) -> DataFrame:
    """index and values of matrix times weights."""
    sc, tall = SparkSession.active().sparkContext, matrix.colsPerBlock
    blocks = [((k // tall, 0), Matrices.dense(*w.shape, w.ravel(order="F").tolist()))
              for k in range(0, len(weights), tall) for w in [weights[k : k + tall]]]
    right = BlockMatrix(sc.parallelize(blocks, 1), tall, weights.shape[1], *weights.shape)
    # Named, since a wrapper that nothing holds any more has its matrix freed in the JVM, perhaps before the call comes.
    product = matrix.multiply(right).toIndexedRowMatrix()
    rows = callMLlibFunc("getIndexedRows", product._java_matrix_wrapper._java_model)
    return rows.select("index", vector_to_array("vector").alias("values"))


def column_sums(rows: DataFrame, column: str, kind: str) -> list:
    added = rows.select(F.posexplode(column).alias("place", "v")).groupBy("place").agg(F.sum(F.col("v").cast(kind)).alias("s"))
    return [r["s"] for r in added.orderBy("place").collect()]


def fit(rows: DataFrame, n: int) -> tuple[Whitener, BlockMatrix]:
    """The whitener of indexed rows (x), and their centred blocks."""
    sums = [int(s) for s in column_sums(rows, "x", "decimal(20,0)")]
    totals = F.array(*[F.lit(s).cast("long") for s in sums])
    centred = rows.select("index", F.zip_with("x", totals, lambda x, s: (x * n - s) / F.lit(float(n))).alias("values"))
    matrix = block_matrix(centred, "values", n, len(sums))
    covariance = scatter(matrix) / n
    values, vectors = np.linalg.eigh((covariance + covariance.T) / 2)
    values, vectors = values[::-1].clip(min=0.0), vectors[:, ::-1]
    vectors = vectors * np.where(vectors[np.abs(vectors).argmax(axis=0), range(len(sums))] < 0, -1.0, 1.0)
    return Whitener(n, sums, np.array([s / n for s in sums]), values, vectors, float(values.sum())), matrix


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """vec_id, component (from 1), n, deviation (decimal, exact), whitened, explained, identity_error.

    x is floor(1024 * component) + 100,000; deviation is the sum over dimensions of
    (n * x - S) squared.
    """
    spark = vectors.sparkSession
    rows, n, dim = whole_vectors(vectors, "whitening", OFFSET)
    kind = dict(vectors.dtypes)["vec_id"]
    if not n:
        return spark.createDataFrame([], f"vec_id {kind}, component int, n long, deviation {EXACT}, whitened double, "
                                         "explained double, identity_error double")
    rows = indexed(rows)
    whitener, matrix = fit(rows, n)
    k = min(components, dim)
    white = stored(projected(matrix, whitener.projection(k)), "whitened").join(rows.select("index"), "index")
    released(matrix)

    means = F.array(*[F.lit(s / n) for s in column_sums(white, "values", "double")])
    again = white.select("index", F.zip_with("values", means, lambda v, m: v - m).alias("values"))
    matrix = block_matrix(again, "values", n, k)
    off = np.abs(scatter(matrix) / n - np.eye(k))
    released(matrix)
    varied = whitener.varied()[:k]
    error = float(off[np.ix_(varied, varied)].max(initial=0.0))

    totals = F.array(*[F.lit(s).cast("long") for s in whitener.sums])
    squares = F.zip_with("x", totals, lambda x, s: F.try_multiply(
        x.cast("decimal(20,0)") * F.lit(n).cast("decimal(17,0)") - s, x.cast("decimal(20,0)") * F.lit(n).cast("decimal(17,0)") - s))
    deviation = F.aggregate(squares, F.lit(0).cast(EXACT), lambda a, v: F.try_add(a, v).cast(EXACT))
    share = F.array(*[F.lit(float(v / whitener.trace) if there else 0.0) for v, there in zip(whitener.values[:k], varied)])
    shown = F.array(*[F.lit(bool(there)) for there in varied])
    return rows.select("index", "vec_id", deviation.alias("deviation")).join(white, "index").select(
        "vec_id", "deviation", F.posexplode("values").alias("place", "value")).select(
        "vec_id", (F.col("place") + 1).cast("int").alias("component"), F.lit(n).cast("long").alias("n"), "deviation",
        F.when(shown[F.col("place")], F.col("value")).alias("whitened"), share[F.col("place")].alias("explained"),
        F.lit(error).alias("identity_error"))
