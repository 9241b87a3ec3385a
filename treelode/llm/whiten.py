"""Embeddings whitened over their principal components, with MLlib's block matrices.

1. Vectors become whole numbers.  The fit list holds each distinct vector once; its length and sums
   are exact.
2. Its centred rows are numbered and laid out as a BlockMatrix.  The transpose times the matrix is
   the scatter matrix: blocks of rows are multiplied in their tasks and summed pairwise.
3. The scatter matrix has one row per dimension.  Its eigenvectors are found on the driver, and the
   whitening matrix made of them is a BlockMatrix of its own.
4. All rows, centred and numbered, are multiplied by it.  A row number brings the projections back
   to their ids, so frequent vectors meet nowhere.

A fit of this kind is the whole result for any number of rows; the driver holds two square matrices
of the vectors' width.
"""

from __future__ import annotations

import numpy as np
from pyspark import StorageLevel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import Matrices
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treelode.llm.common import Scratch
from treelode.operators.numbering import with_dense_numbers

#: Rows and columns of a block.
BLOCK_ROWS, BLOCK_COLUMNS = 1024, 512
#: Components below this share of the trace are noise and not returned.
LEAST_SHARE = 1e-12


def whole_vectors(vectors: DataFrame, id_column: str, vector_column: str, scale: int) -> DataFrame:
    """id, x: floor(scale * c) of each component; rows without a whole finite vector are left out."""
    v = F.col(vector_column)
    finite = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    x = F.transform(v, lambda c: F.floor(F.lit(float(scale)) * c.cast("double")).cast("long"))
    return vectors.where(v.isNotNull() & finite).select(F.col(id_column).alias("id"), x.alias("x"))


def padded(width: int) -> Column:
    missing = F.lit(width) - F.size("x")
    return F.concat("x", F.array_repeat(F.lit(0).cast("long"), missing))


def deviation(n: int, sums: list[int]) -> Column:
    """Sum of (n * x - sum) squared over the dimensions, in whole numbers; null beyond a long."""
    centre = F.array(*(F.lit(s).cast("long") for s in sums))
    far = F.zip_with("x", centre, lambda x, s: F.try_subtract(F.try_multiply(F.lit(n).cast("long"), x), s))
    return F.aggregate(far, F.lit(0).cast("long"), lambda total, d: F.try_add(total, F.try_multiply(d, d)))


def block_matrix(rows: DataFrame, n: int, sums: list[int]) -> BlockMatrix:
    """Rows ``index, x`` minus the mean, in blocks."""
    centre = F.array(*(F.lit(s).cast("double") for s in sums))
    exact = F.zip_with("x", centre, lambda x, s: (x.cast("double") * n - s) / n)
    indexed = MLUtils.convertVectorColumnsFromML(rows.select("index", array_to_vector(exact).alias("vector")), "vector")
    return IndexedRowMatrix(indexed).toBlockMatrix(BLOCK_ROWS, min(BLOCK_COLUMNS, len(sums)))


def product(left: BlockMatrix, right: BlockMatrix, splits: int) -> BlockMatrix:
    """left * right, the sum over the shared dimension taken in ``splits`` parts at once."""
    model = left._java_matrix_wrapper._java_model.multiply(right._java_matrix_wrapper._java_model, splits)
    return BlockMatrix(model, left.rowsPerBlock, right.colsPerBlock)


def square_of(matrix: BlockMatrix, splits: int) -> np.ndarray:
    """transpose(matrix) * matrix, a local square of the matrix's width."""
    return product(matrix.transpose(), matrix, splits).toLocalMatrix().toArray()


def local_blocks(spark, matrix: np.ndarray, block_rows: int) -> BlockMatrix:
    """A small matrix as one column of blocks."""
    width = matrix.shape[1]
    parts = [
        ((i // block_rows, 0), Matrices.dense(len(part), width, part.ravel(order="F").tolist()))
        for i in range(0, len(matrix), block_rows)
        for part in [matrix[i : i + block_rows]]
    ]
    return BlockMatrix(spark.sparkContext.parallelize(parts, 1), block_rows, width, *matrix.shape)


def row_frame(matrix: BlockMatrix) -> DataFrame:
    """index, y of a block matrix."""
    rows = callMLlibFunc("getIndexedRows", matrix.toIndexedRowMatrix()._java_matrix_wrapper._java_model)
    return rows.select("index", vector_to_array("vector").alias("y"))


def whiten(
    vectors: DataFrame, components: int = 4, scale: int = 256, id_column: str = "vec_id", vector_column: str = "embedding",
) -> DataFrame:
    """id, component, n, deviation, whitened, explained, identity_error of each row and component.

    Rows whose vector is null or holds null or non-finite entries are left out; null and repeated ids
    are kept, each row getting its result.  Shorter vectors are filled with zeros.  Components without
    variance are not returned, so one distinct vector, or none, gives no rows.  Entries beyond a long
    are cut to it, and a ``deviation`` beyond a long is null.  Other columns are ignored.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "whiten")
    empty = spark.createDataFrame([], vectors.select(F.col(id_column)).schema).select(
        id_column, *(F.lit(None).cast(kind).alias(c) for c, kind in (
            ("component", "int"), ("n", "long"), ("deviation", "long"), ("whitened", "double"), ("explained", "double"), ("identity_error", "double"))),
    )
    rows = whole_vectors(vectors, id_column, vector_column, scale)
    width = rows.agg(F.max(F.size("x"))).first()[0] or 0
    if width == 0:
        return empty
    rows = with_dense_numbers(rows.select("id", padded(width).alias("x")), "index", lambda df: scratch.save(df, "rows"))
    fit = with_dense_numbers(rows.select("x").distinct(), "index", lambda df: scratch.save(df, "fit"))
    sums = fit.agg(F.count(F.lit(1)), *(F.sum(F.get("x", F.lit(i))) for i in range(width))).first()
    n, sums = int(sums[0]), [int(s) for s in sums[1:]]

    splits = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), n // BLOCK_ROWS))
    centred = block_matrix(fit, n, sums)
    centred.persist(StorageLevel.MEMORY_AND_DISK)
    covariance = square_of(centred, splits) / n
    values, axes = np.linalg.eigh((covariance + covariance.T) / 2)
    trace = float(np.trace(covariance))
    best = [i for i in np.argsort(-values)[:components] if values[i] > LEAST_SHARE * trace]
    if not best:
        return empty
    matrix = local_blocks(spark, axes[:, best] / np.sqrt(values[best]), min(BLOCK_COLUMNS, width))
    off = np.abs(square_of(product(centred, matrix, 1), splits) / n - np.eye(len(best)))
    centred._java_matrix_wrapper._java_model.blocks().unpersist(False)
    projected = row_frame(product(block_matrix(rows, n, sums), matrix, 1))
    of_component = F.array(*(F.struct(F.lit(c + 1).alias("component"), F.lit(float(values[i] / trace)).alias("explained")) for c, i in enumerate(best)))
    out = rows.select("index", "id", deviation(n, sums).alias("deviation")).join(projected, "index")
    out = out.select("id", "deviation", "y", F.explode(of_component).alias("c"))
    return out.select(
        F.col("id").alias(id_column), "c.component", F.lit(n).cast("long").alias("n"), "deviation",
        F.get("y", F.col("c.component") - 1).alias("whitened"), "c.explained", F.lit(float(off.max())).alias("identity_error"),
    )
