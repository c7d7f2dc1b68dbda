"""Whitening of embeddings by distributed block matrices.

Centred rows are indexed into blocks, the transposed blocks times the blocks give the
scatter matrix, its eigenvectors (one small matrix, in the driver) scaled to unit
variance are the whitening matrix, and the blocks times that are the whitened rows.
"""

import numpy as np
from pyspark import StorageLevel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import DenseMatrix
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import functions as F

from pairscreen.session import materialise, parallelism

#: Rows of one block; a block of 1,024 doubles a row has 8 MB.
BLOCK_ROWS = 1_024
#: Added to every whole number; it leaves the centred rows as they are.
_SHIFT = 1_000_000

_RESULT = "component int, n long, deviation long, whitened double, explained double, identity_error double"


def usable(rows, vector_col):
    """Rows with a vector, whose entries are all there and finite."""
    v = F.col(vector_col)
    whole = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return rows.where(v.isNotNull() & (F.size(v) > 0) & whole)


def whole_numbers(vector, scale):
    return F.transform(vector, lambda c: F.floor(c.cast("double") * scale).cast("long") + _SHIFT)


def indexed(rows):
    """``rows`` with ``index`` from 0 without gaps, in the order of a written table, so
    that it is the same whenever it is read.  One number per partition is collected."""
    rows = materialise(rows, "vectors")
    place = F.monotonically_increasing_id()
    numbered = rows.select("*", F.shiftright(place, 33).alias("part"), place.bitwiseAND((1 << 33) - 1).alias("place"))
    numbered = materialise(numbered, "numbered")
    sizes = numbered.groupBy("part").agg(F.count(F.lit(1)).alias("rows")).orderBy("part").collect()
    ends = np.cumsum([r["rows"] for r in sizes]).tolist()
    before = rows.sparkSession.createDataFrame(
        [(r["part"], e - r["rows"]) for r, e in zip(sizes, ends)], "part long, before long"
    )
    found = numbered.join(F.broadcast(before), "part").withColumn("index", F.col("before") + F.col("place"))
    return found.drop("part", "place", "before"), (ends[-1] if ends else 0)


def blocks_of(rows, n, dim):
    """Rows ``index`` and ``centred`` (doubles) as a block matrix; no Python worker."""
    vectors = rows.select("index", array_to_vector("centred").alias("vector"))
    vectors = MLUtils.convertVectorColumnsFromML(vectors, "vector")
    matrix = IndexedRowMatrix(callMLlibFunc("createIndexedRowMatrix", vectors, n, dim))
    return matrix.toBlockMatrix(BLOCK_ROWS, dim)


def _multiply(spark, a, b, splits):
    """``a`` times ``b``.  The product of tall matrices is one block: without splits of
    the middle dimension one task would take in all rows."""
    product = a._java_matrix_wrapper.call("multiply", b._java_matrix_wrapper._java_model, splits)
    return BlockMatrix(product, a.rowsPerBlock, b.colsPerBlock)


def scatter(spark, blocks, n):
    """Transpose times the matrix itself, a small matrix."""
    splits = max(1, min(-(-n // BLOCK_ROWS), 4 * parallelism(spark)))
    return _multiply(spark, blocks.transpose(), blocks, splits).toLocalMatrix().toArray()


def whiten(table, id_col="vec_id", vector_col="embedding", scale=64, components=32):
    """Whitened projections on the first ``components`` principal axes: one row for
    each usable row and axis, with ``id_col``, ``component`` (from 1, by falling
    variance), ``n`` (the rows), ``deviation`` (the exact sum over dimensions of
    (n x - S) ** 2), ``whitened``, ``explained`` (share of the variance) and
    ``identity_error`` (largest entry of the whitened rows' covariance minus the
    identity, the same everywhere).

    Entries become whole numbers ``x = floor(scale * c)`` plus a constant; ``S`` are
    their sums.  Covariances have the divisor ``n`` and take centred rows.

    Rows whose vector is null or empty or holds a null or an infinite or undefined entry
    are left out.  All others must be of one length, else the job fails, as it does if
    whole numbers or ``deviation`` leave 64 bits.  An axis without variance (constant
    dimensions, fewer rows than dimensions) projects to 0 and is left out of
    ``identity_error``; with no variance at all ``explained`` is 0 too.  Null and
    repeated ids each come back, a table without usable rows gives none, other columns
    are ignored.
    """
    spark = table.sparkSession
    rows = usable(table.select(table[id_col].alias("id"), table[vector_col].alias("vector")), "vector")
    rows, n = indexed(rows.select("id", whole_numbers(F.col("vector"), scale).alias("x")))
    if not n:
        kind = dict(table.dtypes)[id_col]
        return spark.createDataFrame([], f"id {kind}, {_RESULT}").withColumnRenamed("id", id_col)
    sums = rows.select(F.posexplode("x").alias("d", "c")).groupBy("d").agg(F.sum("c").alias("s"), F.count(F.lit(1)).alias("k"))
    sums = sorted(sums.collect())
    if any(r["k"] != n for r in sums):
        raise ValueError("vectors differ in length")
    dim = len(sums)
    total = F.array(*(F.lit(r["s"]) for r in sums))
    apart = F.zip_with("x", total, lambda x, s: x * n - s)
    rows = rows.select(
        "id",
        "index",
        F.aggregate(apart, F.lit(0).cast("long"), lambda a, c: a + c * c).alias("deviation"),
        F.transform(apart, lambda c: c.cast("double") / n).alias("centred"),
    )
    rows = materialise(rows, "centred")
    blocks = blocks_of(rows, n, dim).persist(StorageLevel.MEMORY_AND_DISK)
    values, axes = np.linalg.eigh(scatter(spark, blocks, n) / n)
    values, axes = values[::-1], axes[:, ::-1]
    k = min(components, dim)
    trace = values.sum()
    real = values[:k] > max(trace, 0) * dim * np.finfo(float).eps
    scale_of = np.where(real, 1 / np.sqrt(np.where(real, values[:k], 1)), 0)
    matrix = DenseMatrix(dim, k, (axes[:, :k] * scale_of).flatten(order="F"))
    whitening = BlockMatrix(spark.sparkContext.parallelize([((0, 0), matrix)], 1), dim, k)
    projected = _multiply(spark, blocks, whitening, 1).persist(StorageLevel.MEMORY_AND_DISK)
    error = scatter(spark, projected, n) / n - np.eye(k)
    error = float(np.abs(error[np.ix_(real, real)]).max(initial=0.0))
    found = callMLlibFunc("getIndexedRows", projected.toIndexedRowMatrix()._java_matrix_wrapper._java_model)
    found = found.select("index", vector_to_array(found.columns[1]).alias("whitened"))
    found = materialise(found, "whitened")
    for kept in (blocks, projected):
        kept._java_matrix_wrapper._java_model.blocks().unpersist(False)
    share = [float(max(v, 0.0) / trace) if trace > 0 else 0.0 for v in values[:k]]
    met = rows.select("id", "index", "deviation").join(found, "index")
    return met.select("id", "deviation", F.posexplode("whitened").alias("at", "whitened")).select(
        F.col("id").alias(id_col),
        (F.col("at") + 1).alias("component"),
        F.lit(n).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.array(*map(F.lit, share))[F.col("at")].alias("explained"),
        F.lit(error).alias("identity_error"),
    )
