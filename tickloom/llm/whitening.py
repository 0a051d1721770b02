"""Whitening of vectors with distributed block matrices.

Entries become whole numbers on a grid, so sums and centred values are exact:
with n vectors and sums S, n * x - S is a whole number, and a centred entry is
that over n. The centred rows get gapless indices and go into a BlockMatrix of
`ROWS_A_BLOCK` rows a block. Its transpose times itself is the scatter matrix,
whose middle dimension is cut into groups of blocks that are summed up in many
tasks. The scatter matrix has the size of a vector squared and is decomposed on
the driver; the block matrix times the whitening matrix (components over the
roots of their eigenvalues) gives all projections, which are written, joined
with their ids by index, and checked: their covariance has to be the identity.

To the driver go a row per dimension, a number per written file, matrices of
one vector's size, and, inside MLlib, the places of the blocks (one pair for
`ROWS_A_BLOCK` rows).

Defined cases: rows whose vector is null, empty, or holds null or non-finite
entries, or entries of 2^56 and more, take no part, nor do vectors whose length
is not the most common one (of equally common lengths the greatest). Rows with a
null or repeated id are whitened like any other. A component without variance (a constant dimension, equal or too few vectors) has
null whitened values, and explained 0, or null if nothing varies; the identity
is only asked of the others. A deviation beyond 64 bits is null. Other columns
are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg import DenseMatrix
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tickloom.llm.common import prepare, saved

SCALE = 64
OFFSET = 1_000_000
COMPONENTS = 32
ROWS_A_BLOCK = 1024
BLOCKS_A_SPLIT = 32
ROW_BITS = 33  # monotonically_increasing_id: the part above, the row in it below
# Entries from here on have no 64-bit whole number on the grid.
GREATEST = float(1 << 56)
# Eigenvalues below this share of the largest are rounding.
NO_VARIANCE = 1e-13


def on_grid(vectors: DataFrame, key: str, column: str) -> DataFrame:
    """id and x, the whole numbers floor(SCALE * entry) + OFFSET, of the vectors that take part."""
    v = F.col(column).cast("array<double>")
    usable = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < GREATEST))
    # Worked out once: the filter would otherwise be asked of each copy of the expression.
    whole = F.transform(F.when(usable, v), lambda c: F.floor(c * SCALE).cast("long") + OFFSET)
    return vectors.select(F.col(key).cast("long").alias("id"), whole.alias("x")).where("x is not null")


def numbered(df: DataFrame, label: str) -> DataFrame:
    """The rows as a table with gapless numbers `index`, in no particular order, without a shuffle."""
    rows = saved(df.withColumn("place", F.monotonically_increasing_id()), label)
    rows = rows.withColumn("part", F.shiftright("place", ROW_BITS))
    starts, before = [], 0
    for part, n in sorted((r.part, r.n) for r in rows.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()):
        starts.append((part, before))
        before += n
    begin = df.sparkSession.createDataFrame(starts or [(0, 0)], "part long, begin long")
    index = F.col("begin") + F.col("place").bitwiseAND((1 << ROW_BITS) - 1)
    return rows.join(F.broadcast(begin), "part").select(index.alias("index"), *df.columns)


def _array(values: list, kind: str) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast(f"array<{kind}>")


def block_matrix(rows: DataFrame, column: str, n: int, width: int) -> BlockMatrix:
    """Rows `index` and an array of doubles as distributed blocks, made in the JVM."""
    vectors = rows.select("index", array_to_vector(F.col(column)).alias("vector"))
    indexed = IndexedRowMatrix(MLUtils.convertVectorColumnsFromML(vectors, "vector"), n, width)
    return indexed.toBlockMatrix(ROWS_A_BLOCK, width)


def scatter(matrix: BlockMatrix) -> np.ndarray:
    """Transpose times matrix. The rows are its middle dimension, dealt to many
    tasks whose sums are added up (the Scala method takes their number)."""
    splits = max(1, -(-matrix.numRowBlocks // BLOCKS_A_SPLIT))
    turned, plain = matrix.transpose(), matrix._java_matrix_wrapper._java_model
    product = turned._java_matrix_wrapper.call("multiply", plain, splits)
    return BlockMatrix(product, turned.rowsPerBlock, matrix.colsPerBlock).toLocalMatrix().toArray()


def components(covariance: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Eigenvalues by falling size, the whitening matrix of the first `top`, and which of these vary."""
    values, vectors = np.linalg.eigh((covariance + covariance.T) / 2)
    values, vectors = values[::-1][:top], vectors[:, ::-1][:, :top]
    varies = values > NO_VARIANCE * max(values.max(initial=0.0), 0.0)
    return values, np.where(varies, vectors / np.sqrt(np.where(varies, values, 1.0)), 0.0), varies


def projected(matrix: BlockMatrix, whitening: np.ndarray, spark: SparkSession) -> DataFrame:
    """index and whitened, the rows of the matrix times the whitening matrix."""
    d, k = whitening.shape
    own = spark.sparkContext.parallelize([((0, 0), DenseMatrix(d, k, whitening.ravel(order="F").tolist()))], 1)
    product = matrix.multiply(BlockMatrix(own, matrix.colsPerBlock, k))

    def rows(block: tuple) -> Iterator[tuple[int, list[float]]]:
        (at, _), values = block
        return ((at * ROWS_A_BLOCK + i, row) for i, row in enumerate(values.toArray().tolist()))

    return spark.createDataFrame(product.blocks.flatMap(rows), "index long, whitened array<double>")


def identity_error(rows: DataFrame, n: int, varies: np.ndarray) -> float | None:
    """Largest absolute entry of the covariance of `whitened` minus the identity."""
    k = len(varies)
    if not varies.any():
        return None
    mean = np.array(rows.agg(F.array(*[F.avg(F.col("whitened")[i]) for i in range(k)])).first()[0])
    schema = pa.schema([("i", pa.int32()), ("total", pa.list_(pa.float64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, k))
        for batch in batches:
            values = batch.column("whitened").flatten().to_numpy(zero_copy_only=False).reshape(-1, k) - mean
            total += values.T @ values
        yield pa.RecordBatch.from_arrays([pa.array(range(k), pa.int32()), pa.array(total.tolist(), schema.field(1).type)], schema=schema)

    parts = rows.select("whitened").mapInArrow(run, "i int, total array<double>")
    sums = parts.groupBy("i").agg(F.array(*[F.sum(F.col("total")[j]) for j in range(k)]).alias("total")).orderBy("i")
    covariance = np.array([r.total for r in sums.collect()]) / n
    return float(np.abs(covariance - np.eye(k))[np.ix_(varies, varies)].max())


RESULT = "id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(vectors: DataFrame, key: str = "vec_id", column: str = "embedding", top: int = COMPONENTS) -> DataFrame:
    """One row per vector and component: id, component (from 1), n, deviation (the
    sum of (n * x - S)^2 over dimensions, exact), whitened, explained (the share of
    the variance) and identity_error."""
    spark = prepare(vectors.sparkSession)
    rows = numbered(on_grid(vectors, key, column).withColumn("width", F.size("x")), "whitening-grid")
    largest = F.max(F.array_max(F.transform("x", lambda x: F.abs(x)))).alias("largest")
    common = rows.groupBy("width").agg(F.count(F.lit(1)).alias("n"), largest).orderBy(F.desc("n"), F.desc("width")).first()
    if common is None:
        return spark.createDataFrame([], RESULT)
    width, n, largest = common
    # Sums and centred values are exact: in 64 bits where these hold them, else as decimals.
    exact = "bigint" if 2 * n * largest < 1 << 62 else "decimal(38,0)"
    if rows.where(F.col("width") != width).limit(1).count():
        rows = numbered(rows.where(F.col("width") == width).drop("index"), "whitening-rows")
    sums = rows.select(F.posexplode("x").alias("at", "x")).groupBy("at").agg(F.sum(F.col("x").cast(exact)).alias("s")).orderBy("at").collect()
    apart = F.zip_with("x", _array([int(r.s) for r in sums], exact), lambda x, s: (x.cast(exact) * F.lit(n).cast("long") - s).cast(exact))
    squares = F.aggregate("apart", F.lit(0).cast(exact), lambda total, v: F.try_add(total, F.try_multiply(v, v)).cast(exact)).try_cast("long")
    rows = rows.withColumn("apart", apart)
    centred = rows.select("index", F.transform("apart", lambda v: v.cast("double") / F.lit(float(n))).alias("centred"))
    # Asked for by three products. A lost block is made again from the rows.
    matrix = block_matrix(centred, "centred", n, width).persist(StorageLevel.MEMORY_AND_DISK)
    covariance = scatter(matrix) / n
    values, whitening, varies = components(covariance, min(top, width))
    trace = float(np.trace(covariance))
    found = projected(matrix, whitening, spark)
    ids = rows.select("index", "id", squares.alias("deviation"))
    white = saved(ids.join(found, "index").select("id", "deviation", "whitened"), "whitening-rows")
    error = identity_error(white, n, varies)
    share = [max(v, 0.0) / trace if trace > 0 else None for v in values.tolist()]
    long = white.select("id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return long.select(
        "id",
        (F.col("at") + 1).alias("component"),
        F.lit(n).cast("long").alias("n"),
        "deviation",
        F.when(F.get(_array(varies.tolist(), "boolean"), F.col("at")), F.col("whitened")).alias("whitened"),
        F.get(_array(share, "double"), F.col("at")).alias("explained"),
        F.lit(error).cast("double").alias("identity_error"),
    )
