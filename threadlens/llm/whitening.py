"""Embedding whitening with MLlib's distributed BlockMatrix.

Centred rows are indexed into blocks of 1,024 rows; the transposed matrix times the matrix is their scatter, whose eigenvectors
are found on the driver (dimensions squared); the matrix times the whitening matrix projects every row.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark import SparkContext
from pyspark.ml.functions import vector_to_array
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import Matrices, MatrixUDT
from pyspark.mllib.linalg.distributed import BlockMatrix
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from threadlens.llm.common import stored
from threadlens.session import materialize

SCALE, SHIFT = 1024, 100_000
COMPONENTS = 8
BLOCK = 1024
#: Row blocks that one task multiplies; the product has as many tasks as this makes of the blocks.
BLOCKS_A_TASK = 64
#: Directions with less than this share of the variance cannot be scaled to 1 and are no components.
FLAT = 1e-12


@dataclass
class Whitening:
    """What is fitted: ``n`` rows, exact ``sums`` by dimension, eigenvalues by falling size, eigenvectors in columns."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float


def integer_rows(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE,
                 shift: int = SHIFT) -> DataFrame:
    """``id, x, uid``, stored: components c as floor(scale * c) + shift.

    Null vectors and those with a null, NaN or infinite entry are left out, and so are vectors of another length than the
    commonest one (ties: the longer one) and empty ones. ``uid`` counts the rows of each part without gaps.
    """
    v = F.col(vector_col)
    finite = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    kept = vectors.where((F.size(v) > 0) & finite)
    size = kept.groupBy(F.size(v).alias("dims")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("dims")).first()
    x = F.transform(v, lambda c: F.floor(c.cast("double") * scale) + shift)
    return stored(kept.where(F.size(v) == (size.dims if size else 0))
                  .select(F.col(id_col).alias("id"), x.alias("x"), F.monotonically_increasing_id().alias("uid")), "integers")


def sums_of(rows: DataFrame) -> tuple[int, list[int]]:
    """Row count and exact sums by dimension (in 64 bits where that holds them, else in decimals)."""
    first = rows.select(F.size("x").alias("d")).first()
    dims = [F.col("x")[k] for k in range(first.d if first else 0)]
    n, *sums = rows.agg(F.count("*"), *[F.try_sum(x) for x in dims]).first()
    if any(s is None for s in sums):
        n, *sums = rows.agg(F.count("*"), *[F.sum(x.cast("decimal(38,0)")) for x in dims]).first()
    return n, [int(s) for s in sums]


def numbered(rows: DataFrame) -> DataFrame:
    """Add ``at``, the numbers 0, 1, ... without gaps: a row's place in its part (``uid`` below 33 bits) after the parts before it."""
    part = F.shiftright("uid", 33)
    sizes = rows.groupBy(part.alias("part")).agg(F.count("*").alias("size"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("part", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("before"))
    placed = rows.withColumn("part", part).join(stored(sizes, "parts"), "part")      # one row for each part
    return placed.withColumn("at", F.col("before") + F.col("uid").bitwiseAND((1 << 33) - 1)).drop("part", "before")


def blocks_of(rows: DataFrame, n: int, sums: list[int]) -> BlockMatrix:
    """The centred rows (n * x - sum, exact, then divided by n) in blocks of :data:`BLOCK`, by their number ``at``.

    Blocks are grouped as rows of a table and stored in the form that MLlib reads as matrices, so they are built once, and each
    product reads them again.
    """
    dims, totals = len(sums), F.array(*[F.lit(s) for s in sums])
    packed = rows.groupBy(F.floor(F.col("at") / BLOCK).alias("i")).agg(F.sort_array(F.collect_list(F.struct("at", "x"))).alias("rows"))
    values = F.flatten(F.transform("rows", lambda r: F.zip_with(r["x"], totals, lambda x, s: (x * n - s).cast("double") / n)))
    none = F.lit(None).cast("array<int>")
    matrix = F.struct(F.lit(1).cast("tinyint").alias("type"), F.size("rows").alias("numRows"), F.lit(dims).alias("numCols"),
                      none.alias("colPtrs"), none.alias("rowIndices"), values.alias("values"), F.lit(True).alias("isTransposed"))
    place = F.struct("i", F.lit(0).cast("long").alias("j"))
    table = materialize(packed.select(place.alias("place"), matrix.alias("block")), "blocks", read_as={"block": MatrixUDT()})
    return BlockMatrix(callMLlibFunc("createBlockMatrix", table, BLOCK, dims, n, dims), BLOCK, dims)


def _times(left: BlockMatrix, right: BlockMatrix, splits: int) -> BlockMatrix:
    """The product; ``splits`` is the number of tasks that share the sum over the inner dimension (Python's own call has one)."""
    product = left._java_matrix_wrapper.call("multiply", right._java_matrix_wrapper._java_model, splits)
    return BlockMatrix(product, left.rowsPerBlock, right.colsPerBlock)


def gram(matrix: BlockMatrix) -> np.ndarray:
    """Transposed ``matrix`` times ``matrix`` (columns squared) on the driver."""
    splits = -(-matrix.numRowBlocks // BLOCKS_A_TASK)
    product = _times(matrix.transpose(), matrix, splits).toLocalMatrix().toArray()
    return (product + product.T) / 2


def _fit(blocks: BlockMatrix, n: int, sums: list[int]) -> Whitening:
    values, vectors = np.linalg.eigh(gram(blocks) / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    return Whitening(n, sums, values, vectors, float(values.sum()))


def _project(blocks: BlockMatrix, model: Whitening, components: int) -> BlockMatrix:
    """The blocks times the whitening matrix: eigenvectors over the roots of their eigenvalues."""
    scaled = model.vectors[:, :components] / np.sqrt(model.values[:components])
    right = SparkContext.getOrCreate().parallelize([((0, 0), Matrices.dense(*scaled.shape, scaled.ravel("F")))], 1)
    return _times(blocks, BlockMatrix(right, scaled.shape[0], components), 1)


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS,
           scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """``id_col, component, n, deviation, whitened, explained, identity_error`` for each kept row and component (from 1).

    ``deviation`` is an exact decimal(38,0). Repeated rows count as often as they occur and null ids stay. Other columns are not
    read. There are fewer components where the vectors have fewer dimensions or vary in fewer directions; none (and no rows) for an
    empty table or equal vectors. The driver holds matrices of dimensions squared and one sum for each dimension.
    """
    spark, kind = vectors.sparkSession, vectors.schema[id_col].dataType.simpleString()
    rows = integer_rows(vectors, id_col, vector_col, scale, shift)
    n, sums = sums_of(rows)
    shape = f"`{id_col}` {kind}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    if n == 0:
        return spark.createDataFrame([], shape)
    rows = numbered(rows)
    blocks = blocks_of(rows, n, sums)
    model = _fit(blocks, n, sums)
    used = int((model.values[:components] > FLAT * max(model.trace, 0.0)).sum()) if model.trace > 0 else 0
    if used == 0:
        return spark.createDataFrame([], shape)
    projected = _project(blocks, model, used)
    error = float(np.abs(gram(projected) / n - np.eye(used)).max())
    indexed = projected.toIndexedRowMatrix()    # held: the JVM's matrix goes with Python's
    white = callMLlibFunc("getIndexedRows", indexed._java_matrix_wrapper._java_model)
    white = white.select(F.col("index").alias("at"), vector_to_array("vector").alias("w"))
    away = F.zip_with("x", F.array(*[F.lit(s) for s in sums]), lambda x, s: (x * n - s).cast("decimal(19,0)"))
    deviation = F.aggregate(away, F.lit(0).cast("decimal(38,0)"), lambda a, d: (a + (d * d).cast("decimal(38,0)")).cast("decimal(38,0)"))
    out = rows.select("id", "at", deviation.alias("deviation")).join(white, "at").select("id", "deviation", F.posexplode("w").alias("k", "whitened"))
    share = F.array(*[F.lit(float(v / model.trace)) for v in model.values[:used]])
    return out.select(F.col("id").alias(id_col), (F.col("k") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened",
                      share[F.col("k")].alias("explained"), F.lit(error).alias("identity_error"))
