"""Embedding whitening: distributed block matrices give the scatter, a local eigenproblem the directions, and a block product the projections."""

from __future__ import annotations

import math

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import DenseMatrix
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

#: Entries become integers: this many steps to one, and this many added.
STEPS = 1024
SHIFT = 100_000

#: Components that are returned at most.
COMPONENTS = 8

#: Dimensions of a vector at most: the scatter of so many, 128 MB, is solved on the driver.
MOST_DIMENSIONS = 4096

#: Bytes of a block of rows, blocks of one partial product, and blocks of rows at most.
BLOCK_BYTES = 1 << 20
BLOCKS_TOGETHER = 4
MOST_BLOCKS = 1 << 16

#: An integer beyond this has no exact double.
EXACT = 1 << 53

SCHEMA = "component int, n long, deviation long, whitened double, explained double, identity_error double"


def _integers(vector: Column) -> Column:
    """floor(1024 * c) + 100000 of each entry, as long; the caller has seen to it that all are finite and in range."""
    return F.transform(vector, lambda c: F.floor(c.cast("double") * STEPS).cast("long") + SHIFT)


def _usable(vector: Column) -> Column:
    fits = lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < EXACT / STEPS / 2)
    return vector.isNotNull() & F.forall(vector, fits)


def with_index(df: DataFrame, name: str) -> DataFrame:
    """The rows with ``row``, numbers from 0 without a gap, written so that the numbers hold.

    Only the counted rows of each partition come to the driver.
    """
    placed = written(df.withColumn("place", F.monotonically_increasing_id()), name)
    part = F.shiftright("place", 33).cast("int")
    counts = placed.groupBy(part.alias("part")).agg(F.count("*").alias("size")).orderBy("part").collect()
    starts, before = [], 0
    for r in counts:
        starts.append((r.part, before))
        before += r.size
    starts = df.sparkSession.createDataFrame(starts, "part int, start long")
    inside = F.col("place").bitwiseAND((1 << 33) - 1)
    return placed.withColumn("part", part).join(F.broadcast(starts), "part").withColumn("row", F.col("start") + inside).drop("part", "start", "place")


def block_matrix(rows: DataFrame, n: int, dims: int) -> BlockMatrix:
    """Rows of (row, values array) as blocks of about BLOCK_BYTES, whatever executor they come from."""
    vectors = MLUtils.convertVectorColumnsFromML(rows.select(F.col("row").alias("index"), array_to_vector("values").alias("vector")), "vector")
    height = max(1, BLOCK_BYTES // (8 * dims), math.ceil(n / MOST_BLOCKS))
    return IndexedRowMatrix(vectors, n, dims).toBlockMatrix(height, dims)


def gram(matrix: BlockMatrix) -> np.ndarray:
    """Transposed matrix times matrix.

    The result is one block, to which all blocks of rows add: few of them are multiplied in a
    task, and the partial products summed. MLlib's Python wrapper does not name the number of
    these splits, so its Java method is called.
    """
    java = matrix._java_matrix_wrapper
    splits = math.ceil(matrix.numRowBlocks / BLOCKS_TOGETHER)
    product = matrix.transpose()._java_matrix_wrapper.call("multiply", java._java_model, splits)
    return BlockMatrix(product, matrix.colsPerBlock, matrix.colsPerBlock).toLocalMatrix().toArray()


def directions(scatter: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues and their unit vectors as columns; those that are zero to double precision are left out."""
    values, vectors = np.linalg.eigh((scatter + scatter.T) / 2)
    order = np.argsort(-values, kind="stable")[:most]
    order = order[values[order] > max(values.max(), 0) * len(values) * np.finfo(float).eps]
    return values[order], vectors[:, order]


def whiten(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """Projections of each vector on the whitened leading components of all.

    Returns (id, component from 1, n, deviation, whitened, explained, identity_error), a row
    for each remaining row and component. ``deviation`` is the exact sum over dimensions of
    (n * x - S) ** 2, and null where that is beyond a long.

    Rows are left out whose vector is null, holds a null, NaN, infinite or unrepresentable
    entry (beyond 2 ** 42, where x has no exact double), or has another length than most have
    (of equally common lengths the larger counts). Empty vectors count as left out. Repeated
    rows and ids stay as rows of their own, and an id may be null. Components without variance
    are not returned; a table without remaining rows, or of equal ones, gives none. Vectors of
    more than MOST_DIMENSIONS entries raise an error.
    """
    spark = vectors.sparkSession
    kind = vectors.schema[id_col].dataType.simpleString()
    none = spark.createDataFrame([], f"id {kind}, {SCHEMA}").withColumnRenamed("id", id_col)
    vector = F.col(vector_col)
    usable = vectors.filter(_usable(vector) & (F.size(vector) > 0))
    lengths = usable.groupBy(F.size(vector).alias("dims")).agg(F.count("*").alias("size"))
    common = lengths.orderBy(F.desc("size"), F.desc("dims")).first()
    if common is None:
        return none
    dims, n = common.dims, common["size"]
    if dims > MOST_DIMENSIONS:
        raise ValueError(f"vectors of {dims} entries; at most {MOST_DIMENSIONS} are whitened")
    rows = with_index(usable.filter(F.size(vector) == dims).select(F.col(id_col).alias("id"), _integers(vector).alias("x")), "whitening-rows")
    sums = rows.select(F.posexplode("x").alias("at", "x")).groupBy("at").agg(F.sum(F.col("x").cast("decimal(20,0)")).alias("total")).orderBy("at").collect()
    totals = F.lit([r.total for r in sums]).cast("array<decimal(38,0)>")
    # n * x - S is a whole number, so the division is the one rounding of a centred entry
    far = F.zip_with("x", totals, lambda x, s: (F.lit(n).cast("decimal(19,0)") * x.cast("decimal(19,0)") - s).cast("decimal(19,0)"))
    square = F.aggregate(far, F.lit(0).cast("decimal(38,0)"), lambda a, d: (a + (d * d).cast("decimal(38,0)")).cast("decimal(38,0)"))
    centred = F.transform(far, lambda d: d.cast("double") / n)
    deviation = F.when(square <= F.lit((1 << 63) - 1), square).cast("long")
    matrix = block_matrix(rows.select("row", centred.alias("values")), n, dims)
    scatter = gram(matrix) / n
    trace = float(np.trace(scatter))
    values, axes = directions(scatter, components)
    if not len(values):
        return none
    scaled = DenseMatrix(dims, len(values), (axes / np.sqrt(values)).ravel(order="F").tolist())
    whitening = BlockMatrix(spark.sparkContext.parallelize([((0, 0), scaled)], 1), dims, len(values))
    projected = matrix.multiply(whitening).toIndexedRowMatrix()
    found = callMLlibFunc("getIndexedRows", projected._java_matrix_wrapper._java_model)
    kept = found.select(F.col("index").alias("row"), vector_to_array("vector").alias("whitened"))
    together = rows.select("row", "id", deviation.alias("deviation")).join(kept, "row").drop("row")
    done = written(together, "whitening-projections")
    error = identity_error(done, len(values), n)
    shares = F.lit([float(v / trace) for v in values])
    long = done.select("id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return long.select(F.col("id").alias(id_col), (F.col("at") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened", F.get(shares, F.col("at")).alias("explained"), F.lit(error).alias("identity_error"))


def identity_error(done: DataFrame, count: int, n: int) -> float:
    """How far the covariance of the whitened rows is from the identity, at its worst entry: centred, then multiplied."""
    w = lambda k: F.get("whitened", F.lit(k))
    means = done.agg(*[F.avg(w(k)).alias(f"m{k}") for k in range(count)]).first()
    pairs = [(i, j) for i in range(count) for j in range(i, count)]
    products = done.agg(*[F.sum((w(i) - means[i]) * (w(j) - means[j])).alias(f"p{i}_{j}") for i, j in pairs]).first()
    return max(abs(products[k] / n - (i == j)) for k, (i, j) in enumerate(pairs))
