"""Whitening of embeddings with MLlib's distributed BlockMatrix.

Entries become whole numbers, x = floor(64 c) + 1,000,000, so sums and deviations are exact.
Rows get a dense index; centred rows x - S / n form a BlockMatrix of ``BLOCK`` rows a block. Its
transpose times itself is the scatter matrix: the product is cut along the rows into
``splits`` parts, each of which sums its blocks before anything is merged, so no task sees more
than its share. The scatter matrix (dimensions squared, the only thing on the driver) gets a
local eigendecomposition; the block matrix times the scaled eigenvectors projects the rows.
The identity error is measured on the projected rows, by one more pass of partial products.

At scale. The vectors are shuffled once for their index, once into blocks and once per product. The
driver holds a key per block, so ``BLOCK`` is large: 10^10 vectors are 1.2 million keys.
Nothing depends on labels or on a sample: the fit list is all usable vectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import DenseMatrix
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadlake.llm.common import partitions, ranked
from leadlake.session import store

SCALE, OFFSET = 64, 1_000_000
COMPONENTS = 32
BLOCK = 8_192
#: Scaled entries are held within +-LARGEST, far beyond unit vectors, so that each fits a long.
LARGEST = float(1 << 50)
#: An eigenvalue below this share of the greatest is rounding: its direction holds no variance.
FLAT = 1e-12

ROW = "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"


def _whole(embedding: Column) -> Column:
    return F.transform(embedding, lambda c: F.floor(F.least(F.greatest(SCALE * c.cast("double"), F.lit(-LARGEST)), F.lit(LARGEST))).cast("bigint") + OFFSET)


def whole_vectors(vectors: DataFrame) -> DataFrame:
    """vec_id and x of the rows that are neither null nor hold null or non-finite entries."""
    e = F.col("embedding")
    odd = F.exists(e, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return vectors.where(F.coalesce((F.size(e) > 0) & ~odd, F.lit(False))).select(F.col("vec_id").cast("bigint").alias("vec_id"), _whole(e).alias("x"))


def block_matrix(rows: DataFrame, centre: list[float], n: int) -> BlockMatrix:
    """Centred rows at their index as blocks of BLOCK rows and all dimensions."""
    d = len(centre)
    mean = F.lit(centre)
    centred = F.zip_with(F.col("x"), mean, lambda x, m: x.cast("double") - m)
    indexed = MLUtils.convertVectorColumnsFromML(rows.select("index", array_to_vector(centred).alias("row")), "row")
    return IndexedRowMatrix(indexed, n, d).toBlockMatrix(BLOCK, d)


def product(left: BlockMatrix, right: BlockMatrix, splits: int) -> BlockMatrix:
    """left times right; the dimension between them is cut into ``splits`` parts, which are tasks of their own."""
    java = left._java_matrix_wrapper.call("multiply", right._java_matrix_wrapper._java_model, splits)
    return BlockMatrix(java, left.rowsPerBlock, right.colsPerBlock)


def blocks_of(matrix: BlockMatrix) -> DataFrame:
    """blockIndex and subMatrix of every block."""
    return callMLlibFunc("getMatrixBlocks", matrix._java_matrix_wrapper._java_model)


def eigen(scatter: np.ndarray, n: int, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Eigenvalues of the covariance by falling size, the projection onto whitened components, and
    each component's share of the trace. A component without variance projects to 0."""
    covariance = (scatter + scatter.T) / (2 * n)
    values, vectors = np.linalg.eigh(covariance)
    order = np.argsort(-values, kind="stable")[:most]
    values, vectors = np.maximum(values[order], 0), vectors[:, order]
    real = values > FLAT * max(values.max(initial=0.0), 1e-300)
    project = np.where(real, vectors / np.sqrt(np.where(real, values, 1)), 0)
    trace = float(np.trace(covariance))
    return np.where(real, values, 0), project, values / trace if trace > 0 else np.zeros(len(values))


def _projected(matrix: BlockMatrix) -> DataFrame:
    """index and w (whitened components) of each row of a product."""
    def rows(block) -> Iterator[tuple[int, list[float]]]:
        (i, _), inside = block
        for k, row in enumerate(inside.toArray()):
            yield int(i) * BLOCK + k, row.tolist()

    return blocks_of(matrix).rdd.flatMap(rows).toDF("index bigint, w array<double>")


def _matrix(column: pa.Array, n: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(n, -1)


def covariance(rows: DataFrame, n: int, width: int) -> np.ndarray:
    """Covariance of the arrays w, divisor n, centred before multiplying; tasks sum their share first."""
    def sums(centre: np.ndarray | None):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(width if centre is None else (width, width))
            for batch in batches:
                if batch.num_rows:
                    w = _matrix(batch.column(0), batch.num_rows)
                    total += w.sum(0) if centre is None else (w - centre).T @ (w - centre)
            flat = total.ravel()
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat)), pa.int32()), pa.array(flat)], names=["place", "part"])

        got = rows.select("w").mapInArrow(run, "place int, part double").groupBy("place").agg(F.sum("part").alias("s")).collect()  # width squared rows
        out = np.zeros(width if centre is None else width * width)
        for r in got:
            out[r["place"]] = r["s"]
        return out / n

    return sums(sums(None)).reshape(width, width)


def _deviation(sums: list[int], n: int) -> Column:
    """The sum over dimensions of (n x - S)^2, exact; null where it exceeds a long."""
    s = F.lit(sums) if all(abs(v) < 1 << 63 for v in sums) else F.lit(None).cast("array<bigint>")
    apart = F.zip_with("x", s, lambda x, t: F.try_subtract(F.try_multiply(x, F.lit(n).cast("bigint")), t))
    return F.aggregate(apart, F.lit(0).cast("bigint"), lambda a, v: F.try_add(a, F.try_multiply(v, v)))


def _whitened(rows: DataFrame, d: int, most: int) -> DataFrame:
    """The result for the stored rows (vec_id, x), all of ``d`` dimensions."""
    spark = rows.sparkSession
    sums = rows.agg(F.count("*").alias("n"), *[F.sum(F.get("x", F.lit(i)).cast("decimal(20,0)")).alias(f"s{i}") for i in range(d)]).first()
    n, totals = sums["n"], [int(sums[f"s{i}"]) for i in range(d)]
    # rows of one id and content are interchangeable, so a recomputed task gives the same index
    indexed = ranked(rows.withColumns({"one": F.lit(0), "h": F.xxhash64("vec_id", "x")}), "one", ["h"], ["h", "vec_id"], "index", max(64, partitions(spark)))
    indexed = store(indexed.select("index", "vec_id", "x"))
    matrix = block_matrix(indexed, [float(Fraction(t, n)) for t in totals], n)
    splits = max(1, min(partitions(spark), -(-n // BLOCK)))
    scatter = product(matrix.transpose(), matrix, splits).toLocalMatrix().toArray()  # d x d
    values, project, explained = eigen(scatter, n, most)
    k = len(values)
    weights = spark.sparkContext.parallelize([((0, 0), DenseMatrix(d, k, project.ravel(order="F")))], 1)
    white = store(_projected(product(matrix, BlockMatrix(weights, d, k, d, k), 1)))
    real = np.flatnonzero(values > 0)
    apart = np.abs(covariance(white, n, k) - np.eye(k))[np.ix_(real, real)]
    error = float(apart.max()) if len(real) else 0.0
    joined = indexed.select("index", "vec_id", _deviation(totals, n).alias("deviation")).join(white, "index")
    parts = joined.select("vec_id", "deviation", F.posexplode("w").alias("at", "whitened"))
    return parts.select(
        "vec_id", (F.col("at") + 1).alias("component"), F.lit(n).cast("bigint").alias("n"), "deviation", "whitened",
        F.get(F.lit(explained.tolist()), "at").alias("explained"), F.lit(error).alias("identity_error"))


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """A row per usable row of vectors and component: vec_id, component (from 1), n, deviation, whitened, explained, identity_error.

    Null vectors, empty ones and those with null or non-finite entries are left out. Vectors of
    different lengths have no common covariance: each length is a fit of its own, with its own n and
    identity_error. Rows that repeat an id are rows of their own; a null id stays null; extra
    columns are left out; an empty table stays empty. A component without variance is whitened to
    0 and is no part of identity_error. A deviation that exceeds a long is null; entries beyond +-2^50 / 64 count as that bound.
    """
    rows = store(whole_vectors(vectors))
    lengths = sorted(r["d"] for r in rows.select(F.size("x").alias("d")).distinct().collect())  # one length in a sound table
    parts = [_whitened(rows.where(F.size("x") == d), d, min(components, d)) for d in lengths]
    out = vectors.sparkSession.createDataFrame([], ROW)
    for part in parts:
        out = part if part is parts[0] else out.unionByName(part)
    return out
