"""Centroid clustering of integer vectors with a table of distances to fixed pivots.

The table is written once: each vector with its exact distances to ``PIVOTS`` vectors that never
move. In a round the driver knows the centroids (a few) and their distances to the pivots. For
any pivot p, |d(x, p) - d(c, p)| is at most d(x, c), so a vector takes for each centroid the
largest of these differences as a lower bound, computes the exact integer distance to the
centroid of the least bound, and then to those others alone whose bound does not exceed it. Ties go
to the smaller number. Bounds are in double precision with a slack that covers their rounding,
so the result is that of comparing every centroid.

At scale. A round is one pass over the table, without a shuffle of vectors: a task sums its
vectors per cluster, so clusters x dimensions rows leave it, however large a cluster is. The
driver gets clusters x dimensions sums and sends back as many numbers. Sums are decimals, exact
at any count; the new centroid is their exact floor.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadlake.llm.common import inline_table
from leadlake.session import store

DIMENSIONS, CLUSTERS, ROUNDS, PIVOTS = 64, 40, 5, 8
#: Components are held within +-LARGEST, so every squared distance fits a long. Vectors of unit length are far inside.
LARGEST = 1 << 27
AT_ONCE = 16_384


def _integers(embedding: Column) -> Column:
    """floor(256 x) of each component, within +-LARGEST."""
    return F.transform(embedding, lambda x: F.floor(F.least(F.greatest(256 * x.cast("double"), F.lit(float(-LARGEST))), F.lit(float(LARGEST)))).cast("int"))


def integer_vectors(vectors: DataFrame, dimensions: int = DIMENSIONS) -> DataFrame:
    """vec_id and q (integers) of the rows with exactly ``dimensions`` components, none null or non-finite."""
    e = F.col("embedding")
    odd = F.exists(e, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    whole = F.coalesce((F.size(e) == dimensions) & ~odd, F.lit(False))
    return vectors.where(whole).select(F.col("vec_id").cast("bigint").alias("vec_id"), _integers(e).alias("q"))


def first_centroids(vectors: DataFrame, clusters: int = CLUSTERS) -> np.ndarray:
    """The vectors with the least sha256 of ``2:<vec_id>``, in that order; rows without an id come
    last, rows of one id in the order of their components. Each map task keeps ``clusters`` rows."""
    hashed = F.sha2(F.concat(F.lit("2:"), F.col("vec_id").cast("string")), 256)
    rows = vectors.select(hashed.alias("h"), "q").orderBy(F.asc_nulls_last("h"), "q").limit(clusters).collect()  # ``clusters`` rows
    return np.array([r["q"] for r in rows], np.int64)


def choose_pivots(centroids: np.ndarray, pivots: int = PIVOTS) -> np.ndarray:
    """Up to ``pivots`` of the vectors, each the farthest from those before it; the first one is the first."""
    chosen = [0]
    apart = _squared(centroids, centroids[[0]])[:, 0]
    while len(chosen) < pivots and apart.max() > 0:
        chosen.append(int(apart.argmax()))
        apart = np.minimum(apart, _squared(centroids, centroids[[chosen[-1]]])[:, 0])
    return centroids[chosen]


def _squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Exact squared distances of the rows of x to those of y, as longs."""
    return np.stack([((x - c) ** 2).sum(1) for c in y], 1) if len(y) else np.empty((len(x), 0), np.int64)


def _matrix(column: pa.Array, n: int, kind: type) -> np.ndarray:
    """A column of lists of one length as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(n, -1).astype(kind, copy=False)


def pivot_table(vectors: DataFrame, pivots: np.ndarray) -> DataFrame:
    """vec_id, q and far: the distance to each pivot."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, AT_ONCE):
                batch = whole.slice(at, AT_ONCE)
                far = np.sqrt(_squared(_matrix(batch.column(1), batch.num_rows, np.int64), pivots).astype(np.float64))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(list(far))], names=["vec_id", "q", "far"])

    return vectors.mapInArrow(run, "vec_id bigint, q array<int>, far array<double>")


@dataclass(frozen=True)
class Assigner:
    """Nearest centroids by pivot bounds."""

    centroids: np.ndarray  # clusters x dimensions
    far: np.ndarray  # clusters x pivots: distances of the centroids to the pivots

    @staticmethod
    def of(centroids: np.ndarray, pivots: np.ndarray) -> Assigner:
        return Assigner(centroids, np.sqrt(_squared(centroids, pivots).astype(np.float64)))

    def assign(self, x: np.ndarray, far: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Cluster and squared distance of each row of x, and how many exact distances that took."""
        bound = np.zeros((len(x), len(self.centroids)))
        for p in range(far.shape[1]):
            np.maximum(bound, np.abs(far[:, p, None] - self.far[None, :, p]), out=bound)
        best = bound.argmin(1)
        least = ((x - self.centroids[best]) ** 2).sum(1)
        # the bounds are off by their rounding alone, so a slack of a billionth leaves no centroid out
        open_ = bound * (1 - 1e-9) <= np.sqrt(least.astype(np.float64))[:, None] * (1 + 1e-9)
        open_[np.arange(len(x)), best] = False
        exact = len(x) + int(open_.sum())
        for c in range(len(self.centroids)):
            rows = np.flatnonzero(open_[:, c])
            if not len(rows):
                continue
            d = ((x[rows] - self.centroids[c]) ** 2).sum(1)
            nearer = (d < least[rows]) | ((d == least[rows]) & (c < best[rows]))
            least[rows[nearer]], best[rows[nearer]] = d[nearer], c
        return best, least, exact


def _moved(table: DataFrame, assigner: Assigner) -> np.ndarray:
    """The floor of the mean of each cluster; a cluster without vectors keeps its centroid."""
    k, dimensions = assigner.centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((k, dimensions), object), np.zeros(k, np.int64)
        for whole in batches:
            for at in range(0, whole.num_rows, AT_ONCE):
                batch = whole.slice(at, AT_ONCE)
                x = _matrix(batch.column(0), batch.num_rows, np.int64)
                own, _, _ = assigner.assign(x, _matrix(batch.column(1), batch.num_rows, np.float64))
                for c in np.unique(own).tolist():
                    sums[c] += x[own == c].sum(0)  # below 2^42 for a batch; Python numbers from then on
                counts += np.bincount(own, minlength=k)
        cluster, dimension = np.nonzero(np.broadcast_to(counts[:, None] > 0, (k, dimensions)))
        yield pa.RecordBatch.from_arrays([
            pa.array(cluster, pa.int32()), pa.array(dimension, pa.int32()),
            pa.array([int(s) for s in sums[cluster, dimension]], pa.int64()), pa.array(counts[cluster]),
        ], names=["cluster", "dimension", "total", "n"])

    parts = table.select("q", "far").mapInArrow(run, "cluster int, dimension int, total bigint, n bigint")
    sums = parts.groupBy("cluster", "dimension").agg(F.sum(F.col("total").cast("decimal(20,0)")).alias("total"), F.sum("n").alias("n"))
    new = assigner.centroids.copy()
    for r in sums.collect():  # clusters x dimensions rows
        new[r["cluster"], r["dimension"]] = int(r["total"]) // r["n"]
    return new


def _assigned(table: DataFrame, assigner: Assigner) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, AT_ONCE):
                batch = whole.slice(at, AT_ONCE)
                own, least, _ = assigner.assign(*(_matrix(batch.column(i), batch.num_rows, t) for i, t in ((1, np.int64), (2, np.float64))))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own, pa.int32()), pa.array(least)], names=["vec_id", "cluster", "distance"])

    return table.mapInArrow(run, "vec_id bigint, cluster int, distance bigint")


def cluster(vectors: DataFrame, dimensions: int = DIMENSIONS, clusters: int = CLUSTERS, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """(assignment, centroids): vec_id, cluster and distance of every usable row, and the final centroids.

    Rows whose vector is null, of another length, or holds null or non-finite components are
    left out. Rows that repeat an id are vectors of their own; a null id stays null. Fewer rows than clusters give as many
    clusters as rows, an empty table none. Components beyond +-2^27 / 256 count as that bound. Extra columns are left out.
    """
    table = store(integer_vectors(vectors, dimensions))
    centroids = first_centroids(table, clusters)
    if not len(centroids):
        return table.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("bigint").alias("distance")), centroids
    pivots = choose_pivots(centroids)
    table = store(pivot_table(table, pivots))
    for _ in range(rounds):
        centroids = _moved(table, Assigner.of(centroids, pivots))
    return store(_assigned(table, Assigner.of(centroids, pivots))), centroids


def digests(vectors: DataFrame) -> DataFrame:
    """One row per usable row: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256.

    Inertias that exceed a long are null; unit vectors cannot reach that.
    """
    assigned, centroids = cluster(vectors)
    total = F.sum(F.col("distance").cast("decimal(38,0)"))
    if not len(centroids):
        return assigned.select("vec_id", "cluster", "distance", *[F.lit(0).cast("bigint").alias(n) for n in ("cluster_inertia", "inertia")],
                               F.lit("").alias("centroid_sha256"))
    sums = {r["cluster"]: int(r["s"]) for r in assigned.groupBy("cluster").agg(total.alias("s")).collect()}  # a row per cluster
    table = [{
        "own": c, "cluster_inertia": _long(sums[c]), "inertia": _long(sum(sums.values())),
        "centroid_sha256": hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest(),
    } for c in sorted(sums)]
    known = inline_table(vectors.sparkSession, table, "own int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    joined = assigned.join(F.broadcast(known), F.col("cluster") == F.col("own"))  # a row per cluster
    return joined.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _long(n: int) -> int | None:
    return n if n < 1 << 63 else None


def oracle(dimensions: int = DIMENSIONS, clusters: int = CLUSTERS, rounds: int = ROUNDS) -> str:
    """The same by comparing every vector with every centroid."""
    steps = [f"""
v AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS q
  FROM embeddings
  WHERE len(embedding) = {dimensions} AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
c0 AS MATERIALIZED (
  SELECT CAST(row_number() OVER (ORDER BY sha256('2:' || vec_id), q) - 1 AS INTEGER) AS cluster, q
  FROM (SELECT * FROM v ORDER BY sha256('2:' || vec_id), q LIMIT {clusters}))"""]
    for i in range(rounds + 1):
        steps.append(f"""
a{i} AS MATERIALIZED (
  SELECT r, any_value(vec_id) AS vec_id, any_value(q) AS q, min(struct_pack(d := d, c := cluster)) AS best
  FROM (SELECT v.r, v.vec_id, v.q, c.cluster,
               CAST(list_sum([(p[1] - p[2]) * (p[1] - p[2]) FOR p IN list_zip(v.q, c.q)]) AS BIGINT) AS d
        FROM v CROSS JOIN c{i} c)
  GROUP BY r)""")
        if i < rounds:
            steps.append(f"""
c{i + 1} AS MATERIALIZED (
  SELECT c.cluster, coalesce(m.q, c.q) AS q
  FROM c{i} c LEFT JOIN (
    SELECT cluster, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS q
    FROM (SELECT best.c AS cluster, i, sum(q[i]) AS s, count(*) AS n FROM a{i} CROSS JOIN range(1, {dimensions + 1}) t(i) GROUP BY ALL)
    GROUP BY cluster) m ON m.cluster = c.cluster)""")
    return "WITH" + ",".join(steps) + f"""
SELECT vec_id, best.c AS cluster, best.d AS distance,
       CAST(sum(best.d) OVER (PARTITION BY best.c) AS BIGINT) AS cluster_inertia, CAST(sum(best.d) OVER () AS BIGINT) AS inertia,
       sha256(array_to_string(k.q, ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} k ON k.cluster = best.c"""
