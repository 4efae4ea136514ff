"""K-means: seeding by squared distances, Lloyd's steps over the whole table, and its single steps as Columns.

Centroids and per-cluster sums are all that reaches the driver. Sums are taken per Arrow batch and added up by cluster,
so the data are read once a round and never shuffled. Distance is Euclidean whatever metric an index uses; ties go to
the cluster of the lower number.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from halyard.functions.vector import literal_vector, matrix, squared_euclidean

#: The seeding reads at most so many rows: those of the smallest hashes.
SEED_SAMPLE = 20_000


@dataclass(frozen=True)
class KMeansConfig:
    k: int = 8
    max_iterations: int = 100
    tolerance: float = 1e-4


@dataclass(frozen=True)
class KMeansResult:
    centroids: np.ndarray
    assignments: DataFrame  # (id, cluster_id), made before the last move of the centroids
    iterations: int


def nearest(points: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """The nearest centroid of each row, ties to the lowest."""
    out = np.empty(len(points), np.int64)
    squares = (centroids**2).sum(1)
    for a in range(0, len(points), 4096):
        part = points[a : a + 4096]
        gap = squares - 2 * (part @ centroids.T)
        own = gap.argmin(1)
        # Rows that the products' rounding leaves open are computed from the differences.
        slack = 1e-15 * 4 * ((part**2).sum(1) + squares.max()) * part.shape[1]
        for i in np.flatnonzero((gap <= (gap[np.arange(len(part)), own] + slack)[:, None]).sum(1) > 1).tolist():
            own[i] = ((part[i] - centroids) ** 2).sum(1).argmin()
        out[a : a + 4096] = own
    return out


def plus_plus(points: np.ndarray, k: int, seed: int) -> np.ndarray:
    """k-means++: each next centroid is drawn by squared distance to those chosen; equal points are drawn evenly, and k beyond the points repeats them."""
    rng = np.random.default_rng(seed)
    if k >= len(points):
        return points[np.arange(k) % len(points)].copy()
    chosen = [int(rng.integers(len(points)))]
    gap = ((points - points[chosen[0]]) ** 2).sum(1)
    while len(chosen) < k:
        total = gap.sum()
        chosen.append(int(rng.choice(len(points), p=gap / total)) if total > 0 else int(rng.integers(len(points))))
        gap = np.minimum(gap, ((points - points[chosen[-1]]) ** 2).sum(1))
    return points[chosen].copy()


def centroid_table(spark: SparkSession, centroids: np.ndarray) -> DataFrame:
    return spark.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(centroids)], "cluster_id int, centroid array<double>")


def assign(points: DataFrame, centroids: np.ndarray) -> DataFrame:
    """points(id, vector, ...) with the cluster_id of the nearest centroid."""
    schema = points.schema

    def run(batches):
        at = schema.fieldNames().index("vector")
        for batch in batches:
            own = nearest(matrix(batch.column(at), centroids.shape[1]), centroids).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own)], [*batch.schema.names, "cluster_id"])

    return points.mapInArrow(run, points.withColumn("cluster_id", F.lit(0)).schema)


def assign_column(vector: Column | str, centroids: np.ndarray) -> Column:
    """The nearest centroid by Column expressions."""
    pairs = [F.struct(squared_euclidean(vector, literal_vector(c)).alias("d"), F.lit(i).alias("i")) for i, c in enumerate(centroids)]
    return F.array_min(F.array(*pairs))["i"]


def _sums(points: DataFrame, centroids: np.ndarray) -> list:
    def run(batches):
        total, n = np.zeros_like(centroids), np.zeros(len(centroids), np.int64)
        for batch in batches:
            x = matrix(batch.column(0), centroids.shape[1])
            own = nearest(x, centroids)
            total += (own == np.arange(len(centroids))[:, None]).astype(float) @ x
            n += np.bincount(own, minlength=len(centroids))
        yield pa.RecordBatch.from_arrays([pa.array(range(len(n)), pa.int32()), pa.array(n), pa.array(total.tolist(), pa.list_(pa.float64()))], ["c", "n", "total"])

    parts = points.select(F.col("vector").cast("array<double>")).mapInArrow(run, "c int, n long, total array<double>")
    # A row for each component, summed in sorted order: the result is the same whatever the order of the parts.
    whole = F.aggregate(F.array_sort(F.collect_list("x")), F.lit(0.0), lambda a, b: a + b)
    flat = parts.select("c", "n", F.posexplode("total").alias("i", "x")).groupBy("c", "i").agg(F.sum("n").alias("n"), whole.alias("x"))
    return flat.groupBy("c").agg(F.first("n").alias("n"), F.array_sort(F.collect_list(F.struct("i", "x"))).alias("xs")).collect()


def step(points: DataFrame, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One round: the means of the rows nearest to each centroid, and how many they are; a cluster without rows keeps its centroid."""
    moved, n = centroids.copy(), np.zeros(len(centroids), np.int64)
    for row in _sums(points, centroids):
        n[row.c] = row.n
        if row.n:
            moved[row.c] = np.array([x.x for x in row.xs]) / row.n
    return moved, n


def kmeans(points: DataFrame, config: KMeansConfig | None = None, seed: int = 42) -> KMeansResult:
    """Clusters points(id, vector). k is at most the number of points; rounds end when the centroids move less than the tolerance in sum."""
    config = config or KMeansConfig()
    if config.k <= 0:
        raise ValueError("k must be greater than 0")
    sample = points.orderBy(F.xxhash64("id"), "id").limit(SEED_SAMPLE).select("id", "vector").collect()
    if not sample:
        raise ValueError("cannot cluster an empty table")
    data = np.array([r.vector for r in sorted(sample, key=lambda r: r.id)], float)
    k = min(config.k, points.count())
    centroids, rounds, rng = plus_plus(data, k, seed), 0, np.random.default_rng(seed + 1)
    before = centroids
    for rounds in range(1, config.max_iterations + 1):
        before = centroids
        moved, n = step(points, centroids)
        for c in np.flatnonzero(n == 0):
            moved[c] = data[int(rng.integers(len(data)))]
        centroids = moved
        if np.sqrt(((moved - before) ** 2).sum(1)).sum() < config.tolerance:
            break
    return KMeansResult(centroids, assign(points, before).select("id", "cluster_id"), rounds)
