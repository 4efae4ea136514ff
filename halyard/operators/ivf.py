"""Inverted-file search: rows are kept by nearest centroid, and a query reads its nearest clusters only."""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from halyard.functions.vector import larger_is_better, matrix, metric_name, score
from halyard.operators.collection import POINTS, FlatCollection
from halyard.operators.kmeans import KMeansConfig, assign, assign_column, centroid_table, kmeans
from halyard.operators.search import RESULT, query_blocks, scan_top_k
from halyard.operators.topk import top_k_largest, top_k_per_query, top_k_smallest
from halyard.plans.storage import read_json, write_json


def nearest_centroid(vector: list[float], centroids: np.ndarray) -> int:
    return int(((centroids - np.asarray(vector, float)) ** 2).sum(1).argmin())


def nearest_clusters(query: list[float] | np.ndarray, centroids: np.ndarray, nprobe: int) -> list[int]:
    """The nprobe nearest clusters by Euclidean distance, nearest first, ties to the lower number; 0 gives none."""
    gap = ((centroids - np.asarray(query, float)) ** 2).sum(1)
    return np.argsort(gap, kind="stable")[: max(0, nprobe)].tolist()


def probe_table(queries: DataFrame, centroids: DataFrame, nprobe: int) -> DataFrame:
    """(qid, vector, cluster_id) of each query's nprobe nearest clusters: a map over the queries, the centroids go along."""
    rows = centroids.orderBy("cluster_id").collect()
    numbers, places = np.array([r.cluster_id for r in rows], np.int32), np.array([r.centroid for r in rows], float)

    def run(batches):
        for batch in batches:
            own = [nearest_clusters(q, places, nprobe) for q in matrix(batch.column(1), places.shape[1])]
            at = pa.array(np.repeat(np.arange(batch.num_rows), [len(o) for o in own]))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(numbers[[c for o in own for c in o]])], ["qid", "vector", "cluster_id"])

    wide = queries.select("qid", F.col("vector").cast("array<double>").alias("vector"))
    return wide.mapInArrow(run, "qid long, vector array<double>, cluster_id int") if rows and nprobe > 0 else wide.withColumn("cluster_id", F.lit(0)).limit(0)


@dataclass(frozen=True)
class IVFIndex:
    """centroids, and postings(id, vector, cluster_id). Ids are unique over all clusters."""

    dim: int
    clusters: int
    metric: str
    centroids: np.ndarray | None
    postings: DataFrame
    tombstones: DataFrame

    @staticmethod
    def create(spark: SparkSession, dim: int, clusters: int, metric: str = "euclidean") -> IVFIndex:
        if dim <= 0 or clusters <= 0:
            raise ValueError("dimension and number of clusters must be greater than 0")
        return IVFIndex(dim, clusters, metric_name(metric), None, spark.createDataFrame([], POINTS + ", cluster_id int"), spark.createDataFrame([], "id long"))

    @property
    def is_trained(self) -> bool:
        return self.centroids is not None

    def _trained(self) -> np.ndarray:
        if self.centroids is None:
            raise ValueError("index must be trained first")
        return self.centroids

    def train(self, data: DataFrame, config: KMeansConfig | None = None, seed: int = 42) -> IVFIndex:
        """Fits the centroids to data(id, vector); nothing is added. k must be the number of clusters."""
        config = config or KMeansConfig(k=self.clusters)
        if config.k != self.clusters:
            raise ValueError(f"k ({config.k}) must equal the number of clusters ({self.clusters})")
        return replace(self, centroids=kmeans(data, config, seed).centroids)

    def with_centroids(self, centroids: np.ndarray) -> IVFIndex:
        return replace(self, centroids=np.asarray(centroids, float))

    def add_batch(self, rows: DataFrame) -> IVFIndex:
        """Adds rows(id, vector), each to the cluster of its nearest centroid; repeated ids are an error."""
        centroids = self._trained()
        flat = FlatCollection(self.postings.select("id", "vector"), self.tombstones, self.dim, self.metric).add_batch(rows)
        del flat  # only its checks are needed
        new = assign(rows.select(F.col("id").cast("long").alias("id"), F.col("vector").cast("array<float>").alias("vector")), centroids)
        return replace(self, postings=self.postings.unionByName(new))

    def add(self, id: int, vector: list[float]) -> IVFIndex:
        return self.add_batch(self.postings.sparkSession.createDataFrame([(id, [float(x) for x in vector])], POINTS))

    def live(self) -> DataFrame:
        return self.postings.join(self.tombstones, "id", "left_anti")

    def delete(self, id: int) -> IVFIndex:
        if self.live().where(F.col("id") == id).isEmpty():
            raise ValueError(f"id not found: {id}")
        return replace(self, tombstones=self.tombstones.union(self.postings.sparkSession.createDataFrame([(id,)], "id long")))

    def compact(self) -> IVFIndex:
        return replace(self, postings=self.live().select(*self.postings.columns), tombstones=self.tombstones.limit(0))

    def update(self, id: int, vector: list[float]) -> IVFIndex:
        """The new vector may belong to another cluster."""
        return self.delete(id).compact().add(id, vector)

    def __len__(self) -> int:
        return self.live().count()

    def is_empty(self) -> bool:
        return self.live().isEmpty()

    def cluster_sizes(self) -> DataFrame:
        """(cluster_id, size) of the live rows, in the order of the centroids, empty clusters too."""
        every = self.postings.sparkSession.range(self.clusters).select(F.col("id").cast("int").alias("cluster_id"))
        sizes = self.live().groupBy("cluster_id").agg(F.count(F.lit(1)).alias("size"))
        return every.join(sizes, "cluster_id", "left").select("cluster_id", F.coalesce("size", F.lit(0)).cast("long").alias("size"))

    def save(self, path: str) -> None:
        """Writes the live postings into one folder for each cluster, so that a search reads those it probes, and the model.

        Rows are dealt by cluster and a hash of the id, so a large cluster becomes several files of several tasks.
        """
        deal = F.pmod(F.xxhash64("id"), F.lit(16))
        self.live().repartition("cluster_id", deal).write.partitionBy("cluster_id").parquet(f"{path}/postings")
        write_json(self.postings.sparkSession, f"{path}/model.json", {"dim": self.dim, "clusters": self.clusters, "metric": self.metric, "centroids": None if self.centroids is None else self.centroids.tolist()})

    @staticmethod
    def load(spark: SparkSession, path: str) -> IVFIndex:
        """The index that save() wrote, over its folders."""
        model = read_json(spark, f"{path}/model.json")
        postings = spark.read.schema(POINTS + ", cluster_id int").parquet(f"{path}/postings")
        centroids = None if model["centroids"] is None else np.array(model["centroids"], float)
        return IVFIndex(model["dim"], model["clusters"], model["metric"], centroids, postings, spark.createDataFrame([], "id long"))

    def nprobe_coverage(self, query: list[float], nprobe: int) -> int:
        """How many rows a search with nprobe compares."""
        own = nearest_clusters(query, self._trained(), nprobe)
        return int(self.cluster_sizes().where(F.col("cluster_id").isin(own)).agg(F.sum("size")).first()[0] or 0) if own else 0

    def search(self, query: list[float], k: int, nprobe: int = 1) -> DataFrame:
        """(rank, id, score): clusters by Euclidean distance, rows in them by the metric. nprobe = 0 gives no rows."""
        own = nearest_clusters(query, self._trained(), nprobe)
        rows = self.live().where(F.col("cluster_id").isin(own) if own else F.lit(False))  # constants: whole folders are skipped
        literal = F.array(*(F.lit(float(x)) for x in query))
        scored = rows.select("id", score(self.metric, "vector", literal).alias("score"))
        return top_k_largest(scored, k) if larger_is_better(self.metric) else top_k_smallest(scored, k)

    def search_batch(self, queries: DataFrame, k: int, nprobe: int = 1) -> DataFrame:
        """(qid, rank, id, score). Probes and postings meet by cluster; a cluster's rows are scored against its queries only."""
        centroids = self._trained()
        spark = self.postings.sparkSession
        if nprobe <= 0 or k <= 0:
            return spark.createDataFrame([], RESULT)
        parts = []
        for qids, x in query_blocks(queries):
            wanted: dict[int, list[int]] = {}
            for i, q in enumerate(x):
                for c in nearest_clusters(q, centroids, nprobe):
                    wanted.setdefault(c, []).append(i)
            parts.append(_scan_clusters(self.live(), qids, x, wanted, k, self.metric))
        found = reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], "qid long, id long, score double")
        return top_k_per_query(found, k, larger_is_better(self.metric))


def _scan_clusters(postings: DataFrame, qids: np.ndarray, queries: np.ndarray, wanted: dict[int, list[int]], k: int, metric: str) -> DataFrame:
    """Each task's k best for each query among the rows of each cluster that it probes."""
    import pyarrow as pa

    from halyard.functions.vector import matrix
    from halyard.operators.search import Nearest

    dim = queries.shape[1]

    def run(batches):
        best: dict[int, Nearest] = {}
        for batch in batches:
            ids, clusters, x = batch.column(0).to_numpy(zero_copy_only=False), batch.column(2).to_numpy(zero_copy_only=False), matrix(batch.column(1), dim)
            for c in np.unique(clusters).tolist():
                if c in wanted:
                    rows = np.flatnonzero(clusters == c)
                    best.setdefault(c, Nearest(metric, queries[wanted[c]], k)).add(ids[rows], x[rows])
        for c, found in best.items():
            rows, ids, scores = found.best()
            yield pa.RecordBatch.from_arrays([pa.array(qids[np.array(wanted[c])[rows]]), pa.array(ids), pa.array(scores)], ["qid", "id", "score"])

    rows = postings.where(F.col("cluster_id").isin(list(wanted))) if wanted else postings.limit(0)
    return rows.select("id", F.col("vector").cast("array<double>"), "cluster_id").mapInArrow(run, "qid long, id long, score double")


__all__ = ["IVFIndex", "assign_column", "centroid_table", "nearest_centroid", "nearest_clusters", "probe_table", "scan_top_k"]
