"""Product quantisation: codebooks, codes, and distances by table lookup; and the inverted file over codes."""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from halyard.functions.vector import literal_vector, matrix, squared_euclidean
from halyard.operators.ivf import nearest_clusters
from halyard.operators.kmeans import SEED_SAMPLE, KMeansConfig, kmeans, nearest, plus_plus
from halyard.operators.search import RESULT, query_blocks
from halyard.operators.topk import best_columns, top_k_per_query, top_k_smallest
from halyard.plans.storage import read_json, write_json


@dataclass(frozen=True)
class PQConfig:
    m: int = 8
    k: int = 256
    iterations: int = 100


def subvector(vector: Column | str, pos: int, size: int) -> Column:
    return F.slice(vector, pos * size + 1, size)


@dataclass(frozen=True)
class Codebooks:
    """Sub-centroids of shape (m, k, dim / m)."""

    values: np.ndarray

    @property
    def m(self) -> int:
        return self.values.shape[0]

    @property
    def k(self) -> int:
        return self.values.shape[1]

    @property
    def dim(self) -> int:
        return self.m * self.values.shape[2]

    def check(self, dim: int) -> None:
        if dim != self.dim:
            raise ValueError(f"vector dimension mismatch: expected {self.dim}, got {dim}")

    def encode(self, x: np.ndarray) -> np.ndarray:
        """Codes of the rows of x, uint8 of shape (rows, m); ties to the lower code."""
        self.check(x.shape[1])
        size = self.values.shape[2]
        return np.stack([nearest(x[:, p * size : (p + 1) * size], self.values[p]) for p in range(self.m)], 1).astype(np.uint8)

    def decode(self, codes: np.ndarray) -> np.ndarray:
        if codes.shape[1] != self.m or (codes.size and codes.max() >= self.k):
            raise ValueError("code doesn't fit the codebooks")
        return np.concatenate([self.values[p][codes[:, p]] for p in range(self.m)], 1)

    def adc_table(self, query: np.ndarray) -> np.ndarray:
        """Squared distances (m, k) of the query's subvectors to all sub-centroids."""
        query = np.asarray(query, float)
        self.check(len(query))
        return ((self.values - query.reshape(self.m, 1, -1)) ** 2).sum(2)

    @staticmethod
    def adc_distances(table: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Approximate squared distances of coded rows: a sum of m lookups."""
        if codes.shape[1] != table.shape[0]:
            raise ValueError("code doesn't fit the table")
        return table[np.arange(table.shape[0])[None], codes].sum(1)

    def to_table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(p, c, self.values[p, c].tolist()) for p in range(self.m) for c in range(self.k)], "pos int, code int, sub_centroid array<double>")

    # The same operations as Columns; a code is array<int>.
    def encode_column(self, vector: Column | str) -> Column:
        size = self.values.shape[2]
        near = lambda p: F.array_min(F.array(*(F.struct(squared_euclidean(subvector(vector, p, size), literal_vector(c)).alias("d"), F.lit(i).alias("i")) for i, c in enumerate(self.values[p]))))["i"]
        return F.array(*map(near, range(self.m)))

    def decode_column(self, code: Column | str) -> Column:
        code = F.col(code) if isinstance(code, str) else code
        return F.flatten(F.array(*(F.element_at(F.array(*map(literal_vector, self.values[p])), code[p] + 1) for p in range(self.m))))

    def adc_column(self, query: list[float], code: Column | str) -> Column:
        code = F.col(code) if isinstance(code, str) else code
        return reduce(lambda a, b: a + b, [F.element_at(literal_vector(row), code[p] + 1) for p, row in enumerate(self.adc_table(np.asarray(query, float)))])


def train_pq(data: DataFrame, config: PQConfig | None = None, seed: int = 42) -> Codebooks:
    """Fits one codebook for each position to a bounded sample of data(id, vector), positions in parallel; position p has seed + p."""
    config = config or PQConfig()
    if config.m <= 0:
        raise ValueError("m must be greater than 0")
    if not 1 <= config.k <= 256:
        raise ValueError("k must be between 1 and 256")
    first = data.select(F.size("vector").alias("n")).first()
    if first is None:
        raise ValueError("cannot train on an empty table")
    if first.n % config.m:
        raise ValueError(f"dimension {first.n} must be divisible by m ({config.m})")
    size = first.n // config.m
    sample = data.orderBy(F.xxhash64("id"), "id").limit(SEED_SAMPLE)
    parts = sample.select("id", F.posexplode(F.array(*(subvector("vector", p, size) for p in range(config.m)))).alias("pos", "v"))

    def fit(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.array(pdf.sort_values("id").v.to_list(), float)
        if len(x) < config.k:
            raise ValueError(f"training needs at least {config.k} vectors, got {len(x)}")
        c = plus_plus(x, config.k, seed + key[0])
        for _ in range(config.iterations):
            own = nearest(x, c)
            n, total = np.bincount(own, minlength=len(c)), (own == np.arange(len(c))[:, None]).astype(float) @ x
            moved = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], c)
            gap = np.sqrt(((moved - c) ** 2).sum(1)).sum()
            c = moved
            if gap < 1e-4:
                break
        return pd.DataFrame({"pos": [key[0]] * len(c), "code": range(len(c)), "v": list(c)})

    rows = parts.groupBy("pos").applyInPandas(fit, "pos int, code int, v array<double>").collect()
    out = np.zeros((config.m, config.k, size))
    for r in rows:
        out[r.pos, r.code] = r.v
    return Codebooks(out)


def encode_table(points: DataFrame, books: Codebooks) -> DataFrame:
    """(id, code): the codes of points(id, vector) as m bytes."""

    def run(batches):
        for batch in batches:
            codes = books.encode(matrix(batch.column(1), books.dim))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([c.tobytes() for c in codes], pa.binary())], ["id", "code"])

    return points.select(F.col("id").cast("long"), F.col("vector").cast("array<double>")).mapInArrow(run, "id long, code binary")


@dataclass(frozen=True)
class IVFPQIndex:
    """Codes by nearest centroid; the vectors themselves aren't kept. Scores are approximate squared Euclidean distances."""

    dim: int
    clusters: int
    config: PQConfig
    centroids: np.ndarray | None
    books: Codebooks | None
    codes: DataFrame  # (id, code, cluster_id)
    tombstones: DataFrame

    @staticmethod
    def create(spark: SparkSession, dim: int, clusters: int, config: PQConfig | None = None) -> IVFPQIndex:
        config = config or PQConfig()
        if dim <= 0 or clusters <= 0 or config.m <= 0:
            raise ValueError("dimension, number of clusters and m must be greater than 0")
        if dim % config.m:
            raise ValueError(f"dimension {dim} must be divisible by m ({config.m})")
        if not 1 <= config.k <= 256:
            raise ValueError("k must be between 1 and 256")
        return IVFPQIndex(dim, clusters, config, None, None, spark.createDataFrame([], "id long, code binary, cluster_id int"), spark.createDataFrame([], "id long"))

    @property
    def is_trained(self) -> bool:
        return self.books is not None

    def train(self, data: DataFrame, config: KMeansConfig | None = None, ivf_seed: int = 42, pq_seed: int = 42) -> IVFPQIndex:
        """Fits centroids and codebooks; if either fails, nothing changes."""
        config = config or KMeansConfig(k=self.clusters)
        if config.k != self.clusters:
            raise ValueError(f"k ({config.k}) must equal the number of clusters ({self.clusters})")
        return self.with_model(kmeans(data, config, ivf_seed).centroids, train_pq(data, self.config, pq_seed))

    def with_model(self, centroids: np.ndarray, books: Codebooks) -> IVFPQIndex:
        return replace(self, centroids=np.asarray(centroids, float), books=books)

    def _trained(self) -> tuple[np.ndarray, Codebooks]:
        if self.centroids is None or self.books is None:
            raise ValueError("index must be trained first")
        return self.centroids, self.books

    def add_batch(self, rows: DataFrame) -> IVFPQIndex:
        """Adds rows(id, vector): nearest centroid, and the code of the vector itself. Repeated ids are an error."""
        centroids, books = self._trained()
        twice = rows.groupBy("id").count().where("count > 1").select("id")
        known = rows.join(self.codes.select("id"), "id", "left_semi").select("id")
        if (found := twice.union(known).limit(1).collect()):
            raise ValueError(f"duplicate id: {found[0].id}")

        def run(batches):
            for batch in batches:
                x = matrix(batch.column(1), books.dim)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([c.tobytes() for c in books.encode(x)], pa.binary()), pa.array(nearest(x, centroids).astype(np.int32))], ["id", "code", "cluster_id"])

        new = rows.select(F.col("id").cast("long").alias("id"), F.col("vector").cast("array<double>").alias("vector")).mapInArrow(run, self.codes.schema)
        return replace(self, codes=self.codes.unionByName(new))

    def add(self, id: int, vector: list[float]) -> IVFPQIndex:
        return self.add_batch(self.codes.sparkSession.createDataFrame([(id, [float(x) for x in vector])], "id long, vector array<double>"))

    def live(self) -> DataFrame:
        return self.codes.join(self.tombstones, "id", "left_anti")

    def delete(self, id: int) -> IVFPQIndex:
        if self.live().where(F.col("id") == id).isEmpty():
            raise ValueError(f"id not found: {id}")
        return replace(self, tombstones=self.tombstones.union(self.codes.sparkSession.createDataFrame([(id,)], "id long")))

    def compact(self) -> IVFPQIndex:
        return replace(self, codes=self.live().select(*self.codes.columns), tombstones=self.tombstones.limit(0))

    def update(self, id: int, vector: list[float]) -> IVFPQIndex:
        return self.delete(id).compact().add(id, vector)

    def __len__(self) -> int:
        return self.live().count()

    def total_records(self) -> int:
        return self.codes.count()

    def is_empty(self) -> bool:
        return self.live().isEmpty()

    def cluster_sizes(self) -> DataFrame:
        """(cluster_id, size), deleted rows counted until compact()."""
        every = self.codes.sparkSession.range(self.clusters).select(F.col("id").cast("int").alias("cluster_id"))
        sizes = self.codes.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("size"))
        return every.join(sizes, "cluster_id", "left").select("cluster_id", F.coalesce("size", F.lit(0)).cast("long").alias("size"))

    def save(self, path: str) -> None:
        """Writes the live codes into one folder for each cluster, and the model; the vectors themselves aren't kept."""
        centroids, books = self._trained()
        deal = F.pmod(F.xxhash64("id"), F.lit(16))
        self.live().repartition("cluster_id", deal).write.partitionBy("cluster_id").parquet(f"{path}/codes")
        write_json(self.codes.sparkSession, f"{path}/model.json", {"dim": self.dim, "clusters": self.clusters, "config": self.config.__dict__, "centroids": centroids.tolist(), "books": books.values.tolist()})

    @staticmethod
    def load(spark: SparkSession, path: str) -> IVFPQIndex:
        """The index that save() wrote; a search reads the folders of the clusters that it probes."""
        model = read_json(spark, f"{path}/model.json")
        codes = spark.read.schema("id long, code binary, cluster_id int").parquet(f"{path}/codes")
        return replace(IVFPQIndex.create(spark, model["dim"], model["clusters"], PQConfig(**model["config"])).with_model(np.array(model["centroids"]), Codebooks(np.array(model["books"]))), codes=codes)

    def memory_footprint_bytes(self) -> int:
        """Codes, centroids and codebooks, at 4 bytes a number."""
        return self.total_records() * self.config.m + self.clusters * self.dim * 4 + self.config.m * self.config.k * (self.dim // self.config.m) * 4

    def search_batch(self, queries: DataFrame, k: int, nprobe: int = 1) -> DataFrame:
        """(qid, rank, id, score): one table of distances for each query, m lookups a row. nprobe is at least 1."""
        centroids, books = self._trained()
        parts = []
        for qids, x in query_blocks(queries):
            books.check(x.shape[1])
            wanted: dict[int, list[int]] = {}
            for i, q in enumerate(x):
                for c in nearest_clusters(q, centroids, max(1, nprobe)):
                    wanted.setdefault(c, []).append(i)
            tables = np.stack([books.adc_table(q) for q in x])
            parts.append(_scan_codes(self.live(), qids, tables, wanted, k))
        if not parts or k <= 0:
            return self.codes.sparkSession.createDataFrame([], RESULT)
        return top_k_per_query(reduce(DataFrame.unionByName, parts), k, largest=False)

    def search(self, query: list[float], k: int, nprobe: int = 1) -> DataFrame:
        q = self.codes.sparkSession.createDataFrame([(0, [float(x) for x in query])], "qid long, vector array<double>")
        return top_k_smallest(self.search_batch(q, k, nprobe).select("id", "score"), k)


def _scan_codes(codes: DataFrame, qids: np.ndarray, tables: np.ndarray, wanted: dict[int, list[int]], k: int) -> DataFrame:
    m = tables.shape[1]

    def run(batches):
        kept = [(np.zeros(0, np.int64), np.zeros(0))] * len(qids)
        for batch in batches:
            ids, clusters = batch.column(0).to_numpy(zero_copy_only=False), batch.column(2).to_numpy(zero_copy_only=False)
            own = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(-1, m)
            for c in np.unique(clusters).tolist():
                rows = np.flatnonzero(clusters == c)
                for i in wanted.get(c, []):
                    a, b = np.concatenate([kept[i][0], ids[rows]]), np.concatenate([kept[i][1], Codebooks.adc_distances(tables[i], own[rows])])
                    order = best_columns(b, a, k, False)
                    kept[i] = (a[order], b[order])
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(qids, [len(a) for a, _ in kept])), pa.array(np.concatenate([a for a, _ in kept])), pa.array(np.concatenate([b for _, b in kept]))], ["qid", "id", "score"])

    return codes.where(F.col("cluster_id").isin(list(wanted))).select("id", "code", "cluster_id").mapInArrow(run, "qid long, id long, score double")
