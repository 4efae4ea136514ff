"""Hash sharding of a collection, and searches that fan out over the shards."""

from __future__ import annotations

import threading
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from halyard.operators.collection import POINTS, FlatCollection
from halyard.plans.storage import read_json, write_json


def splitmix64(ids: np.ndarray) -> np.ndarray:
    """The finaliser of the SplitMix64 generator over unsigned 64-bit ids."""
    with np.errstate(over="ignore"):
        z = ids.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


def shard_for_id(id: Column | str, shards: int) -> Column:
    """The shard of an id: SplitMix64 modulo the number of shards. Spark has no wrapping product, so this runs over Arrow batches."""
    if shards <= 0:
        raise ValueError("number of shards must be greater than zero")

    @F.pandas_udf("int")
    def shard(ids: pd.Series) -> pd.Series:
        return pd.Series((splitmix64(ids.to_numpy()) % np.uint64(shards)).astype(np.int32))

    return shard(F.col(id) if isinstance(id, str) else id)


@dataclass(frozen=True)
class ShardedCollection:
    """A flat collection whose rows belong to shards by a hash of their ids. Searches equal those without shards."""

    flat: FlatCollection
    shards: int
    #: Points with their shard, as folders, if the collection was loaded and nothing was added since.
    saved: DataFrame | None = None

    @staticmethod
    def create(spark: SparkSession, dim: int, shards: int, metric: str = "euclidean") -> ShardedCollection:
        if shards <= 0:
            raise ValueError("number of shards must be greater than zero")
        return ShardedCollection(FlatCollection.create(spark, dim, metric), shards)

    def add(self, id: int, vector: list[float]) -> ShardedCollection:
        return replace(self, flat=self.flat.add(id, vector, strict=True), saved=None)

    def add_batch(self, rows: DataFrame) -> ShardedCollection:
        return replace(self, flat=self.flat.add_batch(rows), saved=None)

    def points(self) -> DataFrame:
        """Live points with their shard."""
        return self.flat.live().withColumn("shard", shard_for_id("id", self.shards))

    def __len__(self) -> int:
        return len(self.flat)

    def shard_sizes(self) -> DataFrame:
        """(shard, size) of every shard, empty ones too."""
        every = self.flat.spark.range(self.shards).select(F.col("id").cast("int").alias("shard"))
        sizes = self.points().groupBy("shard").agg(F.count(F.lit(1)).alias("size"))
        return every.join(sizes, "shard", "left").select("shard", F.coalesce("size", F.lit(0)).cast("long").alias("size"))

    def save(self, path: str) -> None:
        """Writes the live points into one folder for each shard, and what load() needs."""
        self.points().repartition("shard").write.partitionBy("shard").parquet(f"{path}/points")
        write_json(self.flat.spark, f"{path}/collection.json", {"dim": self.flat.dim, "shards": self.shards, "metric": self.flat.metric})

    @staticmethod
    def load(spark: SparkSession, path: str) -> ShardedCollection:
        """The collection that save() wrote; point lookups read one shard's folder."""
        held = read_json(spark, f"{path}/collection.json")
        points = spark.read.schema(POINTS + ", shard int").parquet(f"{path}/points")
        flat = FlatCollection(points.select("id", "vector"), spark.createDataFrame([], "id long"), held["dim"], held["metric"])
        return ShardedCollection(flat, held["shards"], points)

    @property
    def dim(self) -> int:
        return self.flat.dim

    @property
    def metric(self) -> str:
        return self.flat.metric

    def is_empty(self) -> bool:
        return self.flat.is_empty()

    def lookup(self, id: int) -> DataFrame:
        """(id, vector) of a live point: from the folder of its shard alone, where the collection was loaded."""
        rows = self.flat.live() if self.saved is None else self.saved.where(F.col("shard") == int(splitmix64(np.array([id]))[0] % np.uint64(self.shards))).join(self.flat.tombstones, "id", "left_anti")
        return rows.where(F.col("id") == id).select("id", "vector")

    def search(self, query: list[float], k: int, parallel: bool = True) -> DataFrame:
        """(rank, id, score). Tasks search their rows at the same time whatever `parallel` says; it is accepted for its name."""
        return self.flat.search(query, k)

    def search_batch(self, queries: DataFrame, k: int) -> DataFrame:
        """(qid, rank, id, score): local lists of every task, then one merge."""
        return self.flat.search_batch(queries, k)


class ConcurrentCollection:
    """A current version that any number of threads read while one at a time replaces it.

    A version is immutable, so a reader goes on with the one it took. A change that raises publishes nothing.
    """

    def __init__(self, flat: FlatCollection) -> None:
        self._flat, self._lock = flat, threading.Lock()

    @property
    def current(self) -> FlatCollection:
        return self._flat

    def change(self, f: Callable[[FlatCollection], FlatCollection]) -> FlatCollection:
        with self._lock:
            self._flat = f(self._flat)
            return self._flat

    def add(self, id: int, vector: list[float]) -> None:
        self.change(lambda c: c.add(id, vector, strict=True))

    def add_batch(self, rows: DataFrame) -> None:
        self.change(lambda c: c.add_batch(rows))

    def search(self, query: list[float], k: int) -> DataFrame:
        return self.current.search(query, k)

    def __len__(self) -> int:
        return len(self.current)

    def __iter__(self) -> Iterator:
        return iter(self.current.live().toLocalIterator())
