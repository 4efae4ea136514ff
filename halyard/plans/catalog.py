"""Named collections on shared storage: versioned snapshots, an append-only operation log, and the engine over them.

A collection is a folder with `log/N` (Parquet files of the ops(seq, op, id, vector) after version N) and `v=N`
snapshots. The registry file
of a collection names its current version and the last operation in it. A snapshot is complete before the registry
names it, and operations up to that one are skipped on reading, so a crash at any point loses and repeats nothing.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from halyard.functions.vector import metric_name
from halyard.operators.collection import POINTS, FlatCollection, latest_points
from halyard.operators.hnsw import HnswIndex
from halyard.operators.ivf import IVFIndex
from halyard.operators.pq import IVFPQIndex, PQConfig
from halyard.plans.storage import file_system, read_json, write_json

OPS = "seq long, op string, id long, vector array<float>"
INDEX_TYPES = ("flat", "ivf", "hnsw", "ivfpq")
#: Limits of requests.
MAX_K, MAX_EF, MAX_DIM, MAX_NAME = 10_000, 2_048, 65_536, 64


def validate_name(name: str) -> str:
    if not name or len(name) > MAX_NAME or not re.fullmatch(r"[A-Za-z0-9_-]+", name):
        raise ValueError("a collection name has 1 to 64 letters, digits, underscores and hyphens")
    return name


def validate_vector(vector: list[float], dim: int) -> list[float]:
    if not vector or not all(math.isfinite(x) for x in vector):
        raise ValueError("a vector needs components, all finite")
    if len(vector) != dim:
        raise ValueError(f"vector dimension mismatch: expected {dim}, got {len(vector)}")
    return [float(x) for x in vector]


def validate_search(k: int, ef: int = 50, nprobe: int = 1) -> None:
    if not 1 <= k <= MAX_K:
        raise ValueError(f"k must be between 1 and {MAX_K}")
    if not 1 <= ef <= MAX_EF:
        raise ValueError(f"ef must be between 1 and {MAX_EF}")
    if nprobe < 0:
        raise ValueError("nprobe must not be negative")


class NotFound(KeyError):
    """No collection of that name."""


class Conflict(ValueError):
    """A collection or an id that there is already."""


@dataclass(frozen=True)
class Info:
    name: str
    dim: int
    index_type: str
    metric: str
    version: int = 0
    seq: int = 0  # the last operation that the snapshot holds


class Engine:
    """Collections below a folder of any file system that Spark reads. One writer at a time for each collection."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self._built: dict[tuple[str, int, int], HnswIndex | IVFIndex | IVFPQIndex] = {}

    def _fs(self, path: str):
        return file_system(self.spark, path)

    def _write_info(self, info: Info) -> None:
        write_json(self.spark, f"{self.root}/{info.name}/.registry.tmp", info.__dict__)
        fs, tmp = self._fs(f"{self.root}/{info.name}/.registry.tmp")
        _, final = self._fs(f"{self.root}/{info.name}/registry.json")
        fs.delete(final, False)
        fs.rename(tmp, final)

    def info(self, name: str) -> Info:
        validate_name(name)
        for file in ("registry.json", ".registry.tmp"):  # the second, if a swap was cut off between its two steps
            fs, p = self._fs(f"{self.root}/{name}/{file}")
            if fs.exists(p):
                return Info(**read_json(self.spark, f"{self.root}/{name}/{file}"))
        raise NotFound(name)

    def create_collection(self, name: str, dim: int, index_type: str = "flat", metric: str = "euclidean") -> Info:
        validate_name(name)
        index_type = index_type.lower()
        if index_type not in INDEX_TYPES:
            raise ValueError(f"unknown index type {index_type!r}: expected flat, ivf, hnsw or ivfpq")
        if not 1 <= dim <= MAX_DIM:
            raise ValueError(f"dimension must be between 1 and {MAX_DIM}")
        try:
            self.info(name)
        except NotFound:
            info = Info(name, dim, index_type, metric_name(metric) if index_type != "ivfpq" else "euclidean")
            self._write_info(info)
            return info
        raise Conflict(f"collection {name} exists")

    def list_collections(self) -> DataFrame:
        """(name, dim, index_type, metric, vector_count), by name."""
        fs, p = self._fs(self.root)
        names = sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []
        rows = [(i.name, i.dim, i.index_type, i.metric, self.points(i.name).count()) for i in map(self.info, names)]
        return self.spark.createDataFrame(rows, "name string, dim int, index_type string, metric string, vector_count long")

    def delete_collection(self, name: str) -> None:
        self.info(name)
        fs, p = self._fs(f"{self.root}/{name}")
        fs.delete(p, True)

    def _log(self, info: Info) -> DataFrame:
        """The operations after the snapshot; each version has a log folder of its own."""
        path = f"{self.root}/{info.name}/log/{info.version}"
        fs, p = self._fs(path)
        ops = self.spark.read.schema(OPS).parquet(path) if fs.exists(p) else self.spark.createDataFrame([], OPS)
        return ops.where(F.col("seq") > info.seq)

    def points(self, name: str) -> DataFrame:
        """The live points: the snapshot with the operations after it."""
        info = self.info(name)
        snapshot = self.spark.read.schema(POINTS).parquet(f"{self.root}/{name}/v={info.version}") if info.version else self.spark.createDataFrame([], POINTS)
        first = snapshot.select(F.lit(0).cast("long").alias("seq"), F.lit("insert").alias("op"), "id", "vector")
        return latest_points(first.unionByName(self._log(info)))

    def _append(self, name: str, rows: DataFrame, op: str) -> None:
        """Appends one batch of rows(id, vector); its file appears at once or not at all."""
        info = self.info(name)
        top = self._log(info).agg(F.max("seq")).first()[0] or info.seq
        rows.select(F.lit(top + 1).cast("long").alias("seq"), F.lit(op).alias("op"), "id", "vector").write.mode("append").parquet(f"{self.root}/{name}/log/{info.version}")

    def insert(self, name: str, id: int, vector: list[float]) -> None:
        info = self.info(name)
        if info.index_type in ("ivf", "ivfpq"):
            raise ValueError(f"points can't be inserted one by one into {info.index_type} collections")
        if id < 0:
            raise ValueError("id must not be negative")
        self.insert_batch(name, self.spark.createDataFrame([(id, validate_vector(vector, info.dim))], POINTS))

    def insert_batch(self, name: str, rows: DataFrame) -> None:
        info = self.info(name)
        live = FlatCollection.from_table(self.points(name), "id", "vector", info.dim, info.metric)
        try:
            live.add_batch(rows)
        except ValueError as e:
            raise (Conflict(str(e)) if "duplicate" in str(e) else e) from None
        self._append(name, rows.select(F.col("id").cast("long").alias("id"), F.col("vector").cast("array<float>").alias("vector")), "insert")

    def delete(self, name: str, id: int) -> None:
        if self.points(name).where(F.col("id") == id).isEmpty():
            raise ValueError(f"id not found: {id}")
        self._append(name, self.spark.createDataFrame([(id, None)], POINTS), "delete")

    def checkpoint(self, name: str) -> Info:
        """Writes the live points as the next version, names it, and then drops the older versions and their logs.

        Readers of the version before keep what they have read; the one just replaced stays until the next checkpoint.
        """
        info = self.info(name)
        top = self._log(info).agg(F.max("seq")).first()[0] or info.seq
        self.points(name).write.mode("overwrite").parquet(f"{self.root}/{name}/v={info.version + 1}")
        info = Info(name, info.dim, info.index_type, info.metric, info.version + 1, top)
        self._write_info(info)
        for folder, keep in (("log", lambda n: n), ("", lambda n: n.removeprefix("v=") if n.startswith("v=") else "")):
            fs, p = self._fs(f"{self.root}/{name}/{folder}".rstrip("/"))
            for status in fs.listStatus(p) if fs.exists(p) else []:
                number = keep(status.getPath().getName())
                if number.isdigit() and int(number) < info.version - 1:
                    fs.delete(status.getPath(), True)
        return info

    def checkpoint_all(self) -> dict[str, str]:
        """Checkpoints every collection; one that fails doesn't keep the others from it. Errors by name."""
        failed = {}
        for row in self.list_collections().collect():
            try:
                self.checkpoint(row.name)
            except Exception as e:  # noqa: BLE001
                failed[row.name] = str(e)
        return failed

    def search(self, name: str, query: list[float], k: int, ef: int = 50, nprobe: int = 1) -> DataFrame:
        """(rank, id, score)."""
        info = self.info(name)
        validate_search(k, ef, nprobe)
        query = validate_vector(query, info.dim)
        points = self.points(name)
        if info.index_type == "flat":
            return FlatCollection.from_table(points, "id", "vector", info.dim, info.metric).search(query, k)
        key = (name, info.version, self._log(info).agg(F.max("seq")).first()[0] or info.seq)
        if key not in self._built:
            self._built = {k: v for k, v in self._built.items() if k[0] != name} | {key: self._build(info, points)}
        index = self._built[key]
        return index.search(query, k, ef) if isinstance(index, HnswIndex) else index.search(query, k, nprobe)

    def _build(self, info: Info, points: DataFrame) -> HnswIndex | IVFIndex | IVFPQIndex:
        if info.index_type == "hnsw":
            return HnswIndex.create(self.spark, info.dim, info.metric).insert_batch(points)
        if info.index_type == "ivf":
            index = IVFIndex.create(self.spark, info.dim, 4, info.metric)
        else:
            config = PQConfig(m=2 if info.dim % 2 == 0 else 1, k=min(256, 2 ** min(info.dim, 8)))
            index = IVFPQIndex.create(self.spark, info.dim, 4, config)
        return index.train(points).add_batch(points)
