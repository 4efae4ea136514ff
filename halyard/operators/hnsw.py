"""Navigable small-world graphs, one for each shard, and their search.

A graph is built row by row, so it has no relational form: rows are hashed to shards of a bounded size, each shard's
graph is built by one grouped call and kept as a row, and a search merges the shards' lists. Building and walking go by
Euclidean distance whatever the metric; the metric scores what the walk found.
"""

from __future__ import annotations

import heapq
import io
import math
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from halyard.functions.vector import larger_is_better, metric_name, score_matrix
from halyard.operators.collection import POINTS
from halyard.operators.search import RESULT, query_blocks
from halyard.operators.sharding import splitmix64
from halyard.operators.topk import best_columns, top_k_per_query
from halyard.plans.storage import read_json, write_json

SHARD_ROWS = 10_000
#: Graphs aren't made smaller than this for the sake of more tasks.
LEAST_ROWS = 256


@dataclass(frozen=True)
class HnswConfig:
    m: int = 16
    ef_construction: int = 200
    ef_search: int = 50


def ml_factor(m: int) -> float:
    """1 / ln m: the scale of the layers."""
    if m <= 1:
        raise ValueError("m must be greater than 1")
    return 1 / math.log(m)


def layer_from_uniform(u: float, ml: float) -> int:
    return int(-math.log(min(1.0, max(u, np.finfo(np.float32).eps))) * ml)


def layer_column(u: Column | str, m: int) -> Column:
    u = F.col(u) if isinstance(u, str) else u
    return F.floor(-F.ln(F.least(F.lit(1.0), F.greatest(u, F.lit(float(np.finfo(np.float32).eps))))) * ml_factor(m)).cast("int")


def layers_of(ids: np.ndarray, m: int, seed: int = 0) -> np.ndarray:
    """Top layers drawn from a hash of the ids: the same however the rows are dealt out."""
    u = (splitmix64(ids.astype(np.uint64) ^ np.uint64(seed)) >> np.uint64(11)).astype(float) / 2**53
    ml = ml_factor(m)
    return np.array([layer_from_uniform(x, ml) for x in u.tolist()], np.int64)


class Graph:
    """One shard's graph; neighbours are places of the shard's rows."""

    def __init__(self, dim: int, config: HnswConfig) -> None:
        self.config, self.x = config, np.zeros((0, dim))
        self.ids: list[int] = []
        self.neighbours: list[list[list[int]]] = []
        self.entry: int | None = None

    def _gaps(self, q: np.ndarray, rows: list[int]) -> np.ndarray:
        return ((self.x[rows] - q) ** 2).sum(1)

    def search_layer(self, q: np.ndarray, starts: list[int], layer: int, ef: int) -> list[tuple[float, int]]:
        """The ef nearest rows that a best-first walk of one layer meets: (squared distance, row), nearest first."""
        seen = set(starts)
        gaps = self._gaps(q, starts).tolist()
        front = list(zip(gaps, starts, strict=True))
        heapq.heapify(front)
        best = [(-g, -r) for g, r in front]
        heapq.heapify(best)
        while len(best) > ef:
            heapq.heappop(best)
        while front:
            gap, row = heapq.heappop(front)
            if len(best) >= ef and gap > -best[0][0]:
                break
            new = [n for n in self.neighbours[row][layer] if n not in seen] if layer < len(self.neighbours[row]) else []
            if not new:
                continue
            seen.update(new)
            for g, n in zip(self._gaps(q, new).tolist(), new, strict=True):
                if len(best) < ef or g < -best[0][0]:
                    heapq.heappush(front, (g, n))
                    heapq.heappush(best, (-g, -n))
                    if len(best) > ef:
                        heapq.heappop(best)
        return sorted((-g, -r) for g, r in best)

    def _closest(self, row: int, others: list[int], most: int) -> list[int]:
        gaps = self._gaps(self.x[row], others)
        return [others[i] for i in np.argsort(gaps, kind="stable")[:most].tolist()]

    def insert(self, row: int, top: int) -> None:
        q = self.x[row]
        self.neighbours.append([[] for _ in range(top + 1)])
        if self.entry is None:
            self.entry = row
            return
        start, high = [self.entry], len(self.neighbours[self.entry]) - 1
        for layer in range(high, top, -1):
            start = [self.search_layer(q, start, layer, 1)[0][1]]
        for layer in range(min(top, high), -1, -1):
            found = self.search_layer(q, start, layer, self.config.ef_construction)
            own = [r for _, r in found[: self.config.m]]
            self.neighbours[row][layer] = own
            most = 2 * self.config.m if layer == 0 else self.config.m
            for n in own:
                links = self.neighbours[n][layer]
                links.append(row)
                if len(links) > most:
                    self.neighbours[n][layer] = self._closest(n, links, most)
            start = [r for _, r in found]
        if top > high:
            self.entry = row

    def extend(self, ids: np.ndarray, x: np.ndarray, seed: int = 0) -> Graph:
        """Inserts rows one after the other into the graph as it stands."""
        first = len(self.ids)
        self.x, self.ids = np.concatenate([self.x, x]), self.ids + ids.tolist()
        for row, top in enumerate(layers_of(ids, self.config.m, seed).tolist(), first):
            self.insert(row, top)
        return self

    @staticmethod
    def build(ids: np.ndarray, x: np.ndarray, config: HnswConfig, seed: int = 0) -> Graph:
        return Graph(x.shape[1], config).extend(ids, x, seed)

    def search(self, q: np.ndarray, ef: int) -> list[int]:
        """The places of the ef rows that the walk ends with."""
        if self.entry is None:
            return []
        start = [self.entry]
        for layer in range(len(self.neighbours[self.entry]) - 1, 0, -1):
            start = [self.search_layer(q, start, layer, 1)[0][1]]
        return [r for _, r in self.search_layer(q, start, 0, ef)]

    def pack(self) -> bytes:
        flat, sizes, tops = [], [], []
        for layers in self.neighbours:
            tops.append(len(layers))
            for links in layers:
                sizes.append(len(links))
                flat += links
        out = io.BytesIO()
        np.savez(out, ids=np.array(self.ids, np.int64), x=self.x, flat=np.array(flat, np.int64), sizes=np.array(sizes, np.int64), tops=np.array(tops, np.int64), entry=np.array([-1 if self.entry is None else self.entry]))
        return out.getvalue()

    @staticmethod
    def unpack(blob: bytes, config: HnswConfig) -> Graph:
        with np.load(io.BytesIO(blob), allow_pickle=False) as held:
            g = Graph(held["x"].shape[1], config)
            g.x, g.ids = held["x"], held["ids"].tolist()
            flat, at, layer = held["flat"].tolist(), 0, iter(held["sizes"].tolist())
            for top in held["tops"].tolist():
                own = []
                for _ in range(top):
                    n = next(layer)
                    own.append(flat[at : at + n])
                    at += n
                g.neighbours.append(own)
            entry = int(held["entry"][0])
            g.entry = None if entry < 0 else entry
        return g


@dataclass(frozen=True)
class HnswIndex:
    """points(id, vector), the graphs(shard, graph) built over them, and tombstones. Rows go to one of `shards` by a hash of their id."""

    dim: int
    metric: str
    config: HnswConfig
    points: DataFrame
    graphs: DataFrame | None
    tombstones: DataFrame
    shards: int = 1

    @staticmethod
    def create(spark: SparkSession, dim: int, metric: str = "euclidean", config: HnswConfig | None = None) -> HnswIndex:
        if dim <= 0:
            raise ValueError("dimension must be greater than 0")
        config = config or HnswConfig()
        ml_factor(config.m)
        return HnswIndex(dim, metric_name(metric), config, spark.createDataFrame([], POINTS), None, spark.createDataFrame([], "id long"))

    def insert_batch(self, rows: DataFrame, shard_rows: int = SHARD_ROWS) -> HnswIndex:
        """Adds rows(id, vector); repeated ids are an error.

        New rows are inserted into the graphs as they stand, each shard by one task. The graphs are built anew, over
        more shards, once these would hold twice shard_rows rows on the average, and where a deleted id comes back.
        """
        rows = rows.select(F.col("id").cast("long").alias("id"), F.col("vector").cast("array<float>").alias("vector"))
        if not rows.where(F.size("vector") != self.dim).isEmpty():
            raise ValueError(f"vector dimension mismatch: expected {self.dim}")
        both = self.points.join(self.tombstones, "id", "left_anti").unionByName(rows)
        if not both.groupBy("id").count().where("count > 1").isEmpty():
            raise ValueError("duplicate id")
        again = self.graphs is None or not rows.join(self.tombstones, "id", "left_semi").isEmpty()
        if again or self.points.count() + rows.count() > 2 * shard_rows * self.shards:
            return replace(self, points=both, tombstones=self.tombstones.limit(0)).rebuild(shard_rows)
        dim, config = self.dim, self.config

        def grow(key: tuple, held: pd.DataFrame, new: pd.DataFrame) -> pd.DataFrame:
            graph = Graph.unpack(held.graph.iloc[0], config) if len(held) else Graph(dim, config)
            if len(new):
                new = new.sort_values("id")
                graph.extend(new.id.to_numpy(), np.array(new.vector.to_list(), float))
            return pd.DataFrame({"shard": [key[0]], "graph": [graph.pack()]})

        dealt = rows.withColumn("shard", self._shard(self.shards))
        graphs = self.graphs.groupBy("shard").cogroup(dealt.groupBy("shard")).applyInPandas(grow, "shard int, graph binary")
        return replace(self, points=self.points.unionByName(rows), graphs=graphs.cache())

    @staticmethod
    def _shard(shards: int) -> Column:
        return F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int")

    def rebuild(self, shard_rows: int = SHARD_ROWS) -> HnswIndex:
        """Builds the graphs of all points: shards of shard_rows at most on the average, and smaller ones, down to LEAST_ROWS, while cores are free."""
        n, config = self.points.count(), self.config
        cores = self.points.sparkSession.sparkContext.defaultParallelism
        shards = -(-n // min(shard_rows, max(LEAST_ROWS, -(-n // cores)))) or 1

        def build(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("id")
            graph = Graph.build(pdf.id.to_numpy(), np.array(pdf.vector.to_list(), float), config)
            return pd.DataFrame({"shard": [key[0]], "graph": [graph.pack()]})

        dealt = self.points.withColumn("shard", self._shard(shards)).repartition(shards, "shard")
        graphs = dealt.groupBy("shard").applyInPandas(build, "shard int, graph binary")
        self.release()
        return replace(self, graphs=graphs.cache(), shards=shards)

    def release(self) -> None:
        """Gives back the memory that keeps the graphs; they are built again when asked for."""
        if self.graphs is not None:
            self.graphs.unpersist()

    def save(self, path: str) -> None:
        """Writes points, graphs, tombstones and configuration."""
        spark = self.points.sparkSession
        self.points.write.parquet(f"{path}/points")
        (spark.createDataFrame([], "shard int, graph binary") if self.graphs is None else self.graphs).write.parquet(f"{path}/graphs")
        self.tombstones.write.parquet(f"{path}/tombstones")
        write_json(spark, f"{path}/index.json", {"dim": self.dim, "metric": self.metric, "config": self.config.__dict__, "shards": self.shards, "built": self.graphs is not None})

    @staticmethod
    def load(spark: SparkSession, path: str) -> HnswIndex:
        """The index that save() wrote; its graphs are read, not built."""
        held = read_json(spark, f"{path}/index.json")
        graphs = spark.read.schema("shard int, graph binary").parquet(f"{path}/graphs") if held["built"] else None
        points, tombstones = spark.read.schema(POINTS).parquet(f"{path}/points"), spark.read.schema("id long").parquet(f"{path}/tombstones")
        return HnswIndex(held["dim"], held["metric"], HnswConfig(**held["config"]), points, graphs, tombstones, held["shards"])

    def delete(self, id: int) -> HnswIndex:
        """The row stays in the graph, where walks cross it, and is left out of results."""
        if self.points.join(self.tombstones, "id", "left_anti").where(F.col("id") == id).isEmpty():
            raise ValueError(f"id not found: {id}")
        return replace(self, tombstones=self.tombstones.union(self.points.sparkSession.createDataFrame([(id,)], "id long")))

    def compact(self) -> HnswIndex:
        """Builds the graphs anew without the deleted rows."""
        return replace(self, points=self.points.join(self.tombstones, "id", "left_anti"), tombstones=self.tombstones.limit(0)).rebuild()

    def __len__(self) -> int:
        return self.points.join(self.tombstones, "id", "left_anti").count()

    def total_nodes(self) -> int:
        return self.points.count()

    def get_vector(self, id: int) -> list[float] | None:
        row = self.points.where(F.col("id") == id).first()
        return None if row is None else list(row.vector)

    def nodes(self) -> DataFrame:
        """(shard, node, id, max_layer, neighbours): the graphs as a table; neighbours are nodes of the shard."""
        config = self.config

        def run(pdfs):
            for pdf in pdfs:
                for shard, blob in zip(pdf.shard, pdf.graph, strict=True):
                    g = Graph.unpack(blob, config)
                    yield pd.DataFrame({"shard": shard, "node": range(len(g.ids)), "id": g.ids, "max_layer": [len(n) - 1 for n in g.neighbours], "neighbours": g.neighbours})

        if self.graphs is None:
            return self.points.sparkSession.createDataFrame([], "shard int, node int, id long, max_layer int, neighbours array<array<int>>")
        return self.graphs.mapInPandas(run, "shard int, node int, id long, max_layer int, neighbours array<array<int>>")

    def internal_index_of(self, id: int) -> tuple[int, int] | None:
        """The shard and the node of an id, deleted ones too."""
        row = self.nodes().where(F.col("id") == id).select("shard", "node").first()
        return None if row is None else (row.shard, row.node)

    def entry_points(self) -> DataFrame:
        """(shard, node, id, max_layer) at which the walks of each shard start: a node of its highest layer."""
        config = self.config

        def run(pdfs):
            for pdf in pdfs:
                for shard, blob in zip(pdf.shard, pdf.graph, strict=True):
                    g = Graph.unpack(blob, config)
                    if g.entry is not None:
                        yield pd.DataFrame({"shard": [shard], "node": [g.entry], "id": [g.ids[g.entry]], "max_layer": [len(g.neighbours[g.entry]) - 1]})

        schema = "shard int, node int, id long, max_layer int"
        return self.points.sparkSession.createDataFrame([], schema) if self.graphs is None else self.graphs.mapInPandas(run, schema)

    def max_layer_distribution(self) -> DataFrame:
        return self.nodes().groupBy("max_layer").agg(F.count(F.lit(1)).alias("count"))

    def search_batch(self, queries: DataFrame, k: int, ef: int | None = None) -> DataFrame:
        """(qid, rank, id, score). Deleted rows take places of the ef, so fewer than k may be left."""
        ef, metric, config, largest = ef or self.config.ef_search, self.metric, self.config, larger_is_better(self.metric)
        if self.graphs is None or k <= 0:
            return self.points.sparkSession.createDataFrame([], RESULT)
        out = None
        for qids, x in query_blocks(queries):

            def run(pdfs, qids=qids, x=x):
                for pdf in pdfs:
                    for blob in pdf.graph:
                        g = Graph.unpack(blob, config)
                        ids = np.array(g.ids, np.int64)
                        parts = [np.array(g.search(q, ef), np.int64) for q in x]
                        scores = [score_matrix(metric, q[None], g.x[r])[0] for q, r in zip(x, parts, strict=True)]
                        keep = [best_columns(s, ids[r], ef, largest) for s, r in zip(scores, parts, strict=True)]
                        yield pd.DataFrame({"qid": np.repeat(qids, [len(o) for o in keep]), "id": np.concatenate([ids[r][o] for r, o in zip(parts, keep, strict=True)]), "score": np.concatenate([s[o] for s, o in zip(scores, keep, strict=True)])})

            own = self.graphs.mapInPandas(run, "qid long, id long, score double").join(self.tombstones, "id", "left_anti")
            own = top_k_per_query(own, k, largest)
            out = own if out is None else out.unionByName(own)
        return out if out is not None else self.points.sparkSession.createDataFrame([], RESULT)

    def search(self, query: list[float], k: int, ef: int | None = None) -> DataFrame:
        q = self.points.sparkSession.createDataFrame([(0, [float(v) for v in query])], "qid long, vector array<double>")
        return self.search_batch(q, k, ef).select("rank", "id", "score")
