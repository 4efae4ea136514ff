"""The binary snapshot and log formats, for exchange with files written by others.

Everything is little-endian. Fixed values of the formats:
  snapshot header: magic VCTA, version 1 (u32), index type (u8), metric (u8), dimension (u32), count (u64)
  index types: 0 flat, 1 ivf, 2 hnsw, 3 ivfpq; metrics: 0 euclidean, 1 cosine, 2 dot product
  log entry: length (u32), operation 0 = insert (u8), id (u64), dimension (u32), components (f32)
"""

from __future__ import annotations

import struct
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from halyard.operators.hnsw import Graph, HnswConfig

MAGIC, VERSION = b"VCTA", 1
INDEX_TYPES = ("flat", "ivf", "hnsw", "ivfpq")
METRICS = ("euclidean", "cosine", "dot_product")
_HEADER = struct.Struct("<4sIBBIQ")


@dataclass
class Snapshot:
    """What a snapshot file holds; only the fields of its type are set."""

    index_type: str
    metric: str
    dim: int
    ids: np.ndarray
    vectors: np.ndarray | None = None
    cluster_ids: np.ndarray | None = None
    centroids: np.ndarray | None = None
    trained: bool = True
    codes: np.ndarray | None = None
    codebooks: np.ndarray | None = None
    graph: Graph | None = None
    config: HnswConfig = field(default_factory=HnswConfig)


class _Reader:
    def __init__(self, raw: bytes) -> None:
        self.raw, self.at = raw, 0

    def take(self, n: int) -> bytes:
        if self.at + n > len(self.raw):
            raise ValueError("the snapshot is cut short")
        self.at += n
        return self.raw[self.at - n : self.at]

    def number(self, fmt: str) -> int:
        s = struct.Struct("<" + fmt)
        return s.unpack(self.take(s.size))[0]

    def array(self, kind: str, *shape: int) -> np.ndarray:
        dtype = np.dtype("<" + kind)
        return np.frombuffer(self.take(int(np.prod(shape, dtype=np.int64)) * dtype.itemsize), dtype).reshape(shape)


def header(raw: bytes) -> tuple[str, str, int, int]:
    """(index type, metric, dimension, count)."""
    if len(raw) < _HEADER.size:
        raise ValueError("the snapshot is cut short")
    magic, version, kind, metric, dim, n = _HEADER.unpack(raw[: _HEADER.size])
    if magic != MAGIC:
        raise ValueError("invalid magic bytes")
    if version != VERSION:
        raise ValueError(f"unsupported format version {version}")
    if kind >= len(INDEX_TYPES) or metric >= len(METRICS):
        raise ValueError("unknown index type or metric")
    return INDEX_TYPES[kind], METRICS[metric], dim, n


def peek_index_type(raw: bytes) -> str:
    return header(raw)[0]


def loads(raw: bytes) -> Snapshot:
    kind, metric, dim, n = header(raw)
    r = _Reader(raw)
    r.at = _HEADER.size
    if kind == "flat":
        out = Snapshot(kind, metric, dim, r.array("u8", n).astype(np.int64), r.array("f4", n, dim))
    elif kind == "ivf":
        clusters = r.number("I")
        centroids = r.array("f4", clusters, dim)
        ids, vectors, owner = [], [], []
        for c in range(clusters):
            size = r.number("I")
            ids.append(r.array("u8", size))
            vectors.append(r.array("f4", size, dim))
            owner.append(np.full(size, c))
        out = Snapshot(kind, metric, dim, np.concatenate(ids).astype(np.int64), np.concatenate(vectors), np.concatenate(owner), centroids, bool(r.number("B")))
    elif kind == "hnsw":
        config = HnswConfig(r.number("I"), r.number("I"), r.number("I"))
        entry, nodes = r.number("q"), r.number("Q")
        g = Graph(dim, config)
        g.x, g.entry = r.array("f4", nodes, dim).astype(float), None if entry < 0 else entry
        for _ in range(nodes):
            g.ids.append(r.number("Q"))
            g.neighbours.append([r.array("u4", r.number("I")).tolist() for _ in range(r.number("I") + 1)])
        out = Snapshot(kind, metric, dim, np.array(g.ids, np.int64), g.x, graph=g, config=config)
    else:
        m, k, clusters = r.number("I"), r.number("I"), r.number("I")
        centroids, books = r.array("f4", clusters, dim), r.array("f4", m, k, dim // m)
        ids, codes, owner = [], [], []
        for c in range(clusters):
            size = r.number("I")
            rows = np.frombuffer(r.take(size * (8 + m)), np.uint8).reshape(size, 8 + m)
            ids.append(rows[:, :8].copy().view("<u8").ravel())
            codes.append(rows[:, 8:])
            owner.append(np.full(size, c))
        out = Snapshot(kind, metric, dim, np.concatenate(ids).astype(np.int64), None, np.concatenate(owner), centroids, bool(r.number("B")), np.concatenate(codes), books)
    if len(out.ids) != n:
        raise ValueError(f"mismatch between header vector count ({n}) and the rows found ({len(out.ids)})")
    if r.at != len(raw):
        raise ValueError("bytes follow the snapshot")
    return out


def dumps(s: Snapshot) -> bytes:
    f4 = lambda x: np.ascontiguousarray(x, "<f4").tobytes()
    u8 = lambda x: np.ascontiguousarray(x, "<u8").tobytes()
    out = [_HEADER.pack(MAGIC, VERSION, INDEX_TYPES.index(s.index_type), METRICS.index(s.metric), s.dim, len(s.ids))]
    if s.index_type == "flat":
        out += [u8(s.ids), f4(s.vectors)]
    elif s.index_type == "hnsw":
        g = s.graph
        out += [struct.pack("<IIIqQ", s.config.m, s.config.ef_construction, s.config.ef_search, -1 if g.entry is None else g.entry, len(g.ids)), f4(g.x)]
        for id, layers in zip(g.ids, g.neighbours, strict=True):
            out.append(struct.pack("<QI", id, len(layers) - 1))
            out += [struct.pack("<I", len(x)) + np.array(x, "<u4").tobytes() for x in layers]
    else:
        clusters = len(s.centroids)
        if s.index_type == "ivfpq":
            out.append(struct.pack("<II", s.codebooks.shape[0], s.codebooks.shape[1]))
        out += [struct.pack("<I", clusters), f4(s.centroids)]
        if s.index_type == "ivfpq":
            out.append(f4(s.codebooks))
        for c in range(clusters):
            own = np.flatnonzero(s.cluster_ids == c)
            out.append(struct.pack("<I", len(own)))
            if s.index_type == "ivf":
                out += [u8(s.ids[own]), f4(s.vectors[own])]
            else:
                out.append(np.concatenate([np.ascontiguousarray(s.ids[own], "<u8").view(np.uint8).reshape(-1, 8), s.codes[own].astype(np.uint8)], 1).tobytes())
        out.append(struct.pack("<B", s.trained))
    return b"".join(out)


def read_points(spark: SparkSession, path: str) -> DataFrame:
    """(file, id, vector) of flat, ivf and hnsw snapshots, a file by one task."""
    import pandas as pd

    def run(pdfs):
        for pdf in pdfs:
            for name, raw in zip(pdf.path, pdf.content, strict=True):
                s = loads(bytes(raw))
                if s.vectors is None:
                    raise ValueError("an ivfpq snapshot holds codes, not vectors")
                yield pd.DataFrame({"file": name, "id": s.ids, "vector": list(s.vectors.astype(np.float32))})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "file string, id long, vector array<float>")


def log_entry(id: int, vector: list[float]) -> bytes:
    body = struct.pack("<BQI", 0, id, len(vector)) + np.array(vector, "<f4").tobytes()
    return struct.pack("<I", len(body)) + body


def replay_log(raw: bytes) -> list[tuple[int, list[float]]]:
    """(id, vector) of each entry in order; an entry cut off at the end is dropped, a malformed one is an error."""
    out, at = [], 0
    while at + 4 <= len(raw):
        size = struct.unpack_from("<I", raw, at)[0]
        body = raw[at + 4 : at + 4 + size]
        if len(body) < size:
            break
        if size < 13:
            raise ValueError(f"invalid log entry length {size}")
        op, id, dim = struct.unpack_from("<BQI", body)
        if op != 0:
            raise ValueError(f"unknown log operation {op}")
        if size != 13 + 4 * dim:
            raise ValueError(f"log entry length {size} doesn't match dimension {dim}")
        out.append((id, np.frombuffer(body, "<f4", dim, 13).tolist()))
        at += 4 + size
    return out
