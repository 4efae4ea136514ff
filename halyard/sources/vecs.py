"""fvecs and ivecs files: for each row a 32-bit length and as many 32-bit numbers, little-endian."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from halyard.plans.storage import file_system

#: A file that is longer is closed, and its partition goes on with the next.
FILE_BYTES = 16 << 20


def _dtype(kind: str) -> str:
    return "<f4" if kind == "fvecs" else "<i4"


def parse_vecs(raw: bytes, kind: str) -> np.ndarray:
    """The rows of a file's content; kind is fvecs or ivecs."""
    if not len(raw):
        return np.zeros((0, 0), _dtype(kind))
    if len(raw) < 4:
        raise ValueError(f"not a {kind} file of one dimension")
    dim = int(np.frombuffer(raw[:4], "<i4")[0])
    if dim <= 0 or len(raw) % (4 * (dim + 1)):
        raise ValueError(f"not a {kind} file of one dimension")
    rows = np.frombuffer(raw, "<i4").reshape(-1, dim + 1)
    if (rows[:, 0] != dim).any():
        raise ValueError(f"the rows of this {kind} file differ in dimension")
    return rows[:, 1:].copy().view(_dtype(kind))


def format_vecs(x: np.ndarray, kind: str) -> bytes:
    given = np.asarray(x)
    with np.errstate(over="ignore"):
        x = np.ascontiguousarray(given, _dtype(kind))
    if kind == "ivecs" and (x != given).any():
        raise ValueError("ivecs files hold whole numbers of 32 bits")
    return np.concatenate([np.full((len(x), 1), x.shape[1], "<i4"), x.view("<i4")], 1).tobytes()


def id_words(ids: np.ndarray) -> np.ndarray:
    """64-bit ids as rows of two 32-bit words, the low one first, as ivecs files can hold them."""
    return np.ascontiguousarray(ids, "<i8").view("<i4").reshape(-1, 2)


def id_column(words: Column) -> Column:
    """The id of id_words()."""
    return F.shiftleft(words[1].cast("long"), 32).bitwiseOR(words[0].cast("long").bitwiseAND(F.lit(0xFFFFFFFF)))


def read_vecs(spark: SparkSession, path: str, kind: str = "fvecs") -> DataFrame:
    """(file, row, vector) of every row of the files, each file by one task."""
    numbers = pa.float32() if kind == "fvecs" else pa.int32()

    def run(batches):
        for batch in batches:
            for name, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                x = parse_vecs(memoryview(raw.as_buffer()), kind)
                for a in range(0, len(x), 4096):
                    part = x[a : a + 4096]
                    vectors = pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1, dtype=np.int32) * x.shape[1]), pa.array(part.ravel(), numbers))
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(part)), pa.array(np.arange(a, a + len(part))), vectors], ["file", "row", "vector"])

    kinds = "float" if kind == "fvecs" else "int"
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, f"file string, row long, vector array<{kinds}>")


def read_vecs_with_ids(spark: SparkSession, folder: str, ids: str) -> DataFrame:
    """(id, vector) of what write_vecs() wrote into two folders: rows belong together by file and place in it."""
    name = F.regexp_extract("file", r"([^/]*)\.[fi]vecs$", 1).alias("name")
    words = read_vecs(spark, ids, "ivecs").select(name, "row", id_column(F.col("vector")).alias("id"))
    return read_vecs(spark, folder).select(name, "row", "vector").join(words, ["name", "row"]).select("id", "vector")


def _matrix(column: pa.Array, kind: str) -> np.ndarray:
    values = column.flatten()
    sizes = np.unique(np.diff(column.offsets.to_numpy()))
    if column.null_count or values.null_count or len(sizes) != 1 or not sizes[0]:
        raise ValueError(f"rows of {kind} files have one dimension, and neither vectors nor components are null")
    return values.to_numpy(zero_copy_only=False).reshape(len(column), -1)


def write_vecs(df: DataFrame, folder: str, kind: str = "fvecs", ids: str | None = None, file_bytes: int = FILE_BYTES) -> list[str]:
    """Writes the vector column of df, in row order, into a new folder; returns the files' names, in row order too.

    A partition writes its rows as they come, in files of about `file_bytes`. Given a folder for `ids`, the id of every
    row goes into an ivecs file there, of the same name and at the same place. Files have hidden names until the job is
    done: those of attempts that failed are never read.
    """
    spark, folders = df.sparkSession, [folder] if ids is None else [folder, ids]
    kinds = [kind, "ivecs"][: len(folders)]
    for f in folders:
        fs, path = file_system(spark, f)
        if fs.exists(path) and any(not s.getPath().getName().startswith(("_", ".")) for s in fs.listStatus(path)):
            raise FileExistsError(f"{f} holds files already")
        fs.mkdirs(path)

    def run(batches):
        from pyarrow import fs

        uris = [f if "://" in f else f"file://{f}" if f.startswith("/") else f.replace("file:/", "file:///", 1) for f in folders]
        places = [fs.FileSystem.from_uri(u) for u in uris]
        partition, attempt, files, outs, dim, written = TaskContext.get().partitionId(), uuid.uuid4().hex, 0, [], None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column(0), kind)
            if dim not in (None, x.shape[1]):
                raise ValueError(f"the rows differ in dimension: {dim} and {x.shape[1]}")
            dim = x.shape[1]
            step = max(1, file_bytes // (4 * (dim + 1)))
            for a in range(0, len(x), step):
                part = x[a : a + step]
                if not outs:
                    written = 0
                    outs = [system.open_output_stream(f"{path}/_{attempt}-{files}") for system, path in places]
                outs[0].write(blob := format_vecs(part, kind))
                if ids is not None:
                    if (own := batch.column(1).slice(a, step)).null_count:
                        raise ValueError("an id is null")
                    outs[1].write(format_vecs(id_words(own.to_numpy(zero_copy_only=False)), "ivecs"))
                written += len(blob)
                if written >= file_bytes:
                    for out in outs:
                        out.close()
                    outs, files = [], files + 1
        for out in outs:
            out.close()
        if dim is not None:
            n = files + bool(outs)
            yield pa.RecordBatch.from_arrays([pa.array([partition] * n), pa.array(np.arange(n)), pa.array([f"_{attempt}-{i}" for i in range(n)]), pa.array([dim] * n)], ["partition", "file", "name", "dim"])

    columns = [F.col("vector")] if ids is None else [F.col("vector"), F.col("id").cast("long")]
    done = sorted(df.select(*columns).mapInArrow(run, "partition long, file long, name string, dim long").collect())
    if len({r.dim for r in done}) > 1:
        raise ValueError(f"the rows differ in dimension: {sorted({r.dim for r in done})}")
    names = []
    for r in done:
        for f, k in zip(folders, kinds, strict=True):
            fs, path = file_system(spark, f)
            child = lambda name: spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path, name)  # noqa: B023, E731
            name = f"part-{r.partition:05d}-{r.file:05d}.{k}"
            if not fs.rename(child(r.name), child(name)):
                raise OSError(f"{f}/{name} can't be written")
            if f == folder:
                names.append(f"{folder.rstrip('/')}/{name}")
    return names
