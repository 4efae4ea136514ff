"""What the two vector searches share: clean vectors, bounded shards, query blocks, and the merge of shard results."""

from __future__ import annotations

import io
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from halyard.llm._common import materialise

#: Vectors of an index shard and queries of one call, on the average.
SHARD_ROWS = 8192
CALL_QUERIES = 4096

Search = Callable[[dict[str, np.ndarray], np.ndarray, np.ndarray, int], Iterator[tuple[int, np.ndarray, np.ndarray]]]


def pack(**arrays: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def unpack(blob: bytes) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(blob), allow_pickle=False) as held:
        return {k: held[k] for k in held.files}


def clean_vectors(df: DataFrame, id_col: str, vector_col: str, allow_zero: bool) -> DataFrame:
    """(vec_id, v, dim): vectors that are not null and hold neither null nor non-finite components (nor are all zero, unless allowed)."""
    v = F.col(vector_col).cast("array<double>")
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    out = df.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).where(F.col("v").isNotNull() & F.col("vec_id").isNotNull()).where(~bad)
    if not allow_zero:
        out = out.where(F.exists("v", lambda x: x != 0))
    return out.withColumn("dim", F.size("v"))


def search_shards(vectors: DataFrame, queries: DataFrame, build: Callable[[np.ndarray, np.ndarray], bytes], search: Search, k: int, score_type: str, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Each query's k best rows but those of its own id: query_id, rank, vec_id, score.

    vectors and queries are (vec_id, v, dim). Rows are hashed into shards of one dimension and about shard_rows rows,
    each indexed by one call of build and kept in the shared folder. Queries are hashed into blocks of about
    CALL_QUERIES; a block meets a shard in one call, and only k rows for each query and shard are shuffled.
    A query meets only vectors of its own dimension.
    """
    n, nq = vectors.count(), queries.count()
    shards, blocks = -(-n // shard_rows) or 1, -(-nq // CALL_QUERIES) or 1

    def index(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("vec_id", kind="stable")
        x = np.vstack(pdf.v.to_list()) if key[0] else np.zeros((len(pdf), 0))
        return pd.DataFrame({"dim": [key[0]], "shard": [key[1]], "index": [build(x, pdf.vec_id.to_numpy())]})

    indexed = vectors.withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int")).groupBy("dim", "shard").applyInPandas(index, "dim int, shard int, index binary")
    indexed = materialise(indexed, "index")

    def call(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": [], "row": [], "vec_id": [], "score": []})
        right = right.sort_values("vec_id", kind="stable")
        q = np.vstack(right.v.to_list()) if key[0] else np.zeros((len(right), 0))
        out = list(search(unpack(left["index"].iloc[0]), q, right.vec_id.to_numpy(), k))
        sizes = [len(ids) for _, ids, _ in out]
        row = np.repeat(np.array([r for r, _, _ in out], np.int64), sizes)
        return pd.DataFrame({"query_id": right.vec_id.to_numpy()[row], "row": right["row"].to_numpy()[row], "vec_id": np.concatenate([i for _, i, _ in out]), "score": np.concatenate([s for _, _, s in out])})

    asked = queries.withColumn("row", F.monotonically_increasing_id()).withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int"))
    asked = materialise(asked, "queries").withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    over = indexed.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    keys = ("dim", "shard", "block")
    found = over.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInPandas(call, f"query_id long, row long, vec_id long, score {score_type}")
    order = Window.partitionBy("row").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k largest scores, ties to smaller ids."""
    if len(scores) > 4 * k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        held = np.flatnonzero(scores >= least)
    else:
        held = np.arange(len(scores))
    return held[np.lexsort((ids[held], -scores[held]))][:k]
