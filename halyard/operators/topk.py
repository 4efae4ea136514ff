"""Top-k lists: of one query, of many queries, and merged from partial lists.

Order is (score, id), so ties go to the smaller id. As in Spark's own order, NaN is the greatest number: last among
the smallest, first among the largest.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _order(largest: bool):
    return [F.col("score").desc() if largest else F.col("score").asc(), F.col("id").asc()]


def _with_rank(df: DataFrame, k: int, largest: bool) -> DataFrame:
    # At most k rows are left, so numbering them in one task is bounded.
    place = F.row_number().over(Window.orderBy(*_order(largest)))
    return df.orderBy(*_order(largest)).limit(max(k, 0)).select(place.alias("rank"), "id", "score")


def top_k_smallest(scored: DataFrame, k: int) -> DataFrame:
    """The k rows of scored(id, score) with the smallest scores: (rank, id, score). k = 0 gives none, k beyond the table all."""
    return _with_rank(scored.select("id", "score"), k, False)


def top_k_largest(scored: DataFrame, k: int) -> DataFrame:
    """The k rows with the largest scores, largest first."""
    return _with_rank(scored.select("id", "score"), k, True)


def top_k_per_query(scored: DataFrame, k: int, largest: bool) -> DataFrame:
    """For each qid of scored(qid, id, score) its k best: (qid, rank, id, score). Partial lists merge in the same way."""
    place = F.row_number().over(Window.partitionBy("qid").orderBy(*_order(largest)))
    return scored.select("qid", place.alias("rank"), "id", "score").where(F.col("rank") <= max(k, 0))


def best_columns(scores: np.ndarray, ids: np.ndarray, k: int, largest: bool) -> np.ndarray:
    """Positions of the k best of one row of scores, in order."""
    key = np.where(np.isnan(scores), -np.inf, -scores) if largest else scores
    n = len(key)
    if 0 < k < n // 4:
        edge = np.partition(key, k - 1)[k - 1]
        held = np.arange(n) if np.isnan(edge) else np.flatnonzero(key <= edge)
    else:
        held = np.arange(n)
    return held[np.lexsort((ids[held], key[held]))][: max(k, 0)]


def best_of_rows(scores: np.ndarray, ids: np.ndarray, k: int, largest: bool) -> np.ndarray:
    """Positions of the k best of every row of scores; all rows at once, but for those where ties cross the edge."""
    n, k = scores.shape[1], max(k, 0)
    if n <= k:
        return np.broadcast_to(np.arange(n), scores.shape)
    if not k:
        return np.zeros((len(scores), 0), np.int64)
    key = np.where(np.isnan(scores), -np.inf, -scores) if largest else scores
    out = np.argpartition(key, k - 1, 1)[:, :k]
    edge = np.take_along_axis(key, out, 1).max(1)
    for i in np.flatnonzero(((key <= edge[:, None]).sum(1) != k) | np.isnan(edge)).tolist():
        out[i] = best_columns(scores[i], ids[i], k, largest)
    return out
