"""Exact k-nearest-neighbour search over a table of vectors.

Queries come in blocks of a bounded size; a block goes to all tasks, every task keeps its own k best rows for each
query while it reads Arrow batches, and only those rows are shuffled for the merge. Work and memory of a task don't
depend on the number of points, and the points are never shuffled.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from halyard.functions.vector import check_dim, larger_is_better, literal_vector, matrix, metric_name, row_norms, score, score_pairs
from halyard.operators.topk import top_k_largest, top_k_per_query, top_k_smallest

#: Queries that are sent to the tasks at once; more of them are searched block after block.
QUERY_BLOCK = 2048
#: Points and queries of one tile, pairs that are scored at once, and rows of a task's output batch.
POINT_TILE, QUERY_TILE, PAIRS, RESULT_ROWS = 2048, 256, 16384, 65536
RESULT = "qid long, rank int, id long, score double"


def search(points: DataFrame, query: list[float], k: int, metric: str = "euclidean") -> DataFrame:
    """The k nearest of points(id, vector) to one query, by Column expressions alone: (rank, id, score)."""
    metric = metric_name(metric)
    scored = points.select("id", score(metric, check_dim("vector", len(query)), literal_vector(query)).alias("score"))
    return top_k_largest(scored, k) if larger_is_better(metric) else top_k_smallest(scored, k)


def query_blocks(queries: DataFrame, size: int = QUERY_BLOCK):
    """Blocks of (ids, matrix) of queries(qid, vector); a block holds about `size` rows and is what reaches the driver."""
    rows = queries.select("qid", "vector").limit(size + 1).collect()
    blocks = 1 if len(rows) <= size else -(-queries.count() // size)
    for b in range(blocks):
        if blocks > 1:
            rows = queries.where(F.pmod(F.xxhash64("qid"), F.lit(blocks)) == b).select("qid", "vector").collect()
        rows = sorted(rows, key=lambda r: r.qid)
        if rows:
            yield np.array([r.qid for r in rows], np.int64), np.array([r.vector for r in rows], float).reshape(len(rows), -1)


class Nearest:
    """The k best points for each of some queries, of points that come in parts.

    A matrix product finds which pairs of a tile can be among the best, with a margin above its rounding error; only
    these are scored, component by component. So memory is that of one tile and of k rows for each query, and a score
    doesn't depend on where in a part a point stands: equal points tie, and ties go to the smaller id.
    """

    def __init__(self, metric: str, queries: np.ndarray, k: int) -> None:
        self.metric, self.k, self.largest = metric_name(metric), max(k, 0), larger_is_better(metric)
        self.queries, self.norms = queries, row_norms(queries)
        self.parts = [(a, min(a + QUERY_TILE, len(queries))) for a in range(0, len(queries), QUERY_TILE)]
        empty = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        self.held, self.edge = [empty] * len(self.parts), np.full(len(queries), np.inf)

    def key(self, scores: np.ndarray) -> np.ndarray:
        """What is smallest for the best; NaN is the greatest score."""
        return np.where(np.isnan(scores), -np.inf, -scores) if self.largest else scores

    def add(self, ids: np.ndarray, x: np.ndarray) -> None:
        for a in range(0, len(ids) if self.k else 0, POINT_TILE):
            tile = x[a : a + POINT_TILE]
            with np.errstate(all="ignore"):
                norms = row_norms(tile)
                for i, (low, high) in enumerate(self.parts):
                    self._add(i, low, high, ids[a : a + POINT_TILE], tile, norms)

    def _near(self, low: int, high: int, x: np.ndarray, norms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows and columns of the pairs of one tile that can be among the best."""
        own = self.norms[low:high]
        near, slack = self.queries[low:high] @ x.T, 8 * (x.shape[1] + 4) * np.finfo(float).eps
        edge, sure = self.edge[low:high], np.isfinite(norms)
        longest = norms.max(where=sure, initial=0.0)
        if self.metric == "euclidean":  # by squares
            near *= -2
            near += (own * own)[:, None]
            near += (norms * norms)[None, :]
            edge, slack = edge * edge * (1 + slack), slack * (own + longest) ** 2
        elif self.metric == "cosine":
            scale = own[:, None] * norms[None, :]
            near = np.where(scale == 0, 0.0, -near / scale)
            slack = np.full(len(own), slack)
        else:
            near, slack = -near, slack * own * longest
        unclear = ~(np.isfinite(near) & sure[None, :])  # can't be told from the product
        mask = ~(near > (edge + slack)[:, None]) | unclear
        if self.k < near.shape[1] and np.count_nonzero(mask) > 8 * (self.k + 8) * len(own):
            # k points of this tile are known to be as good as its k-th and the slack.
            tile = np.partition(np.where(unclear, np.inf, near), self.k - 1, 1)[:, self.k - 1] + slack
            edge = np.where(np.isfinite(tile), np.fmin(edge, tile), edge)
            mask = ~(near > (edge + slack)[:, None]) | unclear
        return np.nonzero(mask)

    def _add(self, i: int, low: int, high: int, ids: np.ndarray, x: np.ndarray, norms: np.ndarray) -> None:
        rows, columns = self._near(low, high, x, norms)
        if not len(rows):
            return
        scores = np.empty(len(rows))
        for a in range(0, len(rows), PAIRS):
            r, c = rows[a : a + PAIRS], columns[a : a + PAIRS]
            scores[a : a + PAIRS] = score_pairs(self.metric, self.queries[low + r], x[c], self.norms[low + r] * norms[c])
        rows, ids, scores = (np.concatenate(pair) for pair in zip(self.held[i], (rows, ids[columns], scores), strict=True))
        order = np.lexsort((ids, self.key(scores), rows))
        rows, ids, scores = rows[order], ids[order], scores[order]
        first = np.searchsorted(rows, np.arange(high - low))
        kept = np.arange(len(rows)) - first[rows] < self.k
        self.held[i] = rows, ids, scores = rows[kept], ids[kept], scores[kept]
        full = np.bincount(rows, minlength=high - low) == self.k
        last = np.searchsorted(rows, np.arange(high - low), "right") - 1
        edge = self.key(scores[last[full]])
        self.edge[low:high][full] = np.where(np.isnan(edge), np.inf, edge)

    def best(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(position of the query, id, score) of all that is held, best first."""
        if not self.parts:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        rows = [low + held[0] for (low, _), held in zip(self.parts, self.held, strict=True)]
        return np.concatenate(rows), np.concatenate([h[1] for h in self.held]), np.concatenate([h[2] for h in self.held])


def scan_top_k(points: DataFrame, qids: np.ndarray, queries: np.ndarray, k: int, metric: str) -> DataFrame:
    """Each task's k best of points(id, vector) for each query of one block: (qid, id, score)."""
    dim = queries.shape[1]

    def run(batches):
        nearest = Nearest(metric, queries, k)
        for batch in batches:
            for a in range(0, batch.num_rows, POINT_TILE):
                part = batch.slice(a, POINT_TILE)
                nearest.add(part.column(0).to_numpy(zero_copy_only=False), matrix(part.column(1), dim))
        rows, ids, scores = nearest.best()
        for a in range(0, len(rows), RESULT_ROWS):
            b = a + RESULT_ROWS
            yield pa.RecordBatch.from_arrays([pa.array(qids[rows[a:b]]), pa.array(ids[a:b]), pa.array(scores[a:b])], ["qid", "id", "score"])

    return points.select(F.col("id").cast("long"), F.col("vector").cast("array<double>")).mapInArrow(run, "qid long, id long, score double")


def search_batch(points: DataFrame, queries: DataFrame, k: int, metric: str = "euclidean") -> DataFrame:
    """The k nearest of points(id, vector) to each of queries(qid, vector): (qid, rank, id, score)."""
    metric = metric_name(metric)
    parts = [top_k_per_query(scan_top_k(points, qids, x, k, metric), k, larger_is_better(metric)) for qids, x in query_blocks(queries)]
    if not parts or k <= 0:
        return points.sparkSession.createDataFrame([], RESULT)
    return reduce(DataFrame.unionByName, parts)
