"""Approximate nearest neighbours by an inverted multi-index.

Two codebooks quantise the two halves of a vector; a cell is a pair of centroids. A query sorts each codebook by inner
product and walks the pairs from the highest sum down with a heap, until the cells met hold enough vectors; those are
ranked by the exact inner product of the original vectors. Every row is in the index; a shard's codebooks are fitted
on a bounded sample of its rows. How many vectors are enough is measured when a shard is built: sample queries look
for their exact nearest ones, and the walk has to be as long as RECALL of these need.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from halyard.llm.vectors import best, clean_vectors, pack, search_shards

#: The fit of a shard reads at most so many of its vectors, drawn by a seed.
SAMPLE = 8192
CENTROIDS = 32
#: The share of the exact NEAR nearest of PROBES rows of a shard that its walks have to reach.
RECALL, NEAR, PROBES = 0.95, 20, 128
#: Vectors of an index shard on the average.
SHARD = 32_768


def kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 0) -> np.ndarray:
    """Lloyd's algorithm from distinct rows; a centroid without rows stays where it was."""
    rng = np.random.default_rng(seed)
    distinct = np.unique(x, axis=0)
    c = distinct[rng.permutation(len(distinct))[:k]].copy()
    for _ in range(rounds):
        own = ((c**2).sum(1)[None] - 2 * x @ c.T).argmin(1)
        n = np.bincount(own, minlength=len(c))
        total = (own == np.arange(len(c))[:, None]).astype(float) @ x
        c[n > 0] = total[n > 0] / n[n > 0, None]
    return c


def _nearest_centroid(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return ((c**2).sum(1)[None] - 2 * x @ c.T).argmin(1)


def _walk_length(x: np.ndarray, cell: np.ndarray, first: np.ndarray, second: np.ndarray) -> int:
    """Vectors that a walk has to meet so that RECALL of the nearest ones of sample rows are among them."""
    n, h = len(x), x.shape[1] // 2
    probes = np.random.default_rng(1).permutation(n)[:PROBES]
    sizes = np.bincount(cell, minlength=len(first) * len(second))
    needed = []
    for p in probes.tolist():
        scores = x @ x[p]
        scores[p] = -np.inf
        near = best(scores, np.arange(n), min(NEAR, n - 1))
        sums = ((first @ x[p, :h])[:, None] + (second @ x[p, h:])[None, :]).ravel()
        order = np.argsort(-sums, kind="stable")
        met = np.empty_like(sizes)
        met[order] = np.cumsum(sizes[order])
        needed.append(met[cell[near]])
    needed = np.sort(np.concatenate(needed))
    return int(needed[min(len(needed) - 1, int(RECALL * len(needed)))]) if len(needed) else n


def build(x: np.ndarray, ids: np.ndarray, centroids: int = CENTROIDS) -> bytes:
    """The index over the rows of x, packed: ids and vectors in the order of their cells, and where each cell starts."""
    h = x.shape[1] // 2
    some = x if len(x) <= SAMPLE else x[np.sort(np.random.default_rng(0).permutation(len(x))[:SAMPLE])]
    first, second = kmeans(some[:, :h], centroids), kmeans(some[:, h:], centroids)
    cell = _nearest_centroid(x[:, :h], first) * len(second) + _nearest_centroid(x[:, h:], second)
    order = np.argsort(cell, kind="stable")
    starts = np.searchsorted(cell[order], np.arange(len(first) * len(second) + 1))
    return pack(ids=ids[order], x=x[order], starts=starts, first=first, second=second, enough=np.array([_walk_length(x, cell, first, second)]))


def search(index: dict[str, np.ndarray], q: np.ndarray, qids: np.ndarray, k: int, stats: dict[str, int] | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each query row: its number and the ids and scores of the k best vectors of other ids that its walk met."""
    h, ids, x, starts = q.shape[1] // 2, index["ids"], index["x"], index["starts"].tolist()
    enough = max(k + 1, int(index["enough"][0]))
    one, two = q[:, :h] @ index["first"].T, q[:, h:] @ index["second"].T
    left, right = np.argsort(-one, 1, kind="stable"), np.argsort(-two, 1, kind="stable")
    n1, n2 = one.shape[1], two.shape[1]
    for r in range(len(q)):
        lo, ro, ls, rs = left[r].tolist(), right[r].tolist(), np.take(one[r], left[r]).tolist(), np.take(two[r], right[r]).tolist()
        heap, done, met, parts = [(-(ls[0] + rs[0]), 0, 0)], [-1] * n1, 0, []
        while heap and met < enough:
            _, i, j = heapq.heappop(heap)
            done[i] = j
            cell = lo[i] * n2 + ro[j]
            if starts[cell] < starts[cell + 1]:
                parts.append((starts[cell], starts[cell + 1]))
                met += starts[cell + 1] - starts[cell]
            # A pair follows once both pairs before it are done.
            if i + 1 < n1 and (j == 0 or done[i + 1] == j - 1):
                heapq.heappush(heap, (-(ls[i + 1] + rs[j]), i + 1, j))
            if j + 1 < n2 and (i == 0 or done[i - 1] >= j + 1):
                heapq.heappush(heap, (-(ls[i] + rs[j + 1]), i, j + 1))
        rows = np.concatenate([np.arange(a, b) for a, b in parts]) if parts else np.zeros(0, np.int64)
        rows = rows[ids[rows] != qids[r]]
        if stats is not None:
            stats["met"] = stats.get("met", 0) + len(rows)
        scores = x[rows] @ q[r]
        order = best(scores, ids[rows], k)
        yield r, ids[rows][order], scores[order]


def nearest(df: DataFrame, k: int = 20, every: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Each query's k nearest found by inner product: query_id, rank, vec_id, score (exact, on the original vectors).

    Queries are the rows whose id is divisible by `every`; a query's own id is no candidate. Vectors that are null,
    zero or hold null or non-finite components take no part, nor do null ids. A query meets vectors of its own
    dimension only. Repeated rows count as rows, and a query meets none of its own id. An empty table gives no rows.
    """
    vectors = clean_vectors(df, id_col, vector_col, allow_zero=False)
    return search_shards(vectors, vectors.where(F.col("vec_id") % every == 0), build, search, k, "double", SHARD)
