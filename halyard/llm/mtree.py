"""Exact top-k by integer inner product over M-trees, searched best-first.

Vectors are quantised to integers. Under the Euclidean metric d, the inner product is (|q|^2 + |x|^2 - d(q, x)^2) / 2,
so a lower bound on d bounds the score from above. Nodes are pages of entries, each with its routing vector (or, in a
leaf, the vector itself), covering radius, distance to the parent's routing vector and the largest |x|^2 below it.
|d(q, parent) - d(entry, parent)| bounds d(q, entry) without computing it; only entries that this bound leaves are
computed. Nodes are visited in the order of their bounds until none can hold a better or equal score.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from halyard.llm.vectors import best, clean_vectors, pack, search_shards

PAGE = 64
FANOUT = 16
_LONG = (1 << 63) - 1


def quantise(x: np.ndarray) -> np.ndarray:
    """floor(1024 * x) as 64-bit integers, or as Python integers beyond 62 bits."""
    y = np.floor(x * 1024.0)
    return y.astype(np.int64) if not y.size or np.abs(y).max() < 2**62 else _exact(y)


def _exact(y: np.ndarray) -> np.ndarray:
    """The same numbers as Python integers."""
    return np.array([int(v) for v in y.ravel()], object).reshape(y.shape)


def _product_bits(x: np.ndarray, q: np.ndarray) -> int:
    """Bits that every inner product of rows of x and q, and every partial sum of one, fits in (without sign)."""
    if x.dtype == object or q.dtype == object:
        return 1 << 20
    top = [int(np.abs(a).max()) if a.size else 0 for a in (x, q)]
    return (x.shape[1] * top[0] * top[1]).bit_length()


def _distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.sqrt(((x - c) ** 2).sum(1))


def build(x: np.ndarray, ids: np.ndarray) -> bytes:
    """The paged tree over the rows of x, packed. Entries of all pages stand in one table; a page is a range of it."""
    z = np.floor(x * 1024.0)
    sq = (z**2).sum(1)
    rng = np.random.default_rng(0)
    entries: list[tuple] = []  # (routing row, radius, parent distance, largest square, child page)
    pages: list[tuple[int, int, bool]] = []
    leaf_rows: list[np.ndarray] = []
    leaf_dist: list[np.ndarray] = []
    held = 0

    def page(rows: np.ndarray, pivot: int) -> int:
        """Makes the page of these rows below a routing row and returns its number."""
        nonlocal held
        if len(rows) <= PAGE:
            leaf_rows.append(rows)
            leaf_dist.append(_distances(z[rows], z[pivot]))
            pages.append((held, held + len(rows), True))
            held += len(rows)
            return len(pages) - 1
        some = rows if len(rows) <= 512 else rng.choice(rows, 512, replace=False)
        chosen = [int(some[0])]
        near = _distances(z[some], z[chosen[0]])
        while len(chosen) < min(FANOUT, -(-len(rows) // (PAGE // 2))) and near.max() > 0:
            chosen.append(int(some[near.argmax()]))
            near = np.minimum(near, _distances(z[some], z[chosen[-1]]))
        dist = np.stack([_distances(z[rows], z[c]) for c in chosen])
        owner = dist.argmin(0)
        parts = [rows[owner == i] for i in range(len(chosen))]
        if max(map(len, parts)) == len(rows):  # equal vectors: nothing tells them apart
            parts, chosen = np.array_split(rows, -(-len(rows) // PAGE)), [chosen[0]] * -(-len(rows) // PAGE)
        own = []
        for part, c in zip(parts, chosen, strict=True):
            if len(part):
                own.append((c, float(_distances(z[part], z[c]).max()), float(np.sqrt(((z[c] - z[pivot]) ** 2).sum())), float(sq[part].max()), page(part, c)))
        first = len(entries)
        entries.extend(own)
        pages.append((first, len(entries), False))
        return len(pages) - 1

    root_pivot = 0
    top = page(np.arange(len(z)), root_pivot)
    rows = np.concatenate(leaf_rows)
    e = np.array(entries, float).reshape(-1, 5)
    return pack(ids=ids[rows], x=x[rows], dist=np.concatenate(leaf_dist), routing=z[e[:, 0].astype(int)], radius=e[:, 1], parent=e[:, 2], square=e[:, 3], child=e[:, 4].astype(np.int64), pages=np.array(pages, np.int64), root=np.array([top]), root_pivot=z[root_pivot])


def search(tree: dict[str, np.ndarray], q: np.ndarray, qids: np.ndarray, k: int, stats: dict[str, int] | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each query row: its number and the ids and scores of its k best vectors of other ids."""
    xi, qi = quantise(tree["x"]), quantise(q)
    bits = _product_bits(xi, qi)
    exact = bits <= 63
    if bits <= 53:  # doubles hold all of these integers, and multiply faster
        xi, qi = xi.astype(float), qi.astype(float)
    elif not exact:
        xi, qi = _exact(xi), _exact(qi)
        np.seterr(over="ignore", invalid="ignore")
    xf, qf = np.floor(tree["x"] * 1024.0), np.floor(q * 1024.0)
    sq = (xf**2).sum(1)
    ids, pages = tree["ids"], tree["pages"].tolist()
    top, computed = int(tree["root"][0]), 0
    for r in range(len(q)):
        qq = float((qf[r] ** 2).sum())
        slack = 1e-9 * (qq + float(sq.max())) + 1e-3
        kept_s, kept_i, floor = np.zeros(0, xi.dtype), np.zeros(0, np.int64), -np.inf
        heap = [(-np.inf, top, float(np.sqrt(((qf[r] - tree["root_pivot"]) ** 2).sum())))]
        while heap:
            bound, number, d = heapq.heappop(heap)
            if -bound < floor:
                break
            a, b, leaf = pages[number]
            if leaf:
                low = np.abs(d - tree["dist"][a:b])
                live = a + np.flatnonzero(~((qq + sq[a:b] - low**2) / 2 + slack < floor) & (ids[a:b] != qids[r]))
                computed += len(live)
                if len(live):
                    rows = slice(a, b) if len(live) == b - a else live
                    own = xi[rows] @ qi[r] if exact else np.array([max(-_LONG - 1, min(_LONG, v)) for v in xi[rows] @ qi[r]], object)
                    new = ids[live]
                    if len(kept_s) == k:
                        hit = np.flatnonzero(own >= kept_s[-1])
                        if not len(hit):
                            continue
                        own, new = own[hit], new[hit]
                    s, i = np.concatenate([kept_s, own]), np.concatenate([kept_i, new])
                    order = best(s, i, k) if exact else np.array(sorted(range(len(s)), key=lambda t: (-s[t], i[t]))[:k], int)
                    kept_s, kept_i = s[order], i[order]
                    floor = float(kept_s[-1]) if len(kept_s) == k else floor
                    floor -= 0 if exact else abs(floor) * 1e-12 if np.isfinite(floor) else 0
                continue
            low = np.maximum(0, np.abs(d - tree["parent"][a:b]) - tree["radius"][a:b])
            live = a + np.flatnonzero(~((qq + tree["square"][a:b] - low**2) / 2 + slack < floor))
            computed += len(live)
            near = _distances(tree["routing"][live], qf[r])
            bounds = (qq + tree["square"][live] - np.maximum(0, near - tree["radius"][live]) ** 2) / 2 + slack
            bounds[np.isnan(bounds)] = np.inf  # squares beyond a double bound nothing
            for u, e, m in zip(bounds.tolist(), live.tolist(), near.tolist(), strict=True):
                if u >= floor:
                    heapq.heappush(heap, (-u, int(tree["child"][e]), m))
        yield r, kept_i, kept_s.astype(np.int64)
    if stats is not None:
        stats["computed"] = stats.get("computed", 0) + computed


def exact_topk(df: DataFrame, k: int = 10, every: int = 100, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The k largest integer inner products of each query among rows of other ids: query_id, rank, vec_id, score.

    Queries are the rows whose id is divisible by `every`. Vectors that are null or hold null or non-finite
    components take no part, nor do null ids. A query meets vectors of its own dimension only; scores beyond 64 bits
    count as the limit of a long that they pass, so they tie. Repeated rows count as rows; an empty table gives no rows.
    """
    vectors = clean_vectors(df, id_col, vector_col, allow_zero=True)
    return search_shards(vectors, vectors.where(F.col("vec_id") % every == 0), build, search, k, "long")
