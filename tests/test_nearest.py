"""Searches over many queries: memory by the tile, the same best points as plain scoring, ties by id."""

import tracemalloc

import numpy as np
import pytest

from halyard.functions.vector import score_pairs
from halyard.operators.search import Nearest, scan_top_k, search_batch


def plain(metric, queries, ids, x, k):
    out = []
    for row, q in enumerate(queries):
        scores = score_pairs(metric, np.broadcast_to(q, x.shape), x)
        key = scores if metric == "euclidean" else np.where(np.isnan(scores), -np.inf, -scores)
        out += [(row, int(ids[i]), repr(float(scores[i]))) for i in np.lexsort((ids, key))[:k]]
    return out


def found(metric, queries, ids, x, k, parts=3):
    best = Nearest(metric, queries, k)
    for i, v in zip(np.array_split(ids, parts), np.array_split(x, parts), strict=True):
        best.add(i, v)
    return [(int(r), int(i), repr(float(s))) for r, i, s in zip(*best.best(), strict=True)]


@pytest.mark.parametrize("metric", ["euclidean", "cosine", "dot_product"])
def test_best_are_those_of_plain_scoring(metric):
    rng = np.random.default_rng(1)
    few = rng.normal(size=(37, 64)).astype("f4").astype(float)
    odd = rng.normal(size=(300, 64))
    odd[::41], odd[5, 3], odd[6, 3], odd[7] = 0, np.nan, np.inf, 1e200
    for x, queries in ((np.tile(few, (120, 1)), few[:9]), (odd, odd[:50]), (rng.normal(size=(5000, 64)) * rng.choice([1e-9, 1, 1e6], (5000, 1)), rng.normal(size=(300, 64))), (1e6 + rng.normal(size=(3000, 64)) * 1e-6, 1e6 + rng.normal(size=(20, 64)) * 1e-6)):
        ids = rng.permutation(len(x))
        for k in (1, 10, 400):
            assert found(metric, queries, ids, x, k) == plain(metric, queries, ids, x, k)
    assert found(metric, few, ids[:0], x[:0], 5) == [] and found(metric, few, ids, x, 0) == []


def test_equal_points_tie(spark):
    rng = np.random.default_rng(0)
    x = np.tile(rng.normal(size=(37, 64)).astype("f4").astype(float), (30, 1))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vector array<double>").repartition(3)
    queries = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.normal(size=(101, 64)))], "qid long, vector array<double>")
    for metric in ("cosine", "dot_product"):
        got = {}
        for r in sorted(search_batch(df, queries, 10, metric).collect(), key=lambda r: (r.qid, r.rank)):
            got.setdefault(r.qid, []).append(r.id)
        assert all(ids == [ids[0] % 37 + 37 * i for i in range(10)] for ids in got.values()) and len(got) == 101


@pytest.mark.parametrize("metric", ["euclidean", "cosine", "dot_product"])
def test_memory_of_a_task(spark, metric):
    import pyarrow as pa

    rng = np.random.default_rng(0)
    queries = rng.normal(size=(2048, 64))
    batches = [pa.RecordBatch.from_arrays([pa.array(np.arange(2000) + 2000 * b), pa.array(list(rng.normal(size=(2000, 64))))], ["id", "vector"]) for b in range(2)]
    held = {}

    class Points:  # takes the function that a task runs
        def select(self, *_):
            return self

        def mapInArrow(self, run, _):
            held["run"] = run

    scan_top_k(Points(), np.arange(2048), queries, 10, metric)
    tracemalloc.start()
    rows = sum(b.num_rows for b in held["run"](iter(batches)))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows == 20480 and peak < 80e6
