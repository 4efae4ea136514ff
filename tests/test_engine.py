import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from halyard.functions import vector as V
from halyard.operators import evaluate as E
from halyard.operators.collection import FlatCollection, batch_from_parts
from halyard.operators.hnsw import HnswConfig, HnswIndex, layer_from_uniform, layers_of, ml_factor
from halyard.operators.ivf import IVFIndex, nearest_centroid, nearest_clusters
from halyard.operators.kmeans import KMeansConfig, kmeans, plus_plus
from halyard.operators.metadata import MetadataStore, filtered_top_k, parse_filter, tagged
from halyard.operators.pq import Codebooks, IVFPQIndex, PQConfig, train_pq
from halyard.operators.search import search_batch
from halyard.operators.sharding import ConcurrentCollection, ShardedCollection, splitmix64
from halyard.operators.textstore import TextStore, text_id
from halyard.operators.topk import best_columns, top_k_largest, top_k_smallest

FIVE = [(0, [2.0, 1.0]), (1, [0.5, 0.0]), (2, [1.0, 3.0]), (3, [-1.0, 3.0]), (4, [4.0, -3.0])]


def flat(spark, rows=FIVE, metric="euclidean"):
    c = FlatCollection.create(spark, len(rows[0][1]), metric)
    return c.add_batch(spark.createDataFrame(rows, "id long, vector array<float>"))


def randoms(spark, n, dim, seed=0):
    x = np.random.default_rng(seed).uniform(-10, 10, (n, dim))
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vector array<float>")


def test_scalar_arithmetic(spark):
    one = spark.createDataFrame([([1.0, 2.0, 3.0], [4.0, 5.0, 6.0], [3.0, 4.0], [0.0, 0.0])], "a array<double>, b array<double>, c array<double>, z array<double>")
    row = one.select(V.dot_product("a", "b"), V.l2_norm("c"), V.l1_norm("c"), V.cosine_similarity("c", "z"), V.normalize("c"), V.normalize("z")).first()
    assert row[:4] == (32.0, 5.0, 7.0, 0.0) and row[4] == [0.6, 0.8] and row[5] == [0.0, 0.0]
    with pytest.raises(Exception, match="mismatch"):
        one.select(V.check_dim("a", 2)).collect()
    assert V.metric_name("IP") == "dot_product" and V.metric_name("L2") == "euclidean" and V.metric_name("cos") == "cosine"
    with pytest.raises(ValueError):
        V.metric_name("manhattan")
    V.register_functions(spark)
    assert spark.sql("SELECT vec_dot(array(1D, 2D), array(3D, 4D))").first()[0] == 11


@pytest.mark.parametrize(("metric", "ids", "scores"), [
    ("euclidean", [0, 1, 2], [1, math.sqrt(1.25), 2]), ("cosine", [0, 2, 1], [3 / math.sqrt(10), 2 / math.sqrt(5), 1 / math.sqrt(2)]), ("dot_product", [2, 0, 3], [4, 3, 2]),
])
def test_exact_search(spark, metric, ids, scores):
    c = flat(spark, metric=metric)
    rows = c.search([1.0, 1.0], 3).collect()
    assert [r.id for r in rows] == ids and [r.score for r in rows] == pytest.approx(scores)
    q = spark.createDataFrame([(7, [1.0, 1.0])], "qid long, vector array<double>")
    assert [r.id for r in sorted(c.search_batch(q, 3).collect(), key=lambda r: r.rank)] == ids
    assert c.search([1.0, 1.0], 0).count() == 0 and c.search([1.0, 1.0], 100).count() == 5


def test_top_k_order(spark):
    s = spark.createDataFrame([(i, float(v)) for i, v in enumerate([5, 2, 8, 1, 9, 3, 7, 4, 6, 0.5])], "id long, score double")
    assert [r.id for r in top_k_smallest(s, 3).collect()] == [9, 3, 1]
    assert [r.id for r in top_k_largest(s, 3).collect()] == [4, 2, 6]
    x, ids = np.array([1.0, np.nan, 1.0, 0.0]), np.array([5, 6, 4, 7])
    assert ids[best_columns(x, ids, 4, False)].tolist() == [7, 4, 5, 6] and ids[best_columns(x, ids, 4, True)].tolist() == [6, 4, 5, 7]


def test_changes(spark):
    c = flat(spark)
    with pytest.raises(ValueError, match="duplicate"):
        c.add(1, [0.0, 0.0])
    d = c.delete(1)
    assert len(d) == 4 and d.total_records() == 5 and d.get_vector(1) is None and len(c) == 5
    with pytest.raises(ValueError, match="not found"):
        d.delete(1)
    with pytest.raises(ValueError, match="duplicate"):
        d.add_batch(spark.createDataFrame([(1, [0.0, 0.0])], "id long, vector array<float>"))
    with pytest.raises(ValueError, match="duplicate"):
        d.add(1, [9.0, 9.0], strict=True)
    assert d.add(1, [9.0, 9.0]).get_vector(1) == [9.0, 9.0]
    assert d.compact().total_records() == 4 and c.update(0, [7.0, 7.0]).get_vector(0) == [7.0, 7.0]
    with pytest.raises(ValueError):
        c.add(9, [1.0])
    assert c.clear().is_empty() and c.validate() is c
    assert batch_from_parts(spark, [1, 2, 3, 4], 2, 2).count() == 2
    with pytest.raises(ValueError):
        batch_from_parts(spark, [1, 2, 3], 2, 2)


def test_concurrent_versions(spark):
    c = ConcurrentCollection(flat(spark))
    before = c.current
    c.add(10, [1.0, 1.0])
    with pytest.raises(ValueError):
        c.add(10, [1.0, 1.0])
    assert len(before) == 5 and len(c) == 6


def test_sharding(spark):
    p = randoms(spark, 150, 8)
    flat_c = FlatCollection.create(spark, 8).add_batch(p)
    s = ShardedCollection.create(spark, 8, 4).add_batch(p)
    q = p.where("id < 5").select(F.col("id").alias("qid"), "vector")
    key = lambda df: sorted((r.qid, r.rank, r.id) for r in df.collect())
    assert key(s.search_batch(q, 10)) == key(flat_c.search_batch(q, 10))
    assert s.shard_sizes().agg(F.sum("size")).first()[0] == 150
    sizes = np.bincount((splitmix64(np.arange(1, 1001)) % np.uint64(8)).astype(int))
    assert sizes.min() >= 62 and sizes.max() <= 250


def test_metadata(spark):
    m = MetadataStore.create(spark)
    for i, (cat, n) in enumerate([("a", 50), ("b", 75), ("a", 150)]):
        m = m.set(i, "cat", cat).set(i, "n", n)
    m = m.set(0, "n", 5).set(3, "n", float("nan")).set(4, "flag", True)
    found = lambda e: sorted(r.id for r in m.matching(e).collect())
    assert found(("and", ("gt", "n", 100), ("eq", "cat", "a"))) == [2]
    assert found(("eq", "n", 5.0)) == [0] and found(("lt", "n", 100)) == [0, 1]
    assert found(("not", ("eq", "cat", "a"))) == [1, 3, 4] and found(("eq", "n", float("nan"))) == []
    assert found(("gt", "cat", 1)) == [] and found(("eq", "flag", True)) == [4] and not m.matches(99, ("not", ("eq", "x", 1)))
    assert m.get(0, "n") == 5 and m.get_all(77) is None and len(m.remove(0)) == 4
    results = spark.createDataFrame([(i + 1, i, float(i)) for i in range(5)], "rank int, id long, score double")
    assert [(r.rank, r.id) for r in filtered_top_k(results, m, ("eq", "cat", "a"), 5).orderBy("rank").collect()] == [(1, 0), (2, 2)]
    for bad, text in ((("xyz", "f", 1), "unknown filter operator 'xyz'"), ("eq", "must be a tuple"), ((), "cannot be empty"), (("eq", "f"), "'eq' filter expects 3"), (("not", ("eq", "a", 1), ("eq", "b", 2)), "'not' filter expects 2")):
        with pytest.raises(ValueError, match=text):
            parse_filter(bad)
    with pytest.raises(TypeError):
        tagged([1])


def test_kmeans(spark):
    p = spark.createDataFrame([(0, [1.0, 1.0]), (1, [1.0, 2.0]), (2, [9.0, 9.0]), (3, [9.0, 8.0])], "id long, vector array<float>")
    r = kmeans(p, KMeansConfig(k=2))
    assert sorted(map(tuple, r.centroids.tolist())) == [(1.0, 1.5), (9.0, 8.5)]
    again = kmeans(p, KMeansConfig(k=2))
    assert (again.centroids == r.centroids).all() and r.assignments.count() == 4
    twenty = spark.createDataFrame([(i, [0.0, 0.0] if i < 10 else [100.0, 100.0]) for i in range(20)], "id long, vector array<float>")
    assert np.isfinite(kmeans(twenty, KMeansConfig(k=5, max_iterations=5)).centroids).all()
    assert len(plus_plus(np.ones((3, 2)), 5, 0)) == 5


def test_ivf(spark):
    p = randoms(spark, 300, 8)
    index = IVFIndex.create(spark, 8, 8)
    with pytest.raises(ValueError, match="trained"):
        index.add(1, [0.0] * 8)
    index = index.train(p, KMeansConfig(k=8, max_iterations=5)).add_batch(p)
    truth = search_batch(p, p.where("id < 10").select(F.col("id").alias("qid"), "vector"), 5).cache()
    q = p.where("id < 10").select(F.col("id").alias("qid"), "vector")
    recalls = [E.recall_at_k(index.search_batch(q, 5, n), truth, 5) for n in (1, 4, 8)]
    assert recalls == sorted(recalls) and recalls[-1] == 1
    assert index.search([0.0] * 8, 5, 0).count() == 0 and index.nprobe_coverage([0.0] * 8, 8) == 300
    assert index.cluster_sizes().agg(F.sum("size")).first()[0] == 300 and len(index.delete(3).compact()) == 299
    assert nearest_centroid([0.0], np.array([[1.0], [-1.0]])) == 0 and nearest_clusters([0.0], np.array([[2.0], [1.0]]), 5) == [1, 0]
    moved = index.update(3, [9.0] * 8)
    assert len(moved) == 300


def test_pq(spark):
    p = randoms(spark, 200, 8)
    books = train_pq(p, PQConfig(4, 8, 10))
    x = np.array([r.vector for r in p.collect()], float)
    codes = books.encode(x)
    table = books.adc_table(x[0])
    assert Codebooks.adc_distances(table, codes) == pytest.approx(((books.decode(codes) - x[0]) ** 2).sum(1))
    index = IVFPQIndex.create(spark, 8, 4, PQConfig(4, 8, 10)).train(p, KMeansConfig(k=4, max_iterations=3)).add_batch(p)
    assert index.memory_footprint_bytes() == 200 * 4 + 4 * 8 * 4 + 4 * 8 * 2 * 4
    assert index.search(x[0].tolist(), 3, 0).count() == 3 and index.delete(1).total_records() == 200
    with pytest.raises(ValueError, match="divisible"):
        IVFPQIndex.create(spark, 7, 4, PQConfig(4, 8))
    with pytest.raises(ValueError, match="256"):
        train_pq(p, PQConfig(4, 257))


def test_hnsw(spark):
    p = randoms(spark, 400, 16)
    q = p.where("id < 20").select(F.col("id").alias("qid"), "vector")
    index = HnswIndex.create(spark, 16, config=HnswConfig(16, 100, 50)).insert_batch(p, shard_rows=200)
    truth = search_batch(p, q, 5).cache()
    assert E.recall_at_k(index.search_batch(q, 5, 100), truth, 5) >= 0.9
    assert 0 not in {r.id for r in index.delete(0).search([0.0] * 16, 400, 400).collect()}
    assert index.max_layer_distribution().agg(F.sum("count")).first()[0] == 400
    assert ml_factor(16) == pytest.approx(1 / math.log(16)) and layer_from_uniform(2.5, 0.36) == 0 and layer_from_uniform(-1, 0.36) < 10
    assert abs((layers_of(np.arange(100_000), 16) == 0).mean() - 0.9375) < 0.005


def test_evaluation(spark):
    t = spark.createDataFrame([(0, 1, 1), (0, 2, 2), (0, 3, 3)], "qid long, rank int, id long")
    f = spark.createDataFrame([(0, 1, 1), (0, 2, 2), (0, 3, 4)], "qid long, rank int, id long")
    assert E.recall_at_k(f, t, 3) == pytest.approx(2 / 3) and E.recall_at_k(f, t, 0) == 0
    s = E.summarize_timings(spark.createDataFrame([(0.1,), (0.2,), (0.3,)], "seconds double"), 100).first()
    assert s.mean_s == pytest.approx(0.2) and s.stddev_s == pytest.approx(0.1) and s.mean_qps == pytest.approx(611.111, 1e-4) and s.high_variance
    sweep = spark.createDataFrame([(1, 0.40, 2000.0), (5, 0.80, 1000.0), (10, 0.92, 600.0)], "param int, recall double, qps double")
    got = {x: E.iso_recall(sweep, x).first() for x in (0.9, 0.8, 0.2, 0.99)}
    assert got[0.9].qps == pytest.approx(666.667, 1e-4) and got[0.9].param == pytest.approx(9.1667, 1e-4)
    assert (got[0.8].method, got[0.8].qps) == ("exact", 1000) and got[0.2].qps == 2000 and got[0.99].method == "nearest_boundary_upper"
    assert E.compute_qps(0, 1) == 0 and E.compression_ratio(10, 5) == 2 and len(E.run_trials(lambda: None, 2, 1)) == 2


def test_text_store(spark):
    vectors = {"apple is a fruit": [1, 1], "banana is yellow": [1, 1.5], "heavy cargo diesel truck": [9, 9], "fruit": [1, 1.1]}
    texts = spark.createDataFrame([(i, t) for i, t in enumerate(list(vectors)[:3])], "id long, text string")
    store = TextStore.from_table(texts, lambda ts: [list(map(float, vectors[t])) for t in ts])
    assert [r.text for r in store.similarity_search("fruit", 2).collect()] == ["apple is a fruit", "banana is yellow"]
    assert text_id("12") == 12 and text_id("abc") == text_id("abc") >= 0
