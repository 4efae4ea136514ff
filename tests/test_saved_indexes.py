import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from halyard.operators.collection import FlatCollection
from halyard.operators.hnsw import Graph, HnswConfig, HnswIndex
from halyard.operators.ivf import IVFIndex
from halyard.operators.kmeans import KMeansConfig, nearest, step
from halyard.operators.pq import IVFPQIndex, PQConfig
from halyard.operators.sharding import ShardedCollection
from halyard.operators.topk import best_columns, best_of_rows
from halyard.plans.catalog import Engine
from halyard.plans.storage import scratch_dir


@pytest.fixture(scope="module")
def rows(spark):
    x = np.random.default_rng(3).normal(size=(400, 8)).astype(np.float32)
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vector array<float>").cache()


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_ivf_reads_only_probed_folders(spark, rows, tmp_path):
    index = IVFIndex.create(spark, 8, 5).train(rows, KMeansConfig(k=5, max_iterations=10)).add_batch(rows)
    index.save(f"file://{tmp_path}/ivf")
    loaded = IVFIndex.load(spark, f"file://{tmp_path}/ivf")
    q = [0.1] * 8
    found = loaded.search(q, 5, nprobe=2)
    assert "PartitionFilters: [cluster_id" in plan(found)
    assert found.collect() == index.search(q, 5, nprobe=2).collect() and (loaded.centroids == index.centroids).all()
    assert {f.split("cluster_id=")[1].split("/")[0] for f in loaded.postings.where("cluster_id IN (1, 3)").inputFiles()} >= {"1", "3"} and len(loaded) == 400
    with pytest.raises(ValueError):
        loaded.add(3, q)
    assert len(loaded.delete(3)) == 399


def test_ivfpq_loads_a_searchable_index(spark, rows, tmp_path):
    index = IVFPQIndex.create(spark, 8, 4, PQConfig(4, 16, 5)).train(rows, KMeansConfig(k=4, max_iterations=5)).add_batch(rows)
    index.save(f"file://{tmp_path}/pq")
    loaded = IVFPQIndex.load(spark, f"file://{tmp_path}/pq")
    asked = rows.where("id < 6").toDF("qid", "vector")
    found = loaded.search_batch(asked, 4, nprobe=1)
    assert sorted(found.collect()) == sorted(index.search_batch(asked, 4, nprobe=1).collect())
    assert re.search(r"PartitionFilters: \[[^\]]*cluster_id", plan(loaded.search([0.5] * 8, 3))) and loaded.memory_footprint_bytes() == index.memory_footprint_bytes()


def test_shards_are_read_as_such(spark, rows, tmp_path):
    held = ShardedCollection.create(spark, 8, 4, "cosine").add_batch(rows)
    held.save(f"file://{tmp_path}/s")
    loaded = ShardedCollection.load(spark, f"file://{tmp_path}/s")
    one = loaded.lookup(17)
    assert "PartitionFilters: [isnotnull(shard" in plan(one) and one.first().vector == rows.where("id = 17").first().vector
    assert (loaded.dim, loaded.metric, loaded.is_empty(), len(loaded)) == (8, "cosine", False, 400)
    q = [1.0] * 8
    assert loaded.search(q, 7).collect() == held.search(q, 7).collect()
    grown = loaded.add(1000, q)
    assert grown.lookup(1000).count() == 1 and grown.search(q, 1).first().id == 1000


def test_graphs_take_rows_without_a_rebuild(spark, rows, tmp_path, monkeypatch):
    index = HnswIndex.create(spark, 8, "euclidean", HnswConfig(8, 64, 64)).insert_batch(rows.where("id < 300"))
    monkeypatch.setattr(HnswIndex, "rebuild", lambda *_: pytest.fail("built anew"))
    grown = index.insert_batch(rows.where("id >= 300"))
    assert grown.nodes().count() == 400 and grown.total_nodes() == 400
    asked = rows.where("id % 40 = 0").toDF("qid", "vector")
    exact = FlatCollection.from_table(rows, "id", "vector", 8).search_batch(asked, 5)
    both = grown.search_batch(asked, 5, ef=100).join(exact, ["qid", "id"])
    assert both.count() >= 0.9 * exact.count()
    grown.save(f"file://{tmp_path}/g")
    loaded = HnswIndex.load(spark, f"file://{tmp_path}/g")
    assert sorted(loaded.search_batch(asked, 5, ef=100).collect()) == sorted(grown.search_batch(asked, 5, ef=100).collect())
    shard, node = loaded.internal_index_of(310)
    assert loaded.nodes().where((F.col("shard") == shard) & (F.col("node") == node)).first().id == 310 and loaded.internal_index_of(9999) is None
    assert loaded.entry_points().count() == loaded.shards
    with pytest.raises(ValueError):
        grown.insert_batch(rows.where("id = 5"))
    monkeypatch.undo()
    back = grown.delete(7).insert_batch(spark.createDataFrame([(7, [0.25] * 8)], rows.schema))
    assert len(back) == 400 and back.search([0.25] * 8, 1, ef=50).first().id == 7
    back.release()


def test_extending_a_graph_equals_building_it():
    x, ids = np.random.default_rng(0).normal(size=(60, 4)), np.arange(60)
    whole = Graph.build(ids, x, HnswConfig(4, 20, 20))
    parts = Graph.unpack(Graph.build(ids[:25], x[:25], HnswConfig(4, 20, 20)).pack(), HnswConfig(4, 20, 20)).extend(ids[25:], x[25:])
    assert whole.neighbours == parts.neighbours and whole.entry == parts.entry


@pytest.mark.parametrize("row", [(5000, None), (5000, [1.0] * 7), (-1, [1.0] * 8), (None, [1.0] * 8), (5000, [float("nan")] * 8), (5000, [1.0] * 7 + [None])])
def test_batches_are_checked(spark, rows, row):
    c = FlatCollection.from_table(rows, "id", "vector", 8)
    with pytest.raises(ValueError):
        c.add_batch(spark.createDataFrame([(6000, [0.0] * 8), row], rows.schema))


def test_checkpoints_cut_the_log(spark, tmp_path):
    engine = Engine(spark, f"file://{tmp_path}/e")
    engine.create_collection("c", 2)
    for i in range(4):
        engine.insert("c", i, [float(i), 0.0])
        engine.checkpoint("c")
    kept = sorted(p.name for p in (tmp_path / "e" / "c").iterdir() if p.name.startswith("v="))
    assert kept == ["v=3", "v=4"] and {p.name for p in (tmp_path / "e" / "c" / "log").iterdir()} <= {"3", "4"}
    again = Engine(spark, f"file://{tmp_path}/e")
    again.delete("c", 1)
    assert sorted(r.id for r in again.points("c").collect()) == [0, 2, 3]
    with pytest.raises(ValueError):
        again.search("c", [0.0, 0.0], 1, nprobe=-1)


def test_best_of_rows_settles_ties():
    rng = np.random.default_rng(1)
    scores, ids = rng.integers(0, 6, (30, 50)).astype(float), np.stack([rng.permutation(50) for _ in range(30)])
    scores[3, :] = np.nan
    for largest in (False, True):
        for k in (0, 1, 7, 50, 80):
            got = best_of_rows(scores, ids, k, largest)
            for s, i, g in zip(scores, ids, got, strict=True):
                assert sorted(i[g].tolist()) == sorted(i[best_columns(s, i, k, largest)].tolist())


def test_kmeans_of_tiny_and_huge_values(spark):
    x = [(0, [1e-20, 0.0]), (1, [3e-20, 0.0]), (2, [1e30, 0.0]), (3, [3e30, 0.0])]
    moved, n = step(spark.createDataFrame(x, "id long, vector array<double>"), np.array([[0.0, 0.0], [1.5e30, 0.0]]))
    assert n.tolist() == [2, 2] and moved[:, 0].tolist() == [pytest.approx(2e-20), pytest.approx(2e30)]
    p, c = np.random.default_rng(2).normal(size=(500, 6)), np.random.default_rng(3).normal(size=(9, 6))
    assert (nearest(p, np.vstack([c, c])) == ((p[:, None] - c[None]) ** 2).sum(2).argmin(1)).all()


def test_scratch_needs_a_shared_folder_on_a_cluster():
    class Session:
        class conf:  # noqa: N801
            @staticmethod
            def get(*_):
                return None

        class sparkContext:  # noqa: N801
            master = "spark://h:1"

    with pytest.raises(RuntimeError):
        scratch_dir(Session(), "x")
