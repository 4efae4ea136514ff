import numpy as np
import pytest

from halyard.operators.hnsw import Graph, HnswConfig
from halyard.plans.catalog import Conflict, Engine, NotFound, validate_name, validate_search
from halyard.sources import vcta, vecs
from halyard.streaming.oplog import current_points, ingest, read_ops


def test_vecs(spark, tmp_path):
    x = np.array([[1, 2.5, -3, 4.25], [0, 0.5, 1, 1.5]], "f4")
    assert (vecs.parse_vecs(vecs.format_vecs(x, "fvecs"), "fvecs") == x).all()
    assert vecs.parse_vecs(vecs.format_vecs(np.array([[10, 20]]), "ivecs"), "ivecs").tolist() == [[10, 20]]
    with pytest.raises(ValueError):
        vecs.parse_vecs(vecs.format_vecs(x, "fvecs")[:-2], "fvecs")
    df = spark.createDataFrame([(v.tolist(),) for v in x], "vector array<float>").coalesce(1)
    vecs.write_vecs(df, str(tmp_path / "v"))
    assert [r.vector for r in vecs.read_vecs(spark, str(tmp_path / "v")).orderBy("row").collect()] == x.tolist()


def test_snapshots(spark, tmp_path):
    rng = np.random.default_rng(0)
    ids, x = np.arange(6) * 3, rng.normal(size=(6, 4)).astype("f4")
    owner, centroids = np.array([0, 1, 1, 0, 2, 2]), rng.normal(size=(3, 4)).astype("f4")
    config = HnswConfig(4, 8, 8)
    for s in (
        vcta.Snapshot("flat", "cosine", 4, ids, x), vcta.Snapshot("ivf", "euclidean", 4, ids, x, owner, centroids),
        vcta.Snapshot("hnsw", "dot_product", 4, ids, x, graph=Graph.build(ids, x.astype(float), config), config=config),
        vcta.Snapshot("ivfpq", "euclidean", 4, ids, None, owner, centroids, codes=rng.integers(0, 4, (6, 2)).astype(np.uint8), codebooks=rng.normal(size=(2, 4, 2)).astype("f4")),
    ):
        raw = vcta.dumps(s)
        back = vcta.loads(raw)
        assert vcta.dumps(back) == raw and vcta.peek_index_type(raw) == s.index_type and sorted(back.ids.tolist()) == ids.tolist()
        with pytest.raises(ValueError):
            vcta.loads(raw[:-1])
    (tmp_path / "a.vcta").write_bytes(vcta.dumps(vcta.Snapshot("flat", "cosine", 4, ids, x)))
    assert vcta.read_points(spark, str(tmp_path / "a.vcta")).count() == 6
    with pytest.raises(ValueError, match="magic"):
        vcta.header(b"XXXX" + bytes(30))


def test_log_format():
    raw = b"".join(vcta.log_entry(i, [1.0, 2.0, 3.0]) for i in (101, 102))
    assert vcta.replay_log(raw) == [(101, [1, 2, 3]), (102, [1, 2, 3])]
    assert len(vcta.replay_log(raw[:-3])) == 1 and len(vcta.replay_log(raw + b"\1\0")) == 2
    with pytest.raises(ValueError):
        vcta.replay_log(b"\x0d\0\0\0\x09" + bytes(12))


def test_catalog(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "db"))
    e.create_collection("docs", 2)
    with pytest.raises(Conflict):
        e.create_collection("docs", 2)
    for i in (1, 2, 3):
        e.insert("docs", i, [10.0 * i, 10.0 * i])
    with pytest.raises(Conflict):
        e.insert("docs", 2, [0.0, 0.0])
    with pytest.raises(ValueError):
        e.insert("docs", 9, [float("nan"), 0.0])
    assert e.search("docs", [20.0, 20.0], 1).first().id == 2
    assert e.checkpoint("docs").version == 1
    e.insert("docs", 4, [40.0, 40.0])
    e.delete("docs", 1)
    again = Engine(spark, str(tmp_path / "db"))  # as after a restart
    assert sorted(r.id for r in again.points("docs").collect()) == [2, 3, 4] and again.checkpoint_all() == {}
    e.create_collection("graph", 2, "hnsw", "L2")
    e.insert("graph", 5, [1.0, 1.0])
    assert e.search("graph", [0.0, 0.0], 3).first().id == 5
    e.create_collection("lists", 2, "ivf")
    with pytest.raises(ValueError):
        e.insert("lists", 1, [0.0, 0.0])
    e.insert_batch("lists", spark.createDataFrame([(i, [float(i), 0.0]) for i in range(8)], "id long, vector array<float>"))
    assert e.search("lists", [3.0, 0.0], 1, nprobe=4).first().id == 3
    assert [r.name for r in e.list_collections().collect()] == ["docs", "graph", "lists"]
    e.delete_collection("graph")
    with pytest.raises(NotFound):
        e.info("graph")
    for bad in ("", " a", "x" * 65, "a/b"):
        with pytest.raises(ValueError):
            validate_name(bad)
    with pytest.raises(ValueError):
        validate_search(0)


def test_streaming_log(spark, tmp_path):
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "seq long, op string, id long, vector array<float>"
    spark.createDataFrame([(1, "insert", 1, [1.0]), (2, "insert", 2, [2.0])], schema).write.parquet(source)
    for more in ([], [(3, "delete", 1, None), (2, "insert", 2, [2.0])]):
        if more:
            spark.createDataFrame(more, schema).write.mode("append").parquet(source)
        ingest(read_ops(spark, source), target, str(tmp_path / "cp")).awaitTermination()
    assert [(r.id, r.vector) for r in current_points(spark, target).collect()] == [(2, [2.0])]
