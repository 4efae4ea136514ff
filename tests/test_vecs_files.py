"""fvecs and ivecs files of whole tables: ids kept, pieces of bounded size, nothing read that a lost attempt left."""

import glob
import os

import numpy as np
import pytest

import __spark_entry__ as entry
from halyard.sources import vecs


def table(spark, rows, parts=3):
    return spark.createDataFrame(rows, "id long, vector array<float>").repartitionByRange(parts, "id").sortWithinPartitions("id")


def test_equal_vectors_keep_their_own_ids(spark, tmp_path):
    rows = [(i, [float(i % 3), 0.5] + [0.25] * 62, 0) for i in range(30)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = entry.queries()["fvecs_roundtrip"](spark, str(tmp_path)).collect()
    assert sorted((r.id, r.vector) for r in got) == [(i, v) for i, v, _ in rows]


def test_ids_and_vectors_come_from_the_files(spark, tmp_path):
    ids = [0, 7, 2**31 - 1, 2**31, 2**32 + 5, 2**40, 2**63 - 1, *range(100, 120)]
    f, i = str(tmp_path / "f"), str(tmp_path / "i")
    names = vecs.write_vecs(table(spark, [(n, [float(k % 2), -0.0, float("nan")]) for k, n in enumerate(ids)]), f, ids=i, file_bytes=64)
    assert len(names) > 3 and max(map(os.path.getsize, names)) <= 64 and len(glob.glob(f"{i}/*.ivecs")) == len(names)
    read = [vecs.parse_vecs(open(n.replace(f, i).replace(".fvecs", ".ivecs"), "rb").read(), "ivecs") for n in names]
    assert np.concatenate(read).reshape(-1).view("<i8").tolist() == sorted(ids)  # rows keep their order over the files
    got = vecs.read_vecs_with_ids(spark, f, i).collect()
    assert sorted(str((r.id, r.vector)) for r in got) == sorted(str((n, [float(k % 2), -0.0, float("nan")])) for k, n in enumerate(ids))


def test_lost_attempts_are_not_read(spark, tmp_path):
    f = tmp_path / "f"
    f.mkdir()
    (f / "_0123-0").write_bytes(vecs.format_vecs(np.ones((5, 2)), "fvecs"))
    vecs.write_vecs(table(spark, [(1, [1.0, 2.0])]), str(f))
    assert [r.vector for r in vecs.read_vecs(spark, str(f)).collect()] == [[1.0, 2.0]]
    with pytest.raises(FileExistsError):
        vecs.write_vecs(table(spark, [(1, [1.0, 2.0])]), str(f))


def test_odd_tables(spark, tmp_path):
    vecs.write_vecs(table(spark, []), str(tmp_path / "none"), ids=str(tmp_path / "ids"))
    assert vecs.read_vecs_with_ids(spark, str(tmp_path / "none"), str(tmp_path / "ids")).count() == 0
    for k, rows in enumerate(([(1, [1.0]), (9, [1.0, 2.0])], [(1, None)], [(1, [None])], [(1, [])])):
        with pytest.raises(Exception, match="dimension"):
            vecs.write_vecs(table(spark, rows), str(tmp_path / f"bad{k}"))
        assert vecs.read_vecs(spark, str(tmp_path / f"bad{k}")).count() == 0
    with pytest.raises(ValueError, match="32 bits"):
        vecs.format_vecs(np.array([[2**31]]), "ivecs")
