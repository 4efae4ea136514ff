"""Rounded numbers are those of the SQL bit for bit, the sign of zero and halves included."""

import struct

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from halyard.functions import vector as V

ODD = [-2e-8, 2e-8, -0.0, 0.0, -4e-7, 2**-7, -(2**-7), 4.1744875, -4.1744875, 8.2215955, 5e-7, 1e305, float("nan"), float("-inf")]


def bits(x):
    return "nan" if x != x else struct.pack("<d", x)


def rows(found, names):
    return sorted((r[0], *([bits(x) for x in v] if isinstance(v, list) else bits(v) for v in r[1:])) for r in (tuple(r[n] for n in names) for r in found))


def both(spark, folder, name):
    """The rows of a query and of its SQL over the table `embeddings` of a folder."""
    c = duckdb.connect()
    c.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{folder}/embeddings.parquet/*.parquet')")
    got = entry.queries()[name](spark, str(folder))
    names = ["id", *(n for n in got.columns if n != "id")]
    found = c.execute(entry.oracle_sql()[name])
    held = [d[0] for d in found.description]
    return rows([r.asDict() for r in got.collect()], names), rows([dict(zip(held, r, strict=True)) for r in found.fetchall()], names)


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    """Vectors with components that round to -0.0."""
    folder = tmp_path_factory.mktemp("small")
    vectors = [(i, [0.5, -3e-8 * (i + 1), 2**-7, -(2**-7), *[0.01 * (i + 1)] * 60], 0) for i in range(12)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(f"{folder}/embeddings.parquet")
    return folder


@pytest.mark.parametrize("digits", [4, 5, 6])
def test_round_to(spark, digits):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(ODD)], "i int, x double")
    got = [bits(r.r) for r in df.select("i", V.round_to("x", digits).alias("r")).orderBy("i").collect()]
    assert got == [bits(duckdb.execute(f"SELECT round(?::DOUBLE, {digits})", [x]).fetchone()[0]) for x in ODD]
    assert df.select(V.round_to(F.lit(None).cast("double"), 6).alias("r")).first().r is None


@pytest.mark.parametrize("name", ["fvecs_roundtrip", "vec_normalize", "sharded_point_lookup", "flat_point_lookup", "vec_pair_scores"])
def test_sign_of_zero(spark, small, name):
    got, want = both(spark, small, name)
    assert got == want
