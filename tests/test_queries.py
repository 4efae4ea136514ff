"""Every query that has SQL gives that SQL's rows."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in glob.glob(f"{DIR}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    return c


def rows(df):
    plain = lambda v: str(round(float(v), 5) + 0.0) if isinstance(v, float) else str([plain(x) for x in v]) if hasattr(v, "__len__") and not isinstance(v, str) else str(v)
    return sorted(tuple(plain(r[k]) for k in sorted(df.columns)) for r in df.astype(object).to_dict("records"))


@pytest.mark.parametrize("name", [n for n in entry.oracle_sql() if not n.startswith("op") and n != "pipeline"])
def test_query(spark, duck, name):
    got, want = entry.queries()[name](spark, DIR).toPandas(), duck.execute(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)


def test_entry(spark):
    assert entry.entry(spark).count() == 100


def test_layer_draw_takes_all_of_lineitem(spark, duck):
    sql = entry.oracle_sql()["hnsw_layer_draw"].replace(" WHERE l_orderkey < 1000", "")
    got, want = entry.queries()["hnsw_layer_draw"](spark, DIR).toPandas(), duck.execute(sql).df()
    assert len(got) == duck.execute("SELECT count(*) FROM lineitem").fetchone()[0] and rows(got) == rows(want)


@pytest.mark.parametrize("name", [n for n in entry.oracle_sql() if n.startswith("meta_") or n in ("filtered_topk", "prefiltered_topk")])
def test_metadata_of_all_documents(spark, duck, name):
    sql = entry.oracle_sql()[name].replace(" WHERE d.doc_id % 11 <> 0", "").replace(" WHERE doc_id % 11 <> 0", "")
    got, want = entry.queries()[name](spark, DIR).toPandas(), duck.execute(sql).df()
    assert rows(got) == rows(want)


def test_store_holds_all_documents(spark, duck):
    # Vectors without a document are the ids without metadata: no filter matches them, not even a negation.
    found = {r.id for r in entry.queries()["meta_not"](spark, DIR).collect()} | {r.id for r in entry.queries()["meta_eq"](spark, DIR).collect()}
    assert found == {r[0] for r in duck.execute("SELECT doc_id FROM documents").fetchall()}
    assert duck.execute("SELECT count(*) FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM documents)").fetchone()[0] > 0
