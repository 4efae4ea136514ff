"""The SQL of this subpackage's queries gives their rows."""

import glob
import os

import pytest

duckdb = pytest.importorskip("duckdb")

from halyard.llm.oracles import ORACLES  # noqa: E402
from halyard.llm.queries import QUERIES  # noqa: E402

DIR = "/root/testdata/sf0.001"


def rows(df):
    plain = lambda v: "" if v is None or v != v else str(round(float(v), 5) + 0.0) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    return sorted(tuple(plain(r[k]) for k in sorted(df.columns)) for r in df.astype(object).where(df.notna(), None).to_dict("records"))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, name):
    c = duckdb.connect()
    for f in glob.glob(f"{DIR}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    got, want = QUERIES[name](spark, DIR).toPandas(), c.execute(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)
