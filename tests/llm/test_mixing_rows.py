import collections

from pyspark.sql import functions as F

from halyard.llm import mixing
from halyard.llm._common import materialise


def planned(docs):
    """Words of each doc_id that the plan takes."""
    total = collections.Counter()
    for r in mixing.mix(docs).collect():
        total[r.doc_id] += r.taken
    return +total


def test_repeated_and_null_ids_keep_their_own_plan(spark):
    text = lambda i, n: " ".join(f"t{i}w{k}" for k in range(n))
    rows = [(i, text(i, 20 + i), f"src{i % 2}") for i in range(30)]
    rows += [(1008, "same same words here now", "src0")] * 5
    rows += [(2000, text(f"a{k}", 3 + 40 * k), f"src{k % 2}") for k in range(4)]
    rows += [(None, text(f"n{k}", 5 + 30 * k), f"src{k % 2}") for k in range(4)] + [(None, text("same", 70), "src0")] * 2
    docs = materialise(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3), "docs")
    mixed = mixing.mixed_documents(docs).collect()
    got = collections.Counter()
    for r in mixed:
        got[r.doc_id] += len(r.text.split())
    assert +got == planned(docs)
    # A part is cut from a text of its own row, and no row has more than two copies.
    held = collections.Counter((i, s, t) for i, t, s in rows)
    for r in mixed:
        assert any((i, s) == (r.doc_id, r.source) and (r.text.strip() in t or all(w in t.split() for w in r.text.split())) for i, s, t in held)
    whole = collections.Counter((r.doc_id, r.source, r.text) for r in mixed)
    assert all(whole[k] <= 2 * n for k, n in held.items())
    again = mixing.mixed_documents(docs.orderBy(F.rand(1))).collect()
    assert sorted(again, key=str) == sorted(mixed, key=str)


def test_documents_without_rows(spark):
    assert mixing.mixed_documents(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0
