import corpus_pipeline
from halyard.llm import near_dedup


def text(name, changed=()):
    return " ".join(f"x{i}" if i in changed else f"{name}{i}" for i in range(120))


def table(spark):
    rows = [(None, text("a")), (None, text("a", {5})), (None, text("a")), (None, text("lone"))]  # near and exact copies, all without an id
    rows += [(7, text("b")), (7, text("c")), (8, text("b", {9})), (9, text("c", {9})), (7, text("d"))]  # an id of three texts
    rows += [(20, text("e")), (20, text("e")), (None, text("e", {3})), (30, ""), (30, ""), (None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_null_and_repeated_ids_are_linked(spark):
    docs = table(spark)
    found = near_dedup.near_duplicates(docs).collect()
    assert len(found) == docs.count()
    by = sorted((r.doc_id or 0, r.component_id or 0) for r in found)
    assert by == [(0, 0)] * 5 + [(0, 20)] + [(7, 7)] * 3 + [(8, 7), (9, 7)] + [(20, 20)] * 2 + [(30, 30)] * 2
    alone = docs.where("doc_id IS NULL AND text LIKE 'a0 %'")
    links = near_dedup.near_duplicates(alone.unionByName(spark.createDataFrame([(1, text("a", {5, 50}))], docs.schema)))
    assert [r.component_id for r in links.collect()] == [1] * 4


def test_stage_keeps_one_row_of_each_group(spark):
    out = corpus_pipeline.drop_near_duplicates(spark, table(spark), "").collect()
    kept = sorted((r.doc_id or 0, (r.text or "").split(" ")[0]) for r in out)
    assert kept == [(0, ""), (0, "a0"), (0, "lone0"), (7, "b0"), (7, "c0"), (7, "d0"), (20, "e0"), (30, ""), (30, "")]
