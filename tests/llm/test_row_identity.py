import numpy as np
import pytest

from halyard.llm import language_id, mixing, mtree, multi_index, quality_crf
from halyard.llm._common import shared_dir

SCHEMA = "doc_id long, text string, lang string, source string"


def fitted(monkeypatch, module):
    """What a train() of the module fits."""
    seen, own = [], module.fit
    monkeypatch.setattr(module, "fit", lambda *a: (seen.append(a), own(*a))[1])
    return seen


def test_language_training_takes_rows_once(spark, monkeypatch):
    text = lambda w, i: " ".join(f"{w}{chr(97 + (i * k) % 26)}" for k in range(1, 30))
    rows = [(i, text("the", i), "en", "s") for i in range(40)] + [(i, text("ion", i), "fr", "s") for i in range(40, 80)]
    rows += [(3, text("the", 3), "en", "s")] * 50 + [(4, "nada de nada", None, "s")] * 5 + [(None, "no id here", "en", "s")] + [(41, text("der", 1), "de", "s"), (5, "", "en", "s"), (6, None, "en", "s")]
    docs = spark.createDataFrame(rows, SCHEMA)
    seen = fitted(monkeypatch, language_id)
    model = language_id.train(docs)
    fold = {r.doc_id for r in language_id.identify(docs, model).where("held_out").collect()}
    want = sorted({(i, t, lang) for i, t, lang, _ in rows if i is not None and lang and t and i not in fold})
    assert sorted(seen[0][1]) == sorted(lang for _, _, lang in want)
    seen.clear()
    language_id.train(docs, per_language=7, most=12)
    assert len(seen[0][1]) == 12 and max(seen[0][1].count(x) for x in ("en", "fr", "de")) <= 7
    one = language_id.train(spark.createDataFrame([(1, "un texte", "fr", "s")], SCHEMA))
    assert language_id.identify(docs, one).where("lang_pred NOT IN ('fr', 'und')").count() == 0
    assert language_id.keep_identified(docs.limit(0), model).count() == 0


def test_quality_training_takes_rows_once(spark, monkeypatch):
    rows = [(i, f"Good line {i}.\nAnother one.", "en", "s") for i in range(30)] + [(i, f"@@ {i} ##\n$$ %%", "en", "s") for i in range(30, 60)]
    rows += [(2, "Good line 2.\nAnother one.", "en", "s")] * 300 + [(0, "a second text\n" * 5000, "en", "s"), (None, "no id", "en", "s")]
    docs = spark.createDataFrame(rows, SCHEMA)
    labels = spark.createDataFrame([(i, int(i < 30)) for i in range(60)] + [(2, 1)] * 40 + [(8, 0), (9, None), (None, 1), (10, 7)], "doc_id long, quality int")
    seen = fitted(monkeypatch, quality_crf)
    chain = quality_crf.train(docs, labels)
    out = {r.doc_id for r in quality_crf.score_quality(docs, chain).where("NOT held_out").collect()} - {None, 8}
    _, per, truth = seen[0]
    assert len(per) == len({(i, t) for i, t, _, _ in rows if i in out}) and per.max() == min(5001, quality_crf.TRAIN_LINES) and truth.sum() == len({(i, t) for i, t, _, _ in rows if i in out and i < 30})
    seen.clear()
    quality_crf.train(docs, labels, train_docs=5)
    assert len(seen[0][1]) <= 5
    assert quality_crf.keep_good(docs.limit(0), chain).count() == 0 and quality_crf.train(docs.limit(0), labels) == 0.5


def test_mtree_scores_beyond_64_bits(spark):
    rng = np.random.default_rng(4)
    rows = [(i, (rng.normal(size=256) * 2e5).tolist()) for i in range(0, 300, 2)] + [(200, [1e18] * 256)]
    out = mtree.exact_topk(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=5).collect()
    whole = [(i, [int(np.floor(1024 * v)) for v in x]) for i, x in rows]
    asked = [(i, x) for i, x in whole if i % 100 == 0]
    want, top = [], (1 << 63) - 1
    for i, x in asked:
        own = sorted((-max(-top - 1, min(top, sum(a * b for a, b in zip(x, y, strict=True)))), j) for j, y in whole if j != i)[:5]
        want += [(i, r + 1, j, -s) for r, (s, j) in enumerate(own)]
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in out) == sorted(want)


@pytest.mark.parametrize("search", [lambda d: mtree.exact_topk(d, k=3), lambda d: multi_index.nearest(d, k=3, every=100)])
def test_searches_of_repeated_rows_and_clashing_names(spark, search):
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (1, [0.5, 0.5]), (1, [0.5, 0.5]), (2, [0.25, 0.0]), (None, [9.0, 9.0])]
    names = ("v", "dim", "shard", "block", "row", "score", "rank", "query_id")
    docs = spark.createDataFrame([(*r, *["x"] * len(names)) for r in rows], "vec_id long, embedding array<double>, " + ", ".join(f"{n} string" for n in names))
    out = sorted((r.query_id, r["rank"], r.vec_id) for r in search(docs).collect())
    assert out == sorted([(0, 1, 1), (0, 2, 1), (0, 3, 2)] * 2)
    assert search(docs.limit(0)).count() == 0


def test_multi_index_of_many_dimensions_and_small_tables(spark):
    rng = np.random.default_rng(6)
    rows = [(i, rng.normal(size=2 + i % 100).tolist()) for i in range(600)]
    out = multi_index.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=2).collect()
    best = {}
    for i, x in rows:
        if i % 20 == 0:
            best[i] = [j for _, j in sorted((-float(np.dot(x, y)), j) for j, y in rows if j != i and len(y) == len(x))[:2]]
    got = {i: [r.vec_id for r in sorted(out, key=lambda r: r["rank"]) if r.query_id == i] for i in best}
    assert np.mean([len(set(got[i]) & set(best[i])) / len(best[i]) for i in best]) >= 0.9


def test_multi_index_leaves_cells_out_where_vectors_cluster():
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(40, 16)) * 4
    x = centres[rng.integers(0, 40, 3000)] + rng.normal(size=(3000, 16)) * 0.3
    from halyard.llm.vectors import unpack

    stats, hits = {}, []
    for r, ids, _ in multi_index.search(unpack(multi_index.build(x, np.arange(3000))), x[:100], np.arange(100), 20, stats):
        scores = x @ x[r]
        scores[r] = -np.inf
        hits.append(len(set(ids.tolist()) & set(np.argsort(-scores)[:20].tolist())) / 20)
    assert np.mean(hits) >= 0.9 and stats["met"] < 0.25 * 100 * 3000


def test_every_block_of_many_shards_is_dealt(spark):
    text = lambda i: " ".join(f"w{k}" for k in range(1 + (i * 37) % 90))
    docs = spark.createDataFrame([(i, text(i), None, f"src{i % 3}") for i in range(600)], SCHEMA)
    out = mixing.mix(docs, shard_docs=10).collect()
    taken, target = {}, {}
    for r in out:
        target[r.source_size, r.target] = r.target
        taken[r.source_size, r.target] = taken.get((r.source_size, r.target), 0) + r.taken
    assert all(r.taken <= 2 * r["size"] for r in out) and all(abs(taken[k] - target[k]) <= 16 * 30 for k in target)
    assert abs(sum(taken.values()) - 1.5 * sum(r["size"] for r in out)) <= 16 * 24


def test_blocks_above_a_limit_go_to_others():
    seats = mixing.apportion(np.array([10, 10, 10]), 12, np.array([2, 9, 9]))
    assert seats.tolist() == [2, 5, 5] and mixing.apportion(np.array([5, 5]), 20, np.array([3, 4])).tolist() == [3, 4]


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    class Conf:
        def get(self, *_):
            return None

    class Folder:
        def isEmpty(self):
            return True

    class Session:
        conf = Conf()

        class sparkContext:  # noqa: N801
            master = "spark://host:7077"

            class _jsc:  # noqa: N801
                @staticmethod
                def sc():
                    class Context:
                        def getCheckpointDir(self):
                            return Folder()

                    return Context()

    with pytest.raises(RuntimeError):
        shared_dir(Session(), "x")
