import base64
import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

P = pytest.importorskip("public_tokenizers")

from halyard.llm import katz, language_id, mixing, mtree, multi_index, near_dedup, pieces, quality_crf, warc, wavelet  # noqa: E402
from halyard.llm._common import materialise, shared_dir  # noqa: E402
from halyard.llm.graph import connected_components  # noqa: E402
from halyard.llm.vectors import unpack  # noqa: E402

DIR = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, size string, cid string"


def words(text):
    return [w.decode() for w in re.findall(rb"[^\x20\x09-\x0d]+", bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode()))]


@pytest.fixture(scope="module")
def docs(spark):
    """Documents of the smallest table, with nulls, empty and odd texts, one very long text, repeated rows, and clashing extra columns."""
    own = spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    odd = [(1000, None, "en", None, 0), (1001, "", None, "src0", 0), (1002, " \n\t ", "fr", "src1", 4), (1003, "one Two", "en", None, 7), (1004, "ONE two", "en", "é", 7),
           (1005, "42 !!! %%", None, "src0", 9), (1006, "日本語 x\x1cy 𝔘 ▁ <|endoftext|>", "en", "src1", 20), (1007, "a b c d e " * 30000, "en", "src2", 300000), (1008, "same same words here now", "en", "src2", 24), (1008, "same same words here now", "en", "src2", 24), (None, "no id here", "en", "src3", 10)]
    both = own.union(spark.createDataFrame(odd, "doc_id long, text string, lang string, source string, n_chars long"))
    return materialise(both.withColumns({c: F.lit("x") for c in ("id", "size", "cid")}), "docs")


@pytest.fixture(scope="module")
def rows(docs):
    return docs.collect()


def held(i, m):
    return zlib.crc32(("" if i is None else str(i)).encode()) % m


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_quality(spark, docs):
    labels = spark.read.parquet(f"{DIR}/labels.parquet")
    chain = quality_crf.train(docs, labels)
    out = quality_crf.score_quality(docs, chain).collect()
    assert len(out) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) and r.held_out == (held(r.doc_id, 3) == 1) for r in out)
    truth = {r.doc_id: r.quality for r in labels.collect()}
    known = [r for r in out if r.doc_id in truth and r.held_out]
    assert sum(r.predicted == truth[r.doc_id] for r in known) >= 0.9 * len(known)
    assert quality_crf.train(docs, labels.limit(0)) == 0.5 and quality_crf.train(docs, labels.where("quality = 1")) == 1.0
    assert quality_crf.score_quality(empty(spark), chain).count() == 0 and quality_crf.keep_good(docs, chain).columns == docs.columns


def test_forward_backward_matches_enumeration():
    rng = np.random.default_rng(0)
    per, moves = np.array([1, 4, 2]), rng.normal(size=(2, 2))
    e = rng.normal(size=7)
    good, _, z = quality_crf.forward_backward(e, per, moves)
    at = 0
    for i, n in enumerate(per):
        total, marks = 0.0, np.zeros(n)
        for path in np.ndindex(*(2,) * n):
            w = math.exp(sum(e[at + t] * path[t] for t in range(n)) + sum(moves[a, b] for a, b in zip(path, path[1:], strict=False)))
            total += w
            marks += w * np.array(path)
        assert good[at : at + n] == pytest.approx(marks / total) and z[i] == pytest.approx(math.log(total))
        at += n


def test_mtree_is_exact(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(1500, 8))
    x[100:140] = x[100]
    ids = rng.permutation(3000)[:1500]
    tree, stats = unpack(mtree.build(x, ids)), {}
    z = np.floor(x * 1024).astype(np.int64)
    for r, i, s in mtree.search(tree, x[:30], ids[:30], 10, stats):
        score = z @ z[r]
        want = sorted(((-score[j], ids[j]) for j in range(1500) if ids[j] != ids[r]))[:10]
        assert list(zip((-s).tolist(), i.tolist(), strict=True)) == want
    assert stats["computed"] < 0.9 * 30 * 1500
    rows = [(0, [1.0, 2.0]), (100, [3.0, 1.0]), (7, None), (8, [1.0, None]), (9, [float("nan"), 1.0]), (10, [5.0]), (200, [7.0]), (11, [0.0, 0.0]), (300, [1e300, 1.0])]
    out = mtree.exact_topk(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert [(r.vec_id, r.rank) for r in out if r.query_id == 0] == [(300, 1), (100, 2), (11, 3)] and [r.vec_id for r in out if r.query_id == 200] == [10]
    assert mtree.exact_topk(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_multi_index_recall(spark):
    e = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    out = multi_index.nearest(e).collect()
    data = {r.vec_id: np.array(r.embedding, float) for r in e.collect()}
    ids, x = np.array(list(data)), np.array(list(data.values()))
    found = collections.defaultdict(set)
    for r in out:
        found[r.query_id].add(r.vec_id)
        assert r.score == pytest.approx(data[r.query_id] @ data[r.vec_id], abs=1e-12)
    hits = [len(found[q] & set(ids[np.argsort(-(x @ data[q]) + 9 * (ids == q))[:20]].tolist())) / 20 for q in ids[ids % 20 == 0].tolist()]
    assert np.mean(hits) >= 0.9
    few = multi_index.nearest(spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 0.0]), (2, [1.0, 1.0]), (3, None)], "vec_id long, embedding array<double>")).collect()
    assert [(r.query_id, r.vec_id) for r in few] == [(0, 2)]


def test_language(spark, docs):
    model = language_id.train(docs)
    out = language_id.identify(docs, model).collect()
    by = {r.doc_id: r for r in out}
    assert len(out) == docs.count() and all(by[i].lang_pred == "und" for i in (1000, 1001, 1002, 1005)) and all(0 <= r.score <= 1 for r in out)
    own = [r for r in docs.where("doc_id < 1000").collect() if by[r.doc_id].held_out]
    assert sum(by[r.doc_id].lang_pred == r.lang for r in own) >= 0.9 * len(own)
    assert language_id.identify(docs, language_id.train(empty(spark))).where("lang_pred <> 'und'").count() == 0
    assert language_id.keep_identified(docs, model).where("doc_id IN (1000, 1001, 1002, 1005)").count() == 0


def test_pieces_equal_the_library(docs, rows):
    import sentencepiece

    own = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    out = pieces.encode_decode(docs.where("doc_id IS NOT NULL"), P.path("piece_bpe_32k.model"), with_ids=True).collect()
    texts = {r.doc_id: r.text or "" for r in rows}
    assert len(out) == len(rows) - 1
    for r in out:
        assert r.pieces == own.encode(texts[r.doc_id]) and r.pieces_crc32 == zlib.crc32(np.array(r.pieces, "<u4").tobytes())
        assert r.round_trip or "▁" in texts[r.doc_id]


def test_wavelet_files(spark, docs, rows):
    import tokenizers

    own = tokenizers.Tokenizer.from_file(P.path("word_bpe_49k.json"))
    out = wavelet.token_files(docs, P.path("word_bpe_49k.json")).orderBy("start").collect()
    start = 0
    for got, row in zip(out, sorted(rows, key=lambda r: (r.doc_id is not None, r.doc_id or 0)), strict=True):
        ids = [*own.encode(row.text or "", add_special_tokens=False).ids, 1]
        assert (got.doc_id, got.start, got.n_tokens, got.ids_crc32) == (row.doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert wavelet.token_files(empty(spark), P.path("word_bpe_49k.json")).count() == 0


@pytest.mark.parametrize("top", [1, 2, 300, 70_000])
def test_wavelet_lookups(top):
    x = np.random.default_rng(top).integers(0, top, 5000)
    w = wavelet.WaveletMatrix(wavelet.encode(x, [5], np.array([5000])))
    assert (w.to_array() == x).all() and [w.access(i) for i in (0, 17, 4999)] == x[[0, 17, 4999]].tolist()
    t = int(x[7])
    assert w.count(t) == (x == t).sum() and w.count(t, 100) == (x[:100] == t).sum() and w.count(top * 4) == 0
    assert [w.position(t, k) for k in range(min(3, w.count(t)))] == np.flatnonzero(x == t)[:3].tolist()
    assert wavelet.WaveletMatrix(wavelet.encode(x[:0])).to_array().size == 0
    with pytest.raises(ValueError):
        wavelet.WaveletMatrix(wavelet.encode(x)[:-1])


def test_mixing(spark, docs, rows):
    out = mixing.mix(docs).collect()
    sizes = [len(words(r.text)) for r in rows]
    assert sorted(r["size"] for r in out) == sorted(sizes) and all(0 <= r.taken <= 2 * r["size"] for r in out)
    by = {r.doc_id: r for r in out}
    total = collections.Counter()
    for r, n in zip(rows, sizes, strict=True):
        total[r.source] += n
    order = sorted((s for s in total if s is not None)) + [None] * (None in total)
    weight, left, capped = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}, 1.5 * sum(sizes), set()
    while True:
        unit = (left - sum(2 * total[s] for s in capped)) / sum(w for s, w in weight.items() if s not in capped)
        more = {s for s in order if s not in capped and weight[s] * unit > 2 * total[s]}
        if not more:
            break
        capped |= more
    taken = collections.Counter()
    for r in rows:
        want = 2 * total[r.source] if r.source in capped else weight[r.source] * unit
        assert by[r.doc_id].target == pytest.approx(want) and by[r.doc_id].source_size == total[r.source]
    for r in docs.join(mixing.mix(docs).select("doc_id", "taken", "target").distinct(), "doc_id").select("source", "taken", "target").collect():
        taken[r.source, r.target] += r.taken
    assert all(abs(n - t) <= 64 for (_, t), n in taken.items())
    assert sorted(out, key=str) == sorted(mixing.mix(docs).collect(), key=str)
    mixed = mixing.mixed_documents(docs.where("doc_id <> 1008")).collect()
    plan = {r.doc_id: r.taken for r in mixing.mix(docs.where("doc_id <> 1008")).collect()}
    got = collections.Counter()
    for r in mixed:
        got[r.doc_id] += len(words(r.text))
    assert all(got[i] == n for i, n in plan.items()) and mixing.mix(empty(spark)).count() == 0


def test_apportion_equals_highest_quotients():
    rng = np.random.default_rng(3)
    for _ in range(20):
        w, seats = rng.integers(0, 50, 9), int(rng.integers(1, 200))
        want = np.zeros(9, int)
        for _ in range(seats):
            want[np.argmax(w / (2 * want + 1))] += 1
        assert not w.any() or (mixing.apportion(w, seats) == want).all()


def test_katz(docs, rows):
    out = collections.defaultdict(list)
    for r in katz.score_documents(docs).collect():
        out[r.doc_id].append(r)
    texts = [(r.doc_id, [*words(r.text), "\0end"], held(r.doc_id, 10) == 0) for r in rows]
    c1, c2, after = collections.Counter(), collections.Counter(), collections.defaultdict(collections.Counter)
    for _, w, h in texts:
        if not h:
            c1.update(w)
            for u, v in zip(["\0start", *w], w, strict=False):
                c2[u, v] += 1
                after[u][v] += 1
    numbers = lambda c: np.array([0, *(sum(v == r for v in c.values()) for r in range(1, katz.TOP + 2))], float)
    d1, d2, n = katz.discounts(numbers(c1)), katz.discounts(numbers(c2)), sum(c1.values())
    cut = lambda c, d: c * (d[c] if c <= katz.TOP else 1)
    unknown = 1 - sum(cut(c, d1) for c in c1.values()) / n
    p1 = lambda w: cut(c1[w], d1) / n if w in c1 else unknown

    def p(u, w):
        own = after.get(u)
        if not own:
            return p1(w)
        kept, size = sum(cut(c, d2) for c in own.values()), sum(own.values())
        size = size if size - kept > 1e-9 else size + 1
        return cut(own[w], d2) / size if w in own else (1 - kept / size) / (1 - sum(map(p1, own))) * p1(w)

    for u in list(after)[:20]:
        assert sum(p(u, w) for w in c1) + p(u, "\0unknown") == pytest.approx(1)
    for i, w, h in texts:
        if len(w) > 5000:
            continue
        r = out[i][0]
        base = sum(math.log10((c1[x] + 0.1) / (n + 0.1 * (len(c1) + 1))) for x in w)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (h, len(w), sum(x in c1 for x in w), n)
        assert r.base_score == pytest.approx(base) and r.score == pytest.approx(sum(math.log10(p(u, x)) for u, x in zip(["\0start", *w], w, strict=False)))
    assert len(out[1008]) == 2 and katz.score_documents(docs.limit(0)).count() == 0


def brute_groups(rows, n, percent):
    sets = {}
    for i, text in rows:
        w = words(text)
        sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = list(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]) and sets[a] and sets[b]:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets.items()}


@pytest.mark.parametrize(("n", "percent"), [(3, 85), (5, 80)])
def test_near_duplicates(spark, docs, rows, n, percent):
    rng = np.random.default_rng(0)
    base = [f"w{i}" for i in range(120)]
    family = []
    for i in range(150):  # one large group whose members differ by up to 6 words
        w = list(base)
        for j in rng.choice(120, rng.integers(0, 7), replace=False):
            w[j] = f"x{i}_{j}"
        family.append((2000 + i, " ".join(w)))
    extra = spark.createDataFrame(family, "doc_id long, text string")
    some = docs.where("doc_id IS NOT NULL").select("doc_id", "text", "id", "cid").unionByName(extra, allowMissingColumns=True)
    want = brute_groups([(r.doc_id, r.text) for r in rows if r.doc_id is not None] + family, n, percent)
    out = near_dedup.near_duplicates(some, n, percent).collect()
    assert len(out) == some.count()
    for r in out:
        assert (r.n_shingles, r.component_id) == want[r.doc_id] and r.kept == (r.doc_id == r.component_id)


def test_near_duplicates_of_nothing(spark):
    assert near_dedup.near_duplicates(empty(spark)).count() == 0


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(50) if i % 10 != 9] + [(100, 100)], "a long, b long")
    found = {r.node: r.label for r in connected_components(edges).collect()}
    assert found == {i: i // 10 * 10 for i in range(50)}


def test_archive(spark):
    rows = [(1, "u", "<p>a</p>"), (2, "v\nx", "<p>a</p>"), (3, None, None), (4, "w", ""), (5, "é", "日本" * 50_000), (5, "é", "日本" * 50_000), (None, "n", "<p>a</p>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("sha256", F.lit("clash"))
    out = warc.archive(pages).collect()
    assert len(out) == 7
    for r in out:
        html = next((h or "").encode() for i, _, h in rows if i == r.page_id)
        assert (r.payload_bytes, r.payload_digest) == (len(html), base64.b32encode(hashlib.sha1(html).digest()).decode())
    assert {(r.page_id, r.record_type, r.refers_to) for r in out} == {(1, "revisit", 2), (2, "response", None), (3, "revisit", 4), (4, "response", None), (5, "response", None), (None, "revisit", 2)}
    folder = shared_dir(spark, "warc")
    whole = warc.read_archive(spark, folder, warc.write_archive(pages, folder), payloads=True).where("page_id = 5").first()
    assert bytes(whole.payload).decode() == rows[4][2] and bytes(whole.header).startswith(b"WARC/1.1\r\nWARC-Type: response")
    assert warc.archive(pages.limit(0)).count() == 0


def test_pipeline(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    kept = docs
    for name, stage in pipeline.STAGES[:4]:
        after = materialise(stage(spark, kept, DIR), name)
        assert after.columns == docs.columns
        if name != "mixing":
            assert after.join(kept, docs.columns, "left_anti").count() == 0
        if name == "near_dedup":
            groups = brute_groups([(r.doc_id, r.text) for r in kept.collect()], 5, 80)
            assert sorted(r.doc_id for r in after.collect()) == sorted({g for _, g in groups.values()})
        kept = after
    last = pipeline.STAGES[4][1](spark, kept, DIR)
    assert last.count() == kept.count() and last.where("NOT round_trip").count() == 0
