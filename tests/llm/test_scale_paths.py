"""Paths that only large inputs take: several chunks, buckets, bands and pieces of a text."""

import numpy as np
import pytest

from halyard.llm import _common, katz, mixing


def test_katz_scores_do_not_depend_on_chunks_and_buckets(spark):
    rng = np.random.default_rng(0)
    rows = [(i, " ".join(f"w{int(k)}" for k in rng.geometric(0.05, rng.integers(0, 80)))) for i in range(300)] + [(400, None), (400, "w1 w2"), (None, "w1 w3")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r.n_tokens)
    one = sorted(katz.score_documents(docs).collect(), key=key)
    many = sorted(katz.score_documents(docs, chunk_tokens=500, bucket_tokens=400).collect(), key=key)
    assert len(one) == len(many) == 303
    for a, b in zip(one, many, strict=True):
        assert a[:5] == b[:5] and a.score == pytest.approx(b.score, rel=1e-12) and a.base_score == pytest.approx(b.base_score)


def test_mixing_by_bands(spark, monkeypatch):
    text = lambda i: " ".join(f"w{k}" for k in range(1 + (i * 37) % 90))
    docs = spark.createDataFrame([(i, text(i), f"src{i % 3}") for i in range(600)], "doc_id long, text string, source string")
    monkeypatch.setattr(mixing, "BAND", 4)
    out = mixing.mix(docs, shard_docs=10).collect()
    taken, target = {}, {}
    for r in out:
        target[r.source_size] = r.target
        taken[r.source_size] = taken.get(r.source_size, 0) + r.taken
    assert all(r.taken <= 2 * r["size"] for r in out) and all(abs(taken[k] - target[k]) <= 16 * 20 for k in target)


def test_word_hashes_of_long_and_many_words(monkeypatch):
    def hashes(text, piece):
        monkeypatch.setattr(_common, "SLICE_BYTES", piece)
        data = np.frombuffer(text.encode(), np.uint8)
        starts, ends, _ = _common.word_spans(data, np.array([0, len(data)]))
        return _common.word_hashes(data, starts, ends).tolist()

    text = "One two " * 300 + "x" * 700 + " one TWO " + "Y" * 3000 + " y " + "X" * 700
    whole = hashes(text, 1 << 20)
    assert whole == hashes(text, 600) and whole[0] == whole[601] and whole[1] == whole[602] and whole[600] == whole[-1] and len(set(whole)) == 5
    # Thue-Morse words and their complements agree under any polynomial modulo 2**64.
    t = "a"
    for _ in range(12):
        t += t.translate(str.maketrans("ab", "ba"))
    a, b = hashes(t + " " + t.translate(str.maketrans("ab", "ba")), 1 << 20)
    assert a != b
