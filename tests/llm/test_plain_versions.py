"""Operators without SQL against versions written plainly."""

import re

import numpy as np
import pytest

P = pytest.importorskip("public_tokenizers")

from halyard.llm import language_id, pieces, quality_crf  # noqa: E402

TEXTS = ["Hello World one one\n\n12 ab!! x$ y.\nlast line?", "", "é À ß\n", "a", "\n\n", "No no no NO\t7 7 7", "ünïcode 日本 x" * 3, "= = =\n#a #b #b\n"]
FOLD = {b: b | 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 0 for b in range(256)}


def buffer(texts):
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])


def test_ngram_counts():
    got = language_id.ngram_counts(*buffer(TEXTS))
    for text, own in zip(TEXTS, got, strict=True):
        x, want = [FOLD[b] for b in text.encode()], np.zeros(language_id.DIMENSIONS)
        for i in range(len(x)):
            for size in (2, 3, 4):
                if i + size <= len(x) and (x[i] or x[i + 1]):
                    h = x[i] * 0x9E3779B1 % 2**32
                    for b in x[i + 1 : i + size]:
                        h = (h ^ b) * 0x85EBCA6B % 2**32
                    want[(h ^ h >> 15) >> 20] += 1
        assert (own == want).all(), text


def test_predictions_by_plain_votes():
    rng = np.random.default_rng(0)
    families = [["de", "en", "nl"], ["es", "fr"], ["fi"]]
    duels = [(0, 0, 1, 3), (0, 0, 2, 4), (0, 1, 2, 5), (1, 0, 1, 6)]
    model = language_id.Model(families, rng.normal(size=(7, language_id.DIMENSIONS + 1)), duels)
    counts = rng.poisson(0.05, (60, language_id.DIMENSIONS)).astype(float)
    names, scores = model.predict(counts)
    sure = lambda m: 1 / (1 + np.exp(-3 * m))
    for c, name, score in zip(counts, names, scores, strict=True):
        margin = model.weights @ np.append(c / max(c.sum(), 1), 1)
        f = max(range(3), key=lambda i: margin[i])
        votes, sums, low = [0] * len(families[f]), [0.0] * len(families[f]), [1.0] * len(families[f])
        for g, a, b, row in duels:
            if g == f:
                votes[a if margin[row] > 0 else b] += 1
                sums[a], sums[b] = sums[a] + margin[row], sums[b] - margin[row]
                low[a], low[b] = min(low[a], sure(margin[row])), min(low[b], 1 - sure(margin[row]))
        best = max(range(len(votes)), key=lambda i: (votes[i], sums[i]))
        assert name == families[f][best] and score == pytest.approx(sure(margin[f]) * low[best])


def plain_features(line: bytes):
    words = re.findall(rb"[^\x20\x09-\x0d]+", line)
    mark = lambda b: 33 <= b < 127 and not chr(b).isalnum() and chr(b) not in ".,'"
    letters = sum(chr(b).isalpha() if b < 128 else True for b in line)
    n, some = max(len(words), 1), max(len(line), 1)
    return [np.log1p(len(line)), np.log1p(len(words)), letters / some, sum(65 <= b <= 90 for b in line) / max(letters, 1), sum(48 <= b <= 57 for b in line) / some, sum(map(mark, line)) / some,
            len(line) / n / 10, sum(a.lower() == b.lower() for a, b in zip(words, words[1:], strict=False)) / n, sum(mark(w[-1]) for w in words) / n,
            line[-1:] in (b"!", b".", b"?"), b"A" <= line[:1] <= b"Z", not line]


def test_line_features_and_document_scores():
    f, size, per = quality_crf.line_features(*buffer(TEXTS))
    lines = [t.encode().split(b"\n") for t in TEXTS]
    assert per.tolist() == list(map(len, lines)) and size.tolist() == [len(x) for own in lines for x in own]
    assert f == pytest.approx(np.array([plain_features(x) for own in lines for x in own], float))
    rng = np.random.default_rng(1)
    chain = quality_crf.Chain(rng.normal(size=12), rng.uniform(0.5, 2, 12), rng.normal(size=37), rng.normal(size=(2, 2)))
    got = quality_crf.document_scores(chain, *buffer(TEXTS))
    for own, score in zip(lines, got, strict=True):
        x = [(np.array(plain_features(line), float) - chain.center) / chain.scale for line in own]
        none = np.zeros(12)
        e = [np.concatenate([x[i], x[i - 1] if i else none, x[i + 1] if i + 1 < len(x) else none, [1]]) @ chain.weights for i in range(len(x))]
        good, total = np.zeros(len(x)), 0.0
        for path in np.ndindex(*(2,) * len(x)):
            w = np.exp(sum(s * g for s, g in zip(e, path, strict=True)) + sum(chain.moves[a, b] for a, b in zip(path, path[1:], strict=False)))
            total, good = total + w, good + w * np.array(path)
        weight = np.array([len(line) + 1 for line in own])
        assert score == pytest.approx(float((good / total) @ weight / weight.sum()))


def test_gradient_leads_to_a_maximum():
    """No small step from what the fit ends with makes the penalised likelihood larger."""
    rng = np.random.default_rng(2)
    per, labels = np.array([3, 1, 4, 2, 5, 2]), np.array([1, 0, 1, 0, 1, 0])
    f = rng.normal(size=(per.sum(), 2)) + np.repeat(labels, per)[:, None]
    chain = quality_crf.fit(f, per, labels, rounds=4000)

    def value(weights, moves):
        e = quality_crf.with_neighbours((f - chain.center) / chain.scale, per) @ weights
        _, _, z = quality_crf.forward_backward(e, per, moves)
        ends = np.cumsum(per)
        own = np.array([y * e[b - n : b].sum() + moves[y, y] * (n - 1) for y, n, b in zip(labels, per, ends, strict=True)])
        return float(((own - z) / np.sqrt(per)).mean() - quality_crf.RIDGE / 2 * ((weights**2).sum() + (moves**2).sum()))

    best = value(chain.weights, chain.moves)
    for _ in range(40):
        a, b = rng.normal(size=chain.weights.shape) * 0.05, rng.normal(size=(2, 2)) * 0.05
        assert value(chain.weights + a, chain.moves + b) <= best + 1e-6


def test_pieces_of_null_ids_and_of_nothing(spark):
    import sentencepiece

    model = P.path("piece_bpe_32k.model")
    own = sentencepiece.SentencePieceProcessor(model_file=model)
    rows = [(None, "a b"), (None, "a b"), (None, None), (3, ""), (3, "x"), (3, "x")]
    docs = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, n_pieces string")
    out = pieces.encode_decode(docs, model, with_ids=True).collect()
    key = lambda r: str((r[0], list(r[1])))
    assert sorted(((r.doc_id, r.pieces) for r in out), key=key) == sorted(((i, own.encode(t or "")) for i, t in rows), key=key) and all(r.round_trip for r in out)
    assert pieces.encode_decode(docs.limit(0), model).count() == 0
