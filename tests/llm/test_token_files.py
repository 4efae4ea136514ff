import itertools
import random

import numpy as np
import pytest

P = pytest.importorskip("public_tokenizers")

from halyard.llm import wavelet  # noqa: E402
from halyard.llm._common import WordCache  # noqa: E402

PARTS = ["a", "B", "é", "É", "ß", "ÿ", "×", "÷", "µ", "ª", "²", "1", "9", "'", "'s", "'T", "'re", ".", ",", "&&&", "-", "<|endoftext|>", "<|ENDOFTEXT|>", "<|", "|>", " ", "  ", "\n", "\t", "\xa0", "\x85",
         "\x1c", "\x01", "\x00", "​", "İ", "ſ", "K", "日", "Σ", "ς", "ﬁ", "😀", "the", "Ligne", "(", '"', "_", "Ā", "\x7f", "\xad"]


@pytest.mark.parametrize("most", [50, 100_000])
def test_odd_texts_equal_the_library(most):
    import tokenizers

    path = P.path("word_bpe_49k.json")
    own, cached = tokenizers.Tokenizer.from_file(path), wavelet.CachedTokenizer(path, most)
    rng = random.Random(5)
    texts = ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 40))) for _ in range(5000)]
    for text, ids in zip(texts, cached.encode(texts, 1), strict=True):
        assert ids.tolist() == [*own.encode(text, add_special_tokens=False).ids, 1], repr(text)


def test_code_lengths_are_optimal():
    rng = np.random.default_rng(2)
    for m in (2, 3, 4, 5):
        counts = rng.integers(1, 30, m)
        mine = wavelet.code_lengths(counts)
        assert sum(2.0**-x for x in mine) == 1
        best = min((counts * np.array(x)).sum() for x in itertools.product(range(1, m), repeat=m) if sum(2.0**-y for y in x) <= 1) if m > 2 else counts.sum()
        assert (counts * mine).sum() == best
    assert wavelet.code_lengths(np.array([7])).tolist() == [0] and not len(wavelet.code_lengths(np.zeros(0, int)))


@pytest.mark.parametrize("top", [1, 2, 3, 300, 70_000, 1 << 23])
def test_lookups_over_skewed_ids(top):
    rng = np.random.default_rng(top)
    x = np.minimum(rng.integers(0, top, 3000), rng.geometric(0.05, 3000) ** 2)
    blob = wavelet.encode(x, [5, None], np.array([2000, 1000]))
    w = wavelet.WaveletMatrix(blob)
    assert (w.to_array() == x).all() and [w.access(i) for i in range(0, 3000, 7)] == x[::7].tolist() and w.documents == [5, None]
    for t in sorted(set(x.tolist()))[:40]:
        places = np.flatnonzero(x == t)
        assert w.count(t) == len(places) and w.count(t, 512) == (places < 512).sum() and [w.position(t, k) for k in range(len(places))] == places.tolist()
    with pytest.raises(IndexError):
        w.position(int(x[0]), 3000)
    with pytest.raises(IndexError):
        w.access(3000)
    with pytest.raises(ValueError):
        wavelet.WaveletMatrix(blob + b"x")


def test_lookups_read_single_blocks():
    x = np.random.default_rng(0).integers(0, 5000, 200_000)
    w, read = wavelet.WaveletMatrix(wavelet.encode(x)), []

    class Plane:
        def __init__(self, bits):
            self.bits = bits

        def __getitem__(self, at):
            got = self.bits[at]
            read.append(got.size)
            return got

    w._bits = [Plane(b) for b in w._bits]
    assert w.access(123_456) == x[123_456] and w.count(int(x[5])) == (x == x[5]).sum()
    assert max(read) <= wavelet.BLOCK // 8


def test_word_cache_forgets_the_late_words():
    asked = []

    def encode(words):
        asked.extend(words)
        return [w.encode() for w in words]

    cache = WordCache(encode, 4)
    assert cache.rows([["a", "b", "a"], [], ["b", "c"]]) == [b"aba", b"", b"bc"] and asked == ["a", "b", "c"]
    assert cache.rows([["d", "e", "a"]]) == [b"dea"] and cache.rows([["a", "b", "e"]]) == [b"abe"]
    assert asked == ["a", "b", "c", "d", "e", "e"]
