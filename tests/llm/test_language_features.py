"""What the language machines read of a text: every n-gram of its letters and marks, in any script and at any length."""

import unicodedata

import numpy as np
import pyarrow as pa
import pytest

from halyard.llm import language_id

TEXTS = ["One, two -- three\n\n\n4 five", "ЖИТЬ ТУТ", "Élan  « VITAL »", "a", "", " — 1 ", "नमस्ते दुनिया", "日本語、テスト", "İSTANBUL Kelvin ẞ 𝒳 😀 é", "—", "à", "— x —"]


def plain_text(text):
    out = ""
    for c in text:
        if unicodedata.category(c)[0] in "LM":
            out += c.lower()[0]
        elif not out.endswith("\0"):
            out += "\0"
    return out.encode()


def plain_counts(text):
    x, want = plain_text(text), np.zeros(language_id.DIMENSIONS)
    for size in (2, 3, 4):
        for i in range(len(x) - size + 1):
            h = x[i] * 0x9E3779B1 % 2**32
            for b in x[i + 1 : i + size]:
                h = (h ^ b) * 0x85EBCA6B % 2**32
            want[(h ^ h >> 15) >> 20] += 1
    return want


def buffer(raw):
    return np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])


def counts(raw, **own):
    return np.concatenate([c for _, _, c in language_id.counted_slices(*buffer(raw), **own)])


@pytest.mark.parametrize("rows", [1, 3, 256])
def test_every_ngram_of_the_folded_text_counts(rows):
    for text, own in zip(TEXTS, counts([t.encode() for t in TEXTS], rows=rows), strict=True):
        assert (own == plain_counts(text)).all(), text


def test_case_and_separators_change_nothing():
    for a, b in [("жить тут", "ЖИТЬ ТУТ"), ("élan vital", "ÉLAN VITAL"), ("one two", "one, two"), ("one two", "one — two"), ("one two", "one two"), ("my cat", "my\n\n\ncat")]:
        x, y = counts([a.encode(), b.encode()])
        assert x.any() and (x == y).all(), (a, b)


def test_bytes_that_are_not_utf8_are_blanks():
    raw = [b"ab\xff\xfecd", "zé".encode()[:-1], "é".encode()[1:] + b"x", "é y".encode()]
    for text, own in zip(["ab cd", "z ", " x", "é y"], counts(raw), strict=True):
        assert (own == plain_counts(text)).all(), text


@pytest.mark.parametrize("most", [4, 5, 6, 7, 64])
def test_pieces_of_a_long_text_lose_nothing(most):
    for raw in [t.encode() for t in [*TEXTS, " ".join(TEXTS)]] + ["😀𝒳".encode() + b"\x80\x80b" + "é𝒳".encode() + b"\x80" * 9 + "zü".encode()]:
        assert (language_id.long_counts(np.frombuffer(raw, np.uint8), most)[0] == plain_counts(raw.decode("utf-8", "replace"))).all(), raw


def test_long_texts_are_read_in_pieces_and_counted_whole(monkeypatch):
    own, seen = language_id.ngram_counts, []
    monkeypatch.setattr(language_id, "ngram_counts", lambda data, offsets: (seen.append(len(data)), own(data, offsets))[1])
    text, times = "Ça va, мир. ", 300_000
    got = counts([(text * times).encode()])[0]
    once, twice = plain_counts(text), plain_counts(text * 2)
    assert (got == once + (times - 1) * (twice - once)).all() and got.max() > 65535
    assert max(seen) <= language_id.SLICE_BYTES + 3
    batch = pa.RecordBatch.from_arrays([pa.array(["xx", "xx"]), pa.array([text * times, text])], ["lang", "text"])
    sent = [language_id._unpacked(c) for b in language_id._counts([batch]) for c in b.column(1).to_pylist()]
    assert (sent[0] == got).all() and (sent[1] == once).all()
