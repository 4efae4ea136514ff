"""Hierarchical language identification.

The family of a text is predicted first, by one-versus-rest linear support vector machines; one-versus-one machines
then separate the languages of that family. Features are the relative frequencies of hashed byte n-grams (2 to 4) of
the lower-cased text, with each run of what is neither letter nor combining mark, in any script, taken as one blank. All
machines are trained here, on a bounded sample of labelled documents, by dual coordinate descent.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from halyard.llm._common import SLICE_BYTES, crc_fold, release, text_buffer, text_slices, trim, whole_texts

#: The fit reads at most so many documents of a language, and so many in all: those of the smallest hashes.
TRAIN_PER_LANGUAGE, TRAIN_DOCS = 800, 4000
DIMENSIONS = 4096
NO_LANGUAGE = "und"
#: The largest value of a hash without its lowest 11 bits.
_TOP = (1 << 53) - 1
#: Families of languages by ISO 639-1 code; a language that isn't here is a family of its own.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af fy lb yi",
    "romance": "fr es it pt ro ca gl oc la",
    "slavic": "ru uk be pl cs sk bg sr hr bs sl mk",
    "baltic": "lt lv",
    "uralic": "fi et hu",
    "turkic": "tr az kk uz",
    "indic": "hi bn mr ne pa gu ur",
    "semitic": "ar he mt am",
    "malayic": "id ms",
}
_FAMILY = {code: name for name, codes in FAMILIES.items() for code in codes.split()}

_FOLD = np.zeros(256, np.uint32)
_FOLD[65:91], _FOLD[97:123] = np.arange(97, 123), np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


@lru_cache(1 << 16)
def _lower(code: int) -> int:
    """The lower-case form of a letter or combining mark by code point, 0 for all else."""
    char = chr(code)
    return ord(char.lower()[0]) if unicodedata.category(char)[0] in "LM" else 0


def folded(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts lower-cased, each run of what is neither letter nor mark as one zero byte; bytes that aren't UTF-8 are neither."""
    plain = not len(data) or data.max() < 128
    at = offsets
    if plain:
        codes = _FOLD[data]
    else:
        raw = data.tobytes()
        try:
            raw.decode()
            split = (data[offsets[:-1][np.diff(offsets) > 0]] & 0xC0 == 0x80).any()  # a character over two texts
        except UnicodeDecodeError:
            split = True
        if split:
            texts = [raw[a:b].decode("utf-8", "replace").encode() for a, b in zip(offsets.tolist(), offsets[1:].tolist(), strict=False)]
            raw, at = b"".join(texts), np.cumsum([0, *map(len, texts)])
        starts = np.frombuffer(raw, np.uint8) & 0xC0 != 0x80
        at = np.concatenate([[0], np.cumsum(starts)])[at]
        codes = np.frombuffer(raw.decode().encode("utf-32-le"), "<u4")
        table = np.zeros(max(128, int(codes.max()) + 1), np.uint32)
        table[:128] = _FOLD[:128]
        for code in np.flatnonzero(np.bincount(codes[codes > 127])).tolist():
            table[code] = _lower(code)
        codes = table[codes]
    keep = codes > 0
    keep[1:] |= codes[:-1] > 0
    keep[at[:-1][np.diff(at) > 0]] = True
    codes = codes[keep]
    at = np.concatenate([[0], np.cumsum(keep)])[at]
    if plain:
        return codes.astype(np.uint8), at
    width = 1 + (codes > 0x7F) + (codes > 0x7FF).astype(int) + (codes > 0xFFFF)
    return np.frombuffer(codes.astype("<u4").tobytes().decode("utf-32-le").encode(), np.uint8), np.concatenate([[0], np.cumsum(width)])[at]


def ngram_counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Counts of hashed n-grams, float32 of shape (texts, DIMENSIONS); of folded() texts, all n-grams count."""
    n = len(offsets) - 1
    out = np.zeros(n * DIMENSIONS)
    if not len(data):
        return out.reshape(n, DIMENSIONS).astype(np.float32)
    x = _FOLD[data]
    base = (np.repeat(np.arange(n, dtype=np.int64), np.diff(offsets)) * DIMENSIONS)
    room = np.repeat(offsets[1:], np.diff(offsets)) - np.arange(len(data))  # bytes to the text's end
    with np.errstate(over="ignore"):
        h = x * np.uint32(0x9E3779B1)
        for size in (2, 3, 4):
            if len(x) < size:
                break
            h = (h[: len(x) - size + 1] ^ x[size - 1 :]) * np.uint32(0x85EBCA6B) if size > 2 else (h[:-1] ^ x[1:]) * np.uint32(0x85EBCA6B)
            ok = (room[: len(h)] >= size) & ((x[: len(h)] | x[1 : len(h) + 1]) > 0)
            key = base[: len(h)][ok] + ((h[ok] ^ (h[ok] >> np.uint32(15))) >> np.uint32(20)).astype(np.int64)
            out += np.bincount(key, minlength=len(out))
    return out.reshape(n, DIMENSIONS).astype(np.float32)


def long_counts(data: np.ndarray, most: int = SLICE_BYTES) -> np.ndarray:
    """The counts of one text, read in pieces of at most so many bytes (4 at least); n-grams that reach over their ends count as well."""
    out, tail, first = np.zeros((1, DIMENSIONS)), np.zeros(0, np.uint8), 0
    while first < len(data):
        last = min(first + most, len(data))
        if last < len(data):  # no character is cut; where four bytes go on with one, there is none
            last -= next((k for k in range(4) if data[last - k] & 0xC0 != 0x80), 0)
        piece, _ = folded(data[first:last], np.array([0, last - first]))
        if len(tail) and not tail[-1] and not piece[0]:
            piece = piece[1:]
        own = np.concatenate([tail, piece])
        out += ngram_counts(own, np.array([0, len(own)])) - ngram_counts(tail, np.array([0, len(tail)]))
        tail, first = own[-3:], last
    return out.astype(np.float32)


def counted_slices(data: np.ndarray, offsets: np.ndarray, rows: int = 256):
    """(first, last, counts of the folded texts) over slices of bounded bytes and rows."""
    for a, b in text_slices(offsets):
        for c in range(a, b, rows):
            d = min(c + rows, b)
            own = data[offsets[c] : offsets[d]]
            yield c, d, long_counts(own) if len(own) > SLICE_BYTES else ngram_counts(*folded(own, offsets[c : d + 1] - offsets[c]))


def train_svm(x: np.ndarray, y: np.ndarray, rows: np.ndarray, rounds: int = 12, cost: float = 4.0) -> np.ndarray:
    """A linear machine of squared hinge loss over some rows of x; x has a column of ones for the bias.

    Dual coordinate descent in a seeded order; y holds the sides of those rows.
    """
    rng = np.random.default_rng(1)
    alpha, w = np.zeros(len(rows)), np.zeros(x.shape[1])
    q = np.array([x[r] @ x[r] for r in rows.tolist()]) + 0.5 / cost
    for _ in range(rounds):
        for i in rng.permutation(len(rows)).tolist():
            own = x[rows[i]].astype(float)
            g = y[i] * (own @ w) - 1 + alpha[i] * 0.5 / cost
            new = max(0.0, alpha[i] - g / q[i])
            if new != alpha[i]:
                own *= (new - alpha[i]) * y[i]
                w += own
                alpha[i] = new
    return w


@dataclass
class Model:
    """Weights over n-gram frequencies, the bias last; one row for each machine."""

    families: list[list[str]] = field(default_factory=list)
    weights: np.ndarray = field(default_factory=lambda: np.zeros((0, DIMENSIONS + 1)))
    #: Machines of the one-versus-one duels: (family, one language's place, other's place, row of weights).
    duels: list[tuple[int, int, int, int]] = field(default_factory=list)

    def predict(self, counts: np.ndarray) -> tuple[list[str], np.ndarray]:
        """The language of each row of counts, and how sure that is (0 to 1)."""
        n = len(counts)
        if not self.families:
            return [NO_LANGUAGE] * n, np.zeros(n)
        x = np.ones((n, DIMENSIONS + 1))
        x[:, :-1] = counts / np.maximum(counts.sum(1, keepdims=True), 1)
        margin = x @ self.weights.T
        sure = 1 / (1 + np.exp(np.clip(-3 * margin, -50, 50)))
        if len(self.families) > 1:
            top = margin[:, : len(self.families)].argmax(1)
            score = sure[np.arange(n), top]
        else:
            top, score = np.zeros(n, int), np.ones(n)
        place = np.zeros(n, int)
        for f, names in enumerate(self.families):
            votes, held, low = np.zeros((n, len(names))), np.zeros((n, len(names))), np.ones((n, len(names)))
            for g, a, b, row in self.duels:
                if g == f:
                    wins = margin[:, row] > 0
                    votes[:, a] += wins
                    votes[:, b] += ~wins
                    held[:, a] += margin[:, row]
                    held[:, b] -= margin[:, row]
                    low[:, a] = np.minimum(low[:, a], sure[:, row])
                    low[:, b] = np.minimum(low[:, b], 1 - sure[:, row])
            mine = np.flatnonzero(top == f)
            best = (votes + np.tanh(held / 1e3) / 4).argmax(1)[mine]  # ties of votes go to the larger sum of margins
            place[mine] = best
            score[mine] *= low[mine, best]
        return [self.families[f][i] for f, i in zip(top.tolist(), place.tolist(), strict=True)], np.clip(score, 0, 1)


def fit(x: np.ndarray, langs: list[str]) -> Model:
    """Trains all machines. x holds n-gram counts and a column of ones, as float32, and is scaled in place: there is no second matrix."""
    names = sorted(set(langs))
    groups: dict[str, list[str]] = {}
    for name in names:
        groups.setdefault(_FAMILY.get(name, name), []).append(name)
    families = [groups[k] for k in sorted(groups)]
    squares = np.zeros(DIMENSIONS)
    for own in x:
        own[:-1] /= max(own[:-1].sum(dtype=float), 1)
        squares += own[:-1].astype(float) ** 2
    scale = np.ones(DIMENSIONS + 1)
    scale[:-1] = 1 / (np.sqrt(squares / len(x)) + 1e-4) / np.sqrt(DIMENSIONS) * 4
    x *= scale.astype(np.float32)
    lang, every = np.array(langs), np.arange(len(x))
    rows, duels = [], []
    if len(families) > 1:
        for f in families:
            rows.append(train_svm(x, np.where(np.isin(lang, f), 1.0, -1.0), every) * scale)
    for g, f in enumerate(families):
        for a, b in combinations(range(len(f)), 2):
            mine = np.flatnonzero((lang == f[a]) | (lang == f[b]))
            duels.append((g, a, b, len(rows)))
            rows.append(train_svm(x, np.where(lang[mine] == f[a], 1.0, -1.0), mine) * scale)
    return Model(families, np.array(rows).reshape(-1, DIMENSIONS + 1), duels)


def _packed(counts: np.ndarray) -> bytes:
    return counts.astype("<u2" if counts.max() < 1 << 16 else "<u4").tobytes()


def _unpacked(packed: bytes) -> np.ndarray:
    return np.frombuffer(packed, "<u2" if len(packed) == 2 * DIMENSIONS else "<u4")


def _counts(batches):
    for batch in batches:
        data, offsets = text_buffer(batch.column(1))
        for a, b, counts in counted_slices(data, offsets):
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array([_packed(c) for c in counts])], ["lang", "counts"])


def _has_letter():
    return F.coalesce(F.col("text"), F.lit("")).rlike(r"\p{L}")


def train(docs: DataFrame, per_language: int = TRAIN_PER_LANGUAGE, most: int = TRAIN_DOCS) -> Model:
    """Fits the machines to documents with a language and a letter whose crc32(doc_id) mod 4 is not 2.

    The sample holds at most per_language documents of a language and `most` in all, those of the smallest hashes of
    id, language and text. Repeated rows count once; rows of one id with several texts or languages are documents of
    their own; rows without an id, a language or a letter are not learned from. Without such documents, as in an
    empty table, the model knows no language. No more than `most` feature vectors reach the driver.
    """
    own = F.xxhash64(F.col("doc_id").cast("long"), "lang", "text")
    known = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & (crc_fold("doc_id", 4) != 2) & _has_letter()).select("lang", "text", own.alias("_own"))
    # Only the smallest hashes of a language matter. A language's number of rows tells how small they are, so that few
    # rows more than needed go through the window, whatever the language's share of the table.
    sizes = known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy("lang").limit(most).collect()
    if not sizes or per_language < 1:
        return Model()
    wanted = per_language + 6 * per_language**0.5 + 50
    bounds = [(r.lang, int(min(1.0, wanted / r.n) * _TOP)) for r in sizes]
    place = Window.partitionBy("lang").orderBy("_own")
    few = known.select("lang", "_own").join(F.broadcast(docs.sparkSession.createDataFrame(bounds, "lang string, _bound long")), "lang")
    few = few.where(F.shiftrightunsigned("_own", 11) <= F.col("_bound")).select("lang", "_own").distinct()
    few = few.withColumn("_place", F.row_number().over(place)).where(F.col("_place") <= per_language).orderBy("_place", "lang").limit(most).select("_own")
    rows = known.join(F.broadcast(few), "_own", "left_semi").dropDuplicates(["_own"]).select("lang", "text").mapInArrow(_counts, "lang string, counts binary").collect()
    if not rows:
        return Model()
    rows = sorted((r.lang, bytes(r.counts)) for r in rows)  # the same order on every run
    langs = [x for x, _ in rows]
    x = np.ones((len(rows), DIMENSIONS + 1), np.float32)
    for i in range(len(rows) - 1, -1, -1):  # a row's bytes go as soon as they are in the matrix
        x[i, :-1] = _unpacked(rows.pop()[1])
    model = fit(x, langs)
    del x
    trim()
    return model


def _predictor(model: Model):
    def predict(texts: pa.Array, letters: list[bool]) -> tuple[list[str], np.ndarray]:
        data, offsets = text_buffer(texts)
        names, scores = [], []
        for _, _, counts in counted_slices(data, offsets):
            a, b = model.predict(counts)
            names += a
            scores.append(b)
        score = np.concatenate(scores) if scores else np.zeros(0)
        has = np.array(letters, bool)
        return [x if h else NO_LANGUAGE for x, h in zip(names, has.tolist(), strict=True)], np.where(has, score, 0.0)

    return predict


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred (`und` for null texts and texts without a letter), score (0 to 1), for every row of docs.

    Only the text enters the prediction; other columns are ignored.
    """
    predict = _predictor(model)

    def run(batches):
        for batch in batches:
            names, score = predict(batch.column(2), batch.column(3).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(names, pa.string()), pa.array(score)], ["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (crc_fold("doc_id", 4) == 2).alias("held_out"), F.coalesce("text", F.lit("")).alias("text"), _has_letter().alias("letter"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def keep_identified(docs: DataFrame, model: Model, least: float = 0.2) -> DataFrame:
    """The rows of docs, all columns, whose text has a language: not `und`, and a score of at least `least`.

    Null and empty texts have none and go; rows go by their own texts, so null and repeated ids change nothing and
    repeated rows share their fate. An empty table stays empty.
    """
    predict, at = _predictor(model), docs.columns.index("text")

    def run(batches):
        release()
        for batch in batches:
            names, score = predict(whole_texts(batch.column(at)), batch.column(batch.num_columns - 1).to_pylist())
            keep = (np.array(names, object) != NO_LANGUAGE) & (score >= least)
            yield pa.RecordBatch.from_arrays(batch.columns[:-1], batch.schema.names[:-1]).filter(pa.array(keep))

    return docs.select("*", _has_letter().alias("_letter")).mapInArrow(run, docs.schema)
