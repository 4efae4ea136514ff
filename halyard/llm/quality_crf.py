"""Document quality from a linear-chain conditional random field over lines.

Each line is labelled good or bad from its own features and those of its two neighbours; transitions tie the lines of
a text together. Forward-backward marginals, weighted by line length, average into the document's quality. The chain
is fitted by maximum likelihood on a bounded sample of labelled documents, whose lines carry the document's label.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from halyard.llm._common import crc_fold, release, text_buffer, text_slices, whole_texts, word_hashes, word_spans

#: The fit reads at most so many labelled documents: those of the smallest hashes.
TRAIN_DOCS = 4000
#: And at most so many lines of a document, so that what reaches the driver is bounded (48 bytes a line).
TRAIN_LINES = 400
ROUNDS = 200
#: Weight of the squared parameters against the mean log likelihood of a document.
RIDGE = 1e-3

_CLASS = np.zeros((4, 256), np.float32)  # letters, upper case, digits, other marks
_CLASS[0, [*range(65, 91), *range(97, 123), *range(128, 256)]] = 1
_CLASS[1, 65:91] = 1
_CLASS[2, 48:58] = 1
_CLASS[3, [i for i in range(33, 127) if not chr(i).isalnum() and chr(i) not in ".,'"]] = 1
FEATURES = 12


def line_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the lines, and the number of lines of each text; an empty text has one empty line."""
    breaks = np.flatnonzero(data == 10)
    per = np.searchsorted(breaks, offsets[1:]) - np.searchsorted(breaks, offsets[:-1]) + 1
    first = np.cumsum(per) - per
    starts = np.empty(int(per.sum()), np.int64)
    ends = np.empty_like(starts)
    is_first, is_last = np.zeros(len(starts), bool), np.zeros(len(starts), bool)
    is_first[first], is_last[first + per - 1] = True, True
    starts[is_first], starts[~is_first] = offsets[:-1], breaks + 1
    ends[is_last], ends[~is_last] = offsets[1:], breaks
    return starts, ends, per


def line_features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of shape (lines, FEATURES), line lengths in bytes, and lines of each text."""
    starts, ends, per = line_spans(data, offsets)
    size = ends - starts
    some = np.maximum(size, 1).astype(float)

    def sums(values: np.ndarray) -> np.ndarray:
        run = np.zeros(len(values) + 1)
        np.cumsum(values, out=run[1:])
        return run[ends] - run[starts]

    letters, upper, digits, marks = (sums(c[data]) for c in _CLASS)
    ws, we, _ = word_spans(data, offsets)
    h = word_hashes(data, ws, we)
    lo, hi = np.searchsorted(ws, starts), np.searchsorted(ws, ends)
    words = (hi - lo).astype(float)
    same = np.zeros(len(ws) + 1)
    if len(ws):
        line = np.searchsorted(starts, ws, "right")
        same[1:] = np.cumsum(np.concatenate([[False], (h[1:] == h[:-1]) & (line[1:] == line[:-1])]))
        ragged = np.zeros(len(ws) + 1)
        tail = data[we - 1]
        ragged[1:] = np.cumsum(_CLASS[3][tail] > 0)
    else:
        ragged = np.zeros(1)
    n = np.maximum(words, 1)
    last = np.where(size > 0, data[np.maximum(ends - 1, 0)] if len(data) else 0, 0)
    first = np.where(size > 0, data[np.minimum(starts, max(len(data) - 1, 0))] if len(data) else 0, 0)
    f = np.stack([
        np.log1p(size), np.log1p(words), letters / some, upper / np.maximum(letters, 1), digits / some, marks / some,
        size / n / 10, (same[hi] - same[lo]) / n, (ragged[hi] - ragged[lo]) / n,
        np.isin(last, [33, 46, 63]), (first >= 65) & (first < 91), size == 0,
    ], 1)
    return f, size, per


@dataclass
class Chain:
    """A two-state chain: center and scale of the raw features, emission weights (own, previous, next, bias), and transition scores."""

    center: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    moves: np.ndarray

    def emissions(self, f: np.ndarray, per: np.ndarray) -> np.ndarray:
        """Score of state good over state bad, for each line."""
        return with_neighbours((f - self.center) / self.scale, per) @ self.weights


def with_neighbours(f: np.ndarray, per: np.ndarray) -> np.ndarray:
    """Own features, the previous and the next line's (0 beyond the text), and 1."""
    n = len(f)
    first = np.cumsum(per) - per
    before, after = np.zeros_like(f), np.zeros_like(f)
    before[1:], after[:-1] = f[:-1], f[1:]
    before[first], after[first + per - 1] = 0, 0
    return np.concatenate([f, before, after, np.ones((n, 1))], 1)


def forward_backward(e: np.ndarray, per: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray, np.ndarray], np.ndarray]:
    """Marginals of state good for each line; forward, backward and emission scores; log partition functions of the texts.

    All texts advance together, a line a step; texts are taken in the order of their length, so that those still
    going on are a prefix.
    """
    order = np.argsort(-per, kind="stable")
    per, first = per[order], (np.cumsum(per) - per)[order]
    score = np.stack([np.zeros_like(e), e], 1)
    alpha, beta = np.empty_like(score), np.zeros_like(score)
    steps = int(per[0]) if len(per) else 0
    live = np.searchsorted(-per, -np.arange(1, steps + 1), "right").tolist()  # texts of at least 1, 2, ... lines
    for t in range(steps):
        at = first[: live[t]] + t
        if t:
            before = alpha[at - 1]
            alpha[at] = np.logaddexp(before[:, :1] + moves[0], before[:, 1:] + moves[1]) + score[at]
        else:
            alpha[at] = score[at]
    for t in range(steps - 2, -1, -1):
        at = first[: live[t + 1]] + t
        ahead = beta[at + 1] + score[at + 1]
        beta[at] = np.logaddexp(ahead[:, :1] + moves[:, 0], ahead[:, 1:] + moves[:, 1])
    ends = first + per - 1
    z = np.empty(len(per))
    z[order] = np.logaddexp(alpha[ends, 0], alpha[ends, 1])
    both = alpha + beta
    good = 1 / (1 + np.exp(np.clip(both[:, 0] - both[:, 1], -700, 700)))
    return good, (alpha, beta, score), z


def fit(f: np.ndarray, per: np.ndarray, labels: np.ndarray, rounds: int = ROUNDS) -> Chain:
    """Maximum likelihood with a ridge, by Adam over all sample documents at once."""
    center, scale = f.mean(0), f.std(0) + 1e-6
    x = with_neighbours((f - center) / scale, per)
    y = np.repeat(labels, per).astype(float)
    text = np.repeat(np.arange(len(per)), per)
    n = len(per)
    inner = np.ones(len(f), bool)  # lines with a line after them
    inner[np.cumsum(per) - 1] = False
    at = np.flatnonzero(inner)
    theta = np.zeros(x.shape[1] + 4)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    weight = 1 / np.sqrt(per)[text]  # a long text doesn't outweigh many short ones
    for step in range(1, rounds + 1):
        moves = theta[-4:].reshape(2, 2)
        good, (alpha, beta, score), z = forward_backward(x @ theta[:-4], per, moves)
        pair = alpha[at][:, :, None] + moves[None] + (score[at + 1] + beta[at + 1])[:, None, :] - z[text[at]][:, None, None]
        own = np.zeros((len(at), 2, 2))
        own[np.arange(len(at)), y[at].astype(int), y[at].astype(int)] = 1
        grad = np.concatenate([x.T @ ((y - good) * weight) / n, (((own - np.exp(pair)) * weight[at][:, None, None]).sum(0) / n).ravel()]) - RIDGE * theta
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        theta += 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return Chain(center, scale, theta[:-4], theta[-4:].reshape(2, 2))


def document_scores(chain: Chain | float, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Quality of each text: the marginals of its lines, weighted by length + 1."""
    if not isinstance(chain, Chain):
        return np.full(len(offsets) - 1, chain)
    f, size, per = line_features(data, offsets)
    good, _, _ = forward_backward(chain.emissions(f, per), per, chain.moves)
    first = np.cumsum(per) - per
    weight = size + 1.0
    return np.clip(np.add.reduceat(good * weight, first) / np.add.reduceat(weight, first), 0, 1) if len(per) else np.zeros(0)


def _train_features(batches):
    """label, features of at most TRAIN_LINES lines of each text: those around the middle."""
    for batch in batches:
        data, offsets = text_buffer(batch.column(1))
        for a, b in text_slices(offsets):
            f, _, per = line_features(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            cuts = np.cumsum(per)[:-1]
            mine = [x[(n := max(0, len(x) - TRAIN_LINES) // 2) : n + TRAIN_LINES].astype("<f4").tobytes() for x in np.split(f, cuts)]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(mine)], ["label", "f"])


def train(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS) -> Chain | float:
    """Fits the chain to labels(doc_id, quality) of the documents whose crc32(doc_id) mod 3 is not 1.

    At most train_docs labelled ids are looked up, those of the smallest hashes, and at most train_docs texts of theirs
    are read, with at most TRAIN_LINES lines each. Repeated rows of either table count once; an id with several texts
    has them all learned; an id with both labels, or none of 0 and 1, and null ids are not learned from. Without
    labelled documents, as with an empty table, the model is the constant 0.5, with labels of one kind only that label.
    """
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & (crc_fold("doc_id", 3) != 1))
    known = known.groupBy(F.col("doc_id").cast("long").alias("_id")).agg(F.min("quality").cast("int").alias("label"), F.max("quality").alias("_other")).where("label = _other")
    some = known.orderBy(F.xxhash64("_id"), "_id").limit(train_docs).select("_id", "label")
    texts = docs.select(F.col("doc_id").cast("long").alias("_id"), F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(some), "_id")
    texts = texts.withColumn("_own", F.xxhash64("_id", "text"))
    few = texts.select("_own").distinct().orderBy("_own").limit(train_docs)
    rows = texts.join(F.broadcast(few), "_own", "left_semi").dropDuplicates(["_own"]).select("label", "text").mapInArrow(_train_features, "label int, f binary").collect()
    if not rows:
        return 0.5
    label = np.array([r.label for r in rows])
    if label.min() == label.max():
        return float(label[0])
    parts = sorted(zip((bytes(r.f) for r in rows), label.tolist(), strict=True))  # the same order on every run
    each = [np.frombuffer(b, "<f4").reshape(-1, FEATURES).astype(float) for b, _ in parts]
    return fit(np.concatenate(each), np.array([len(x) for x in each]), np.array([y for _, y in parts]))


def score_quality(docs: DataFrame, chain: Chain | float) -> DataFrame:
    """doc_id, held_out, score (0 to 1, higher: better), predicted (1 from 0.5 on), for every row of docs.

    Null and empty texts count as one empty line. Only the text enters the score; other columns are ignored.
    """

    def run(batches):
        for batch in batches:
            data, offsets = text_buffer(batch.column(2))
            out = [document_scores(chain, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]) for a, b in text_slices(offsets)]
            score = np.concatenate(out) if out else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), (crc_fold("doc_id", 3) == 1).alias("held_out"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, chain: Chain | float) -> DataFrame:
    """The rows of docs, all columns, whose text scores 0.5 or more.

    Null and empty texts count as one empty line. Rows go by their own texts, so null and repeated ids change nothing
    and repeated rows share their fate. An empty table stays empty.
    """
    at = docs.columns.index("text")

    def run(batches):
        release()
        for batch in batches:
            data, offsets = text_buffer(whole_texts(batch.column(at)))
            keep = [document_scores(chain, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]) >= 0.5 for a, b in text_slices(offsets)]
            yield batch.filter(pa.array(np.concatenate(keep) if keep else np.zeros(0, bool)))

    return docs.mapInArrow(run, docs.schema)
