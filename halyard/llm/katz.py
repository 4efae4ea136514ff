"""A Katz back-off language model over words, counted and evaluated in partitioned tables.

P(w | u) is the Good-Turing discounted share of w among the tokens after u, if u w occurs in training; else it is
P(w) times a back-off weight that makes the probabilities after u sum to exactly 1; where no count after u is discounted, u is given one count more, which goes to
the back-off. P(w) is discounted in the same
way, and what its discounts free is the probability of the one unknown token. A text's score is the sum of the base-10
logarithms over its words and one end; its first token follows a start mark, and the end of a text is a token.

The corpus is cut into chunks. A chunk numbers its distinct tokens and asks for what the whole corpus knows about
them: the question goes to the buckets of the tokens' hashes, each bucket adds up all chunks' counts, and answers go
back. The same exchange, by the numbers the tokens got, follows for the distinct pairs. Questions are sorted arrays, a
row for each chunk and bucket, so what is shuffled is a few bytes for each distinct token or pair of a chunk. Very
common first words of pairs are spread over all buckets, and only they need a second sum, over the buckets.
"""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from halyard.llm._common import crc_fold, materialise, mix, text_buffer, text_slices, word_hashes, word_spans

#: Counts above this are not discounted.
TOP = 5
#: A chunk is closed at so many tokens; buckets hold about so many questions.
CHUNK_TOKENS = 2_000_000
BUCKET_TOKENS = 4_000_000
#: A first word is spread over all buckets if it makes up more than 1 / (SPREAD * buckets) of the tokens.
SPREAD = 8
END = np.uint64(0xE0D0E0D0E0D0E0D1)


def _pack(x: np.ndarray) -> bytes:
    """Numbers, compressed; integers byte by byte, so that high bytes lie together."""
    x = np.ascontiguousarray(x)
    raw = x.tobytes() if x.itemsize == 1 or x.dtype.kind == "f" else np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.itemsize).T).tobytes()
    return x.dtype.newbyteorder("<").str.encode()[1:] + zstandard.ZstdCompressor(level=1).compress(raw)


def _unpack(b: bytes) -> np.ndarray:
    kind = np.dtype("<" + b[:2].decode())
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(b[2:]), np.uint8)
    return raw.view(kind) if kind.itemsize == 1 or kind.kind == "f" else np.ascontiguousarray(raw.reshape(kind.itemsize, -1).T).view(kind).ravel()


def _narrow(x: np.ndarray) -> np.ndarray:
    """The narrowest unsigned type that holds x."""
    top = int(x.max()) if len(x) else 0
    return x.astype("<u1" if top < 256 else "<u2" if top < 65536 else "<u4" if top < 1 << 32 else "<u8")


def _deltas(x: np.ndarray) -> bytes:
    """Ascending unsigned integers."""
    return _pack(_narrow(np.diff(x, prepend=x.dtype.type(0))))


def _undelta(b: bytes) -> np.ndarray:
    return np.cumsum(_unpack(b).astype(np.uint64))


def discounts(numbers: np.ndarray) -> np.ndarray:
    """Katz discounts d[0 .. TOP] (d[0] unused) from numbers[r], how many types have count r (r up to TOP + 1).

    d[r] = (r* / r - x) / (1 - x), with r* = (r + 1) n[r + 1] / n[r] and x = (TOP + 1) n[TOP + 1] / n[1]. Where the
    counts of counts of a small corpus give no value between 0 and 1, d[r] = (r - 0.5) / r.
    """
    out = np.ones(TOP + 1)
    x = (TOP + 1) * numbers[TOP + 1] / numbers[1] if numbers[1] else 1.0
    for r in range(1, TOP + 1):
        d = ((r + 1) * numbers[r + 1] / numbers[r] / r - x) / (1 - x) if numbers[r] and x != 1 else 0.0
        out[r] = d if 0 < d < 1 else (r - 0.5) / r
    return out


def _discounted(c: np.ndarray, d: np.ndarray) -> np.ndarray:
    return c * np.where(c <= TOP, d[np.minimum(c, TOP)], 1.0)


def _tokenise(n_buckets: int, chunk_tokens: int):
    """Chunks: documents, token sequence over the chunk's own sorted vocabulary, and the questions for it."""

    def run(batches):
        held: list[tuple] = []
        n = 0

        def close():
            chunk = uuid.uuid4().int >> 65
            h = np.concatenate([x[0] for x in held])
            per = np.concatenate([x[1] for x in held])
            out = np.concatenate([x[2] for x in held])
            ids = pa.concat_arrays([x[3] for x in held])
            vocab, local = np.unique(h, return_inverse=True)
            known = np.bincount(local[np.repeat(~out, per)], minlength=len(vocab))
            bucket = (mix(vocab) % np.uint64(n_buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            cuts = np.searchsorted(bucket[order], np.arange(n_buckets + 1))
            place = np.empty(len(order), "<u4")  # a token's place among the answers, which come bucket by bucket
            place[order] = np.arange(len(order))
            rows = [(b, _deltas(vocab[order[x:y]]), _pack(_narrow(known[order[x:y]]))) for b, (x, y) in enumerate(zip(cuts, cuts[1:], strict=False)) if y > x]
            first = pa.RecordBatch.from_arrays([pa.array(["text"]), pa.array([chunk]), pa.array([0], pa.int32()), pa.array([_pack(_narrow(place[local]))]), pa.array([_pack(per.astype("<u4"))]), pa.array([_pack(out.astype("<u1"))]), pa.array([_pack(ids.fill_null(0).to_numpy(zero_copy_only=False).astype("<i8"))]), pa.array([_pack(ids.is_null().to_numpy(zero_copy_only=False).astype("<u1"))])], _COLUMNS)
            more = pa.RecordBatch.from_arrays([pa.array(["question"] * len(rows)), pa.array([chunk] * len(rows), pa.int64()), pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows]), pa.array([r[2] for r in rows]), *[pa.nulls(len(rows), pa.binary())] * 3], _COLUMNS)
            return first, more

        for batch in batches:
            data, offsets = text_buffer(batch.column(2))
            held_out = batch.column(1).to_numpy(zero_copy_only=False)
            for a, b in text_slices(offsets):
                part = data[offsets[a] : offsets[b]]
                starts, ends, per = word_spans(part, offsets[a : b + 1] - offsets[a])
                h = np.insert(word_hashes(part, starts, ends), np.cumsum(per), END)
                held.append((h, per + 1, held_out[a:b].astype(bool), batch.column(0).slice(a, b - a)))
                n += len(h)
                if n >= chunk_tokens:
                    yield from close()
                    held, n = [], 0
        if held:
            yield from close()

    return run


_COLUMNS = ["kind", "chunk", "bucket", "a", "b", "c", "d", "e"]
_SCHEMA = "kind string, chunk long, bucket int, a binary, b binary, c binary, d binary, e binary"


def _merge(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, their sums, and the place of every key asked for."""
    distinct, at = np.unique(np.concatenate(keys), return_inverse=True)
    return distinct, np.bincount(at, np.concatenate(counts).astype(float), len(distinct)).astype(np.int64), at


def _sum_tokens(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    """A bucket of tokens: for each chunk the tokens' numbers within the bucket and counts; a row of totals."""
    pdf = pdf.sort_values("chunk")
    keys, counts = [_undelta(a) for a in pdf.a], [_unpack(b) for b in pdf.b]
    distinct, total, at = _merge(keys, counts)
    ends = np.cumsum([len(k) for k in keys])
    rows = [("answer", c, key[0], _pack(_narrow(at[e - len(k) : e])), _pack(_narrow(total[at[e - len(k) : e]])), None) for c, k, e in zip(pdf.chunk, keys, ends, strict=True)]
    numbers = np.bincount(np.minimum(total, TOP + 2), minlength=TOP + 3)
    rows.append(("totals", 0, key[0], _pack(np.array([len(distinct), total.sum(), *numbers[1 : TOP + 2]], "<i8")), _deltas(distinct), _pack(_narrow(total))))
    return pd.DataFrame(rows, columns=["kind", "chunk", "bucket", "a", "b", "c"])


class Numbers:
    """What all tasks know of the unigrams: the buckets' first numbers, totals and discounts; n_buckets + 10 numbers in all."""

    def __init__(self, rows: list, n_buckets: int) -> None:
        sizes, self.total = np.zeros(n_buckets, np.int64), 0
        numbers = np.zeros(TOP + 2)
        self.distinct = 0
        for bucket, blob in rows:
            x = _unpack(blob)
            sizes[bucket] = x[0]
            self.total += int(x[1])
            numbers[1:] += x[2:]
        self.base = np.cumsum(sizes) - sizes
        self.all_types = int(sizes.sum())
        self.d = discounts(numbers)
        self.n_buckets = n_buckets
        self.unknown = 1.0
        self.numbers = numbers

    def settle(self, free: float, distinct: int) -> None:
        self.distinct = distinct
        # Where nothing is discounted, one count more is given to the unknown.
        self.over = self.total if free > 1e-9 or not self.total else self.total + 1
        self.unknown = 1.0 if not self.total else 1 - (1 - free) * self.total / self.over

    def probability(self, c: np.ndarray) -> np.ndarray:
        """Unigram probability of tokens of these counts; the unknown token's where the count is 0."""
        return np.where(c > 0, _discounted(c, self.d) / max(self.over, 1), self.unknown)


def _freed(batches_d: np.ndarray, total: int):
    """For buckets of totals: the training types and the discounted mass of each."""

    def run(pdf_iter):
        for pdf in pdf_iter:
            types, mass = [], []
            for c in pdf.c:
                c = _unpack(c).astype(np.int64)
                types.append(int((c > 0).sum()))
                mass.append(float((_discounted(c, batches_d)).sum() / max(total, 1)))
            yield pd.DataFrame({"bucket": pdf.bucket, "types": types, "mass": mass})

    return run


class Chunk:
    """A chunk with the answers about its tokens: global numbers (+1; 0 is the start mark) and counts of its sequence."""

    def __init__(self, text: pd.Series, answers: pd.DataFrame, know: Numbers) -> None:
        local, self.per = _unpack(text.a), _unpack(text.b).astype(np.int64)
        self.out = _unpack(text.c).astype(bool)
        self.ids, self.nulls = _unpack(text.d), _unpack(text.e).astype(bool)
        answers = answers.sort_values("bucket")
        number = [_unpack(a).astype(np.int64) + know.base[b] + 1 for a, b in zip(answers.a, answers.bucket, strict=True)]
        count = [_unpack(b).astype(np.int64) for b in answers.b]
        number, count = np.concatenate(number), np.concatenate(count)
        self.w, self.c = number[local], count[local]
        first = np.cumsum(self.per) - self.per
        self.u, self.cu = np.empty_like(self.w), np.empty_like(self.c)
        self.u[1:], self.cu[1:] = self.w[:-1], self.c[:-1]
        self.u[first], self.cu[first] = 0, 0
        self.first = first
        self.trained = np.repeat(~self.out, self.per)
        # Distinct pairs in the order of (u, w), through one 64-bit key where it fits.
        wide = know.all_types + 2
        if wide < 1 << 31:
            key = self.u * wide + self.w
            _, self.at, self.inverse = np.unique(key, return_index=True, return_inverse=True)
        else:
            _, self.at, self.inverse = np.unique(np.rec.fromarrays([self.u, self.w]), return_index=True, return_inverse=True)


def pair_buckets(u: np.ndarray, w: np.ndarray, cu: np.ndarray, total: int, n_buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of each pair, and whether its first word is spread over all buckets (the start mark always is)."""
    spread = (u == 0) | (cu * SPREAD * n_buckets > total)
    h = mix(u.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.where(spread, w, 0).astype(np.uint64))
    return (h % np.uint64(n_buckets)).astype(np.int64), spread


def _ask_pairs(know: Numbers):
    def run(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        chunk = Chunk(left.iloc[0], right, know)
        at = chunk.at
        u, w, cu, cw = chunk.u[at], chunk.w[at], chunk.cu[at], chunk.c[at]
        n = np.bincount(chunk.inverse[chunk.trained], minlength=len(at))
        bucket, spread = pair_buckets(u, w, cu, know.total, know.n_buckets)
        order = np.argsort(bucket, kind="stable")
        cuts = np.searchsorted(bucket[order], np.arange(know.n_buckets + 1))
        rows = []
        for b, (x, y) in enumerate(zip(cuts, cuts[1:], strict=False)):
            if y > x:
                i = order[x:y]
                rows.append((key[0], b, _deltas(u[i].astype(np.uint64)), _pack(_narrow(w[i])), _pack(_narrow(n[i])), _pack(_narrow(cw[i])), _pack(spread[i].astype("<u1"))))
        return pd.DataFrame(rows, columns=["chunk", "bucket", "u", "w", "n", "cw", "spread"])

    return run


def _sum_pairs(know: Numbers):
    """A bucket of pairs: counts for each chunk, and what a first word needs for its back-off weight."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("chunk")
        us = [_undelta(x).astype(np.int64) for x in pdf.u]
        sizes = [len(x) for x in us]
        u, w = np.concatenate(us), np.concatenate([_unpack(x).astype(np.int64) for x in pdf.w])
        n, cw, spread = (np.concatenate([_unpack(x) for x in pdf[k]]) for k in ("n", "cw", "spread"))
        wide = know.all_types + 2
        if wide < 1 << 31:
            _, first, at = np.unique(u * wide + w, return_index=True, return_inverse=True)
        else:
            pair = np.rec.fromarrays([u, w])
            _, first, at = np.unique(pair, return_index=True, return_inverse=True)
        total = np.bincount(at, n.astype(float), len(first)).astype(np.int64)
        du, dw, dc = u[first], w[first], cw[first].astype(np.int64)
        # By first word: how many pairs have count 1 .. TOP, and the unigram mass of what follows it.
        heads, head = np.unique(du, return_inverse=True)
        seen = total > 0
        stats = np.zeros((len(heads), TOP + 1))
        for r in range(1, TOP + 1):
            stats[:, r - 1] = np.bincount(head[total == r], minlength=len(heads))
        stats[:, TOP] = np.bincount(head[seen], know.probability(dc[seen]), len(heads))
        rows, ends = [], np.cumsum(sizes)
        for c, e, size in zip(pdf.chunk, ends, sizes, strict=True):
            mine = at[e - size : e]
            own_heads = np.unique(head[mine])
            rows.append(("answer", c, key[0], _pack(_narrow(total[mine])), _pack(_narrow(stats[own_heads, :TOP].T.astype(np.int64).ravel())), _pack(stats[own_heads, TOP].astype("<f8"))))
        numbers = np.bincount(np.minimum(total, TOP + 2), minlength=TOP + 3)
        spread_heads = np.unique(head[np.flatnonzero(spread[first])])
        rows.append(("totals", 0, key[0], _pack(numbers[1 : TOP + 2].astype("<i8")), _pack(heads[spread_heads].astype("<i8")), _pack(stats[spread_heads].astype("<f8"))))
        # The model's table of this bucket.
        rows.append(("table", 0, key[0], _deltas(du[seen].astype(np.uint64)), _pack(_narrow(dw[seen])), _pack(_narrow(total[seen]))))
        return pd.DataFrame(rows, columns=["kind", "chunk", "bucket", "a", "b", "c"])

    return run


def _spread_rows(pdfs):
    """(head, s): what each bucket knows of the first words that are spread over the buckets."""
    for pdf in pdfs:
        for b, c in zip(pdf.b, pdf.c, strict=True):
            heads = _unpack(b)
            yield pd.DataFrame({"head": heads, "s": list(_unpack(c).reshape(-1, TOP + 1))})


def _score(know: Numbers, d2: np.ndarray, shared: dict[int, np.ndarray], train_docs: int):
    def run(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        chunk = Chunk(left.iloc[0], right[right.kind == "token"], know)
        at = chunk.at
        u, w, cu = chunk.u[at], chunk.w[at], chunk.cu[at]
        bucket, spread = pair_buckets(u, w, cu, know.total, know.n_buckets)
        order = np.argsort(bucket, kind="stable")
        pairs = right[right.kind == "pair"].sort_values("bucket")
        count = np.empty(len(at), np.int64)
        heads, head = np.unique(u, return_inverse=True)
        kept, rest = np.empty(len(heads)), np.empty(len(heads))  # by first word
        cut = np.arange(1, TOP + 1) * (1 - d2[1:])
        context = np.zeros(len(heads), np.int64)
        context[head] = np.where(u == 0, train_docs, cu)
        done = 0
        for a, b, c in zip(pairs.a, pairs.b, pairs.c, strict=True):
            n, s, mass = _unpack(a), _unpack(b).reshape(TOP, -1), _unpack(c)
            i = order[done : done + len(n)]
            done += len(n)
            count[i] = n
            own = np.unique(head[i])
            kept[own] = context[own] - cut @ s  # discounted count of all that follows
            rest[own] = 1 - mass
        for h in np.unique(head[spread]).tolist():  # those spread over the buckets: the sums over all buckets
            s = shared[int(heads[h])]
            kept[h], rest[h] = context[h] - cut @ s[:TOP], 1 - s[TOP]
        # Where nothing after u is discounted, one count more is given to the back-off.
        over = np.maximum(np.where(context - kept > 1e-9, context, context + 1), 1)
        weight = np.where(context == 0, 1.0, (1 - kept / over) / np.maximum(rest, 1e-15))[head]
        over = over[head]
        p1 = know.probability(chunk.c[at])
        log = np.log10(np.where(count > 0, _discounted(count, d2) / over, weight * p1))[chunk.inverse]
        base = np.log10((chunk.c + 0.1) / (know.total + 0.1 * (know.distinct + 1)))
        add = lambda x: np.add.reduceat(x, chunk.first) if len(chunk.first) else np.zeros(0)
        ids = pd.array(chunk.ids, "Int64")
        ids[chunk.nulls] = pd.NA
        return pd.DataFrame({"doc_id": ids, "held_out": chunk.out, "n_tokens": chunk.per, "n_known": add((chunk.c > 0).astype(np.int64)).astype(np.int64), "train_tokens": know.total, "base_score": add(base), "score": add(log)})

    return run


def score_documents(docs: DataFrame, modulus: int = 10, held: int = 0, chunk_tokens: int = CHUNK_TOKENS, bucket_tokens: int = BUCKET_TOKENS) -> DataFrame:
    """Trains on the documents whose crc32(doc_id) mod `modulus` is not `held` and scores all of them.

    Returns one row per input row: doc_id, held_out, n_tokens (words and one end), n_known (tokens that occur in
    training), train_tokens, base_score (additive unigram), score (the model's log10 probability of the text). Null
    and empty texts are an end alone. Repeated rows count as rows. Without training documents every token is unknown
    and has probability 1. An empty table gives no rows.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (crc_fold("doc_id", modulus) == held).alias("held_out"), F.coalesce("text", F.lit("")).alias("text"))
    size = docs.select(F.sum(F.octet_length("text")), F.count(F.lit(1))).first()
    n_buckets = max(8, -(-((size[0] or 0) // 6 + size[1]) // bucket_tokens))
    chunks = materialise(rows.mapInArrow(_tokenise(n_buckets, chunk_tokens), _SCHEMA), "chunks", "kind")
    texts, questions = chunks.where("kind = 'text'"), chunks.where("kind = 'question'").select("chunk", "bucket", "a", "b")
    tokens = materialise(questions.groupBy("bucket").applyInPandas(_sum_tokens, "kind string, chunk long, bucket int, a binary, b binary, c binary"), "tokens", "kind")
    totals = tokens.where("kind = 'totals'")
    know = Numbers([(r.bucket, bytes(r.a)) for r in totals.select("bucket", "a").collect()], n_buckets)
    train_docs = rows.where(~F.col("held_out")).count()
    mass = totals.select("bucket", "c").mapInPandas(_freed(know.d, know.total), "bucket int, types long, mass double").collect()
    seen = sum(sorted(r.mass for r in mass))
    know.settle(1 - seen, sum(r.types for r in mass))

    token_answers = tokens.where("kind = 'answer'").select("chunk", "bucket", "a", "b")
    texts = texts.select("chunk", "a", "b", "c", "d", "e")
    pairs = texts.groupBy("chunk").cogroup(token_answers.groupBy("chunk")).applyInPandas(_ask_pairs(know), "chunk long, bucket int, u binary, w binary, n binary, cw binary, spread binary")
    summed = materialise(pairs.groupBy("bucket").applyInPandas(_sum_pairs(know), "kind string, chunk long, bucket int, a binary, b binary, c binary"), "pairs", "kind")
    pair_totals = summed.where("kind = 'totals'")
    numbers = np.zeros(TOP + 2)
    for r in pair_totals.select("a").collect():
        numbers[1:] += _unpack(bytes(r.a))
    # A spread word has a row in each bucket; they are added up by word before they reach the driver, which then gets at
    # most SPREAD * buckets + 1 rows. Sorted sums are the same on every run.
    whole = [F.aggregate(F.array_sort(F.collect_list(F.col("s")[i])), F.lit(0.0), lambda x, y: x + y) for i in range(TOP + 1)]
    heads = pair_totals.select("b", "c").mapInPandas(_spread_rows, "head long, s array<double>").groupBy("head").agg(F.array(*whole).alias("s"))
    shared = {r["head"]: np.array(r.s) for r in heads.collect()}
    pair_answers = summed.where("kind = 'answer'").select("chunk", "bucket", "a", "b", "c")
    answers = token_answers.withColumn("c", F.lit(None).cast("binary")).withColumn("kind", F.lit("token")).unionByName(pair_answers.withColumn("kind", F.lit("pair")))
    return texts.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInPandas(_score(know, discounts(numbers), shared, train_docs), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
