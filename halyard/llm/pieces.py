"""SentencePiece encoding and decoding with a batched numpy Viterbi.

Words of equal length advance together, a character a step. At each end, every substring that ends there is looked up
by hash among the sorted keys of the pieces, and the best last piece is kept as a backpointer.

What "best" means is the model's own rule. A BPE model has no additive score: its segmentation is the only one in
which every two neighbouring pieces are what BPE itself makes of their joint text. So the path's value is 0 if all its
neighbours agree and minus infinity if not, and just one last piece has value 0 at every end. Whether two pieces agree
is found by undoing the merges on both sides of their border, for all candidates at once. A unigram model sums scores.

Characters without a piece become their UTF-8 bytes' pieces (or the unknown piece); no piece goes across them.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from halyard.llm._common import WordCache, held_by_worker, mix, text_buffer, trim

BLANK = "▁"
_P = np.uint64(0x9E3779B97F4A7C15)
_NONE = -1
_FILTER = np.uint64((1 << 20) - 1)
#: Words that a Python worker remembers, at about 180 bytes each.
REMEMBERED = 500_000


def _codes(words: list[str]) -> np.ndarray:
    """Code points of words of one length, as a matrix."""
    n = len(words[0])
    return np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4").reshape(-1, n)


def _prefix_hashes(codes: np.ndarray) -> np.ndarray:
    values = mix(codes.astype(np.uint64) + np.uint64(0x51ED27))
    out = np.zeros((len(codes), codes.shape[1] + 1), np.uint64)
    with np.errstate(over="ignore"):
        for i in range(codes.shape[1]):
            out[:, i + 1] = out[:, i] * _P + values[:, i]
    return out


def bpe(symbols: list[str], rank: dict[str, int]) -> list[str]:
    """Plain BPE: joins the neighbours whose joint piece ranks first, the leftmost of equals, until none is a piece."""
    symbols = list(symbols)
    while len(symbols) > 1:
        best = min((rank.get(a + b, 1 << 60), i) for i, (a, b) in enumerate(zip(symbols, symbols[1:], strict=False)))
        if best[0] == 1 << 60:
            break
        symbols[best[1] : best[1] + 2] = [symbols[best[1]] + symbols[best[1] + 1]]
    return symbols


class PieceModel:
    """The pieces of a SentencePiece model file, ready for batched encoding."""

    def __init__(self, path: str, most: int = REMEMBERED) -> None:
        import sentencepiece

        own = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [own.id_to_piece(i) for i in range(own.get_piece_size())]
        normal = [i for i, p in enumerate(pieces) if not (own.is_byte(i) or own.is_control(i) or own.is_unknown(i) or own.is_unused(i))]
        scores = np.array([own.get_score(i) for i in range(len(pieces))])
        self.unigram = bool(np.any(np.diff(np.sort(-scores[normal])) % 1))  # BPE scores are whole ranks
        self.bytes = np.array([own.piece_to_id(f"<0x{b:02X}>") for b in range(256)])
        self.unknown = own.unk_id()
        self.has_bytes = all(own.is_byte(int(i)) for i in self.bytes)
        self.scores = scores
        self.longest = max((len(pieces[i]) for i in normal), default=1)
        order = sorted(normal, key=lambda i: (len(pieces[i]) > 1, -scores[i], i))
        rank = {pieces[i]: r for r, i in enumerate(order)}
        #: Everything below is by rank: single characters first, then pieces in the order of their merges.
        self.ids = np.array([*order, self.unknown], np.int64)
        self.singles = sum(len(pieces[i]) == 1 for i in normal)
        self.left, self.right = np.arange(len(order)), np.arange(len(order))
        usable = np.ones(len(order), bool)
        if not self.unigram:
            for i in order[self.singles :]:
                split = self._last_merge(pieces[i], rank)
                if split is None:
                    usable[rank[pieces[i]]] = False
                else:
                    self.left[rank[pieces[i]]], self.right[rank[pieces[i]]] = split
        made = np.flatnonzero(usable[self.singles :]) + self.singles
        key = self.left[made] * len(order) + self.right[made]
        at = np.argsort(key)
        self.pair_keys, self.pair_ranks, self.size = key[at], made[at], len(order)
        hashes, ranks = [], []
        by_length: dict[int, list[int]] = {}
        for r in np.flatnonzero(usable).tolist():
            by_length.setdefault(len(pieces[order[r]]), []).append(r)
        for rs in by_length.values():
            hashes.append(_prefix_hashes(_codes([pieces[order[r]] for r in rs]))[:, -1])
            ranks.append(np.array(rs))
        h, r = np.concatenate(hashes), np.concatenate(ranks)
        at = np.argsort(h)
        self.keys, self.ranks = h[at], r[at]
        self.filter = np.zeros(int(_FILTER) + 1, bool)  # by the low bits: most hashes that aren't there stop here
        self.filter[(h & _FILTER).astype(np.int64)] = True
        texts = [bytes([b]) if (b := self._byte_of(p, own, i)) is not None else b"" if own.is_control(i) else b" \xe2\x81\x87 " if own.is_unknown(i) else p.replace(BLANK, " ").encode() for i, p in enumerate(pieces)]
        self.text = np.frombuffer(b"".join(texts), np.uint8)
        self.text_sizes = np.array([len(x) for x in texts])
        self.text_starts = np.cumsum(self.text_sizes) - self.text_sizes
        held = {c for i in normal for c in pieces[i]}
        inner = any(BLANK in pieces[i].lstrip(BLANK) for i in normal)
        self._pattern = None if inner else re.compile(f"{BLANK}*[^{BLANK}\n]+|{BLANK}+|\n" if "\n" not in held else f"{BLANK}*[^{BLANK}]+|{BLANK}+")
        self._cache = WordCache(self.encode_words, most)

    @staticmethod
    def _byte_of(piece: str, own, i: int) -> int | None:
        return int(piece[3:5], 16) if own.is_byte(i) else None

    @staticmethod
    def _last_merge(piece: str, rank: dict[str, int]) -> tuple[int, int] | None:
        symbols = list(piece)
        while len(symbols) > 2:
            best = min((rank.get(a + b, 1 << 60), i) for i, (a, b) in enumerate(zip(symbols, symbols[1:], strict=False)))
            if best[0] == 1 << 60:
                return None
            symbols[best[1] : best[1] + 2] = [symbols[best[1]] + symbols[best[1] + 1]]
        return (rank[symbols[0]], rank[symbols[1]]) if all(s in rank for s in symbols) else None

    def agree(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether BPE leaves pieces a and b side by side as they are, by rank; an unknown character (-1) never merges."""
        out = (a == _NONE) | (b == _NONE)
        open_ = np.flatnonzero(~out)
        a, b = a[open_].copy(), b[open_].copy()
        limit = np.full(len(a), 1 << 60)
        while len(open_):
            key = a * self.size + b
            at = np.searchsorted(self.pair_keys, key)
            at[at == len(self.pair_keys)] = 0
            merged = (self.pair_keys[at] == key) & (self.pair_ranks[at] < limit) if len(self.pair_keys) else np.zeros(len(a), bool)
            # Undo the later of the two last merges; a border merge that comes before it would have happened first.
            a_whole, b_whole = a < self.singles, b < self.singles
            undo_a = ~a_whole & ((a > b) | b_whole)
            undo_b = ~b_whole & ~undo_a
            done = ~merged & a_whole & b_whole
            out[open_[done]] = True
            limit = np.where(undo_a, a, np.where(undo_b, b + 1, limit))
            a, b = np.where(undo_a, self.right[a], a), np.where(undo_b, self.left[b], b)
            go = ~merged & ~done
            open_, a, b, limit = open_[go], a[go], b[go], limit[go]
        return out

    def _viterbi(self, words: list[str]) -> list[bytes]:
        """Piece ids (uint32) of words of one length."""
        codes = _codes(words)
        n, size = codes.shape
        hashes = _prefix_hashes(codes)
        last = np.full((n, size + 1), _NONE)  # rank of the best last piece of each prefix
        back = np.zeros((n, size + 1), np.int32)
        total = np.full((n, size + 1), -np.inf)
        total[:, 0] = 0
        floor = self.scores.min() - 10
        with np.errstate(over="ignore"):
            power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(self.longest, _P)]), dtype=np.uint64)
            for end in range(1, size + 1):
                best = np.full(n, -np.inf)
                for length in range(1, min(end, self.longest) + 1):
                    start = end - length
                    h = hashes[:, end] - hashes[:, start] * power[length]
                    hit = np.flatnonzero(self.filter[(h & _FILTER).astype(np.int64)])
                    at = np.searchsorted(self.keys, h[hit])
                    at[at == len(self.keys)] = 0
                    held = self.keys[at] == h[hit]
                    hit, piece = hit[held], self.ranks[at[held]]
                    value = np.full(n, -np.inf)
                    if self.unigram:
                        value[hit] = total[hit, start] + self.scores[self.ids[piece]]
                    else:
                        value[hit] = np.where(self.agree(last[hit, start], piece), 0.0, -np.inf) if start else 0.0
                    if length == 1:  # a character without a piece
                        none = np.ones(n, bool)
                        none[hit] = False
                        value[none] = total[none, start] + floor if self.unigram else 0.0
                    ranks = np.full(n, _NONE)
                    ranks[hit] = piece
                    better = value > best
                    best = np.where(better, value, best)
                    last[:, end] = np.where(better, ranks, last[:, end])
                    back[:, end] = np.where(better, start, back[:, end])
                total[:, end] = best
        ids = self.ids[last]
        out = []
        for i in range(n):
            end, found = size, []
            row, prev, lane = ids[i].tolist(), back[i].tolist(), last[i].tolist()
            while end:
                if lane[end] == _NONE:
                    raw = words[i][end - 1].encode("utf-8", "replace")
                    found.extend(self.bytes[list(raw)][::-1].tolist() if self.has_bytes else [self.unknown])
                else:
                    found.append(row[end])
                end = prev[end]
            out.append(np.array(found[::-1], "<u4").tobytes())
        return out

    def encode_words(self, words: list[str]) -> list[bytes]:
        """The piece ids (uint32) of each word; words of one length go together."""
        by_length: dict[int, list[str]] = {}
        for w in words:
            by_length.setdefault(len(w), []).append(w)
        out: dict[str, bytes] = {}
        for size, group in by_length.items():
            step = max(1, (1 << 18) // (size + 1))
            for a in range(0, len(group), step):
                part = group[a : a + step]
                out.update(zip(part, self._viterbi(part), strict=True))
        return [out[w] for w in words]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Piece ids of each text, with the dummy blank in front; an empty text has none."""
        out = []
        for a in range(0, len(texts), 1024):
            whole = [(BLANK + t).replace(" ", BLANK) if t else "" for t in texts[a : a + 1024]]
            out += [np.frombuffer(r, "<u4") for r in self._cache.rows([self._pattern.findall(t) if self._pattern else [t] if t else [] for t in whole])]
        return out

    def decode(self, ids: list[np.ndarray]) -> list[bytes]:
        """The text of each row of ids, as UTF-8 bytes."""
        lengths = np.array([len(x) for x in ids], np.int64)
        flat = np.concatenate(ids).astype(np.int64) if len(ids) else np.zeros(0, np.int64)
        sizes = self.text_sizes[flat]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        raw = self.text[np.arange(total) + np.repeat(self.text_starts[flat] - (ends - sizes), sizes)].tobytes() if total else b""
        stops = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(lengths)])].tolist()
        return [raw[a:b][1:] if raw[a : a + 1] == b" " and b > a else raw[a:b] for a, b in zip(stops, stops[1:], strict=False)]


@held_by_worker
def _model(path: str) -> PieceModel:
    return PieceModel(path)


def encode_decode(docs: DataFrame, model: str, with_ids: bool = False) -> DataFrame:
    """Encodes every whole text and decodes the ids again.

    Returns one row per input row: doc_id, n_pieces, pieces_crc32 (of the ids as little-endian unsigned 32-bit
    integers), decoded_bytes, round_trip (the decoded text is the text), and, if asked for, pieces. Null texts are
    empty: no ids; null and repeated ids are rows of their own, and an empty table gives no rows. A text that holds the blank mark U+2581 itself decodes to blanks there, as with the library.
    """

    def run(batches):
        names = ["doc_id", "n_pieces", "pieces_crc32", "decoded_bytes", "round_trip", *["pieces"] * with_ids]
        trim()
        for batch in batches:
            data, offsets = text_buffer(batch.column(1))
            for a in range(0, batch.num_rows, 1024):
                b = min(a + 1024, batch.num_rows)
                ids = _model(model).encode(batch.column(1).slice(a, b - a).to_pylist())
                back = _model(model).decode(ids)
                raw = data[offsets[a] : offsets[b]].tobytes()
                cuts = (offsets[a : b + 1] - offsets[a]).tolist()
                columns = [batch.column(0).slice(a, b - a), pa.array([len(x) for x in ids], pa.int64()), pa.array([zlib.crc32(x.tobytes()) for x in ids], pa.int64()), pa.array([len(x) for x in back], pa.int64()), pa.array([x == raw[s:e] for x, s, e in zip(back, cuts, cuts[1:], strict=False)])]
                if with_ids:
                    at = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
                    columns.append(pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(ids).astype(np.int32) if len(ids) else np.zeros(0, np.int32))))
                yield pa.RecordBatch.from_arrays(columns, names)
            trim()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_pieces long, pieces_crc32 long, decoded_bytes long, round_trip boolean" + ", pieces array<int>" * with_ids)
