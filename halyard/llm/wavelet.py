"""Token ids in wavelet matrices: one compressed file for each shard.

A shard's ids are stored as bit-planes over prefix codes: a frequent id has a short code, so the planes together take
about the ids' entropy. Below each plane the ids are parted stably by its bit. Codes are dealt so that ids whose code
ends with a plane come last in the parted order; the next plane is over those before them. Ones before every 512th
bit are stored beside each plane, so rank looks at one block, and `access`, `count` and `positions` read a few bytes
of each plane where they lie in the file; nothing has to be unpacked.

File: magic `HWM2`, u32 length of a JSON header, header, then for each plane its rank directory (u32 for each block)
and its bits. The header holds the number of ids, the planes' lengths and numbers of zeros, the distinct ids with
their counts (the codes follow from the counts), and the documents: ids and token counts, as compressed integers.
"""

from __future__ import annotations

import base64
import json
import re
import struct
import zlib
from bisect import bisect_right
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from halyard.llm._common import WordCache, held_by_worker, materialise, shared_dir
from halyard.llm.files import put, read_files

MAGIC = b"HWM2"
#: A file is closed at the document that brings it to so many ids.
SHARD_IDS = 4 << 20
BLOCK = 512
#: Ids parted at once, few enough for the processor's cache.
PIECE = 1 << 15
_NULL_ID = -(1 << 63)


def code_lengths(counts: np.ndarray) -> np.ndarray:
    """Lengths of an optimal prefix code; 0 where there is one symbol only."""
    m = len(counts)
    if m < 2:
        return np.zeros(m, np.int64)
    order = np.argsort(counts, kind="stable")
    weight, above = [*counts[order].tolist(), *[0] * (m - 1)], [0] * (2 * m - 1)
    leaf, inner = 0, m
    for new in range(m, 2 * m - 1):  # both the leaves and the inner nodes stand in the order of their weights
        for _ in range(2):
            if leaf < m and (inner >= new or weight[leaf] <= weight[inner]):
                least, leaf = leaf, leaf + 1
            else:
                least, inner = inner, inner + 1
            weight[new] += weight[least]
            above[least] = new
    depth = [0] * (2 * m - 1)
    for node in range(2 * m - 3, -1, -1):
        depth[node] = depth[above[node]] + 1
    out = np.empty(m, np.int64)
    out[order] = depth[:m]
    return out


class Codes:
    """The prefix code of a shard: for each symbol its length and its bits (that of plane l at place l)."""

    def __init__(self, counts: np.ndarray) -> None:
        self.lengths = code_lengths(counts)
        self.depth = int(self.lengths.max()) if len(counts) else 0
        self.bits = np.zeros(len(counts), np.uint64)
        #: For each plane the symbols that end with it, in the order in which they stand.
        self.ending: list[np.ndarray] = []
        going = np.zeros(1, np.uint64)  # beginnings of codes, in the parted order
        for level in range(self.depth):
            going = np.concatenate([going, going | np.uint64(1 << level)])
            mine = np.flatnonzero(self.lengths == level + 1)
            going, done = going[: len(going) - len(mine)], going[len(going) - len(mine) :]
            self.bits[mine] = done
            self.ending.append(mine)


def _directory(plane: np.ndarray) -> np.ndarray:
    """Ones before each block."""
    whole = np.concatenate([plane, np.zeros(-len(plane) % (BLOCK // 8), np.uint8)]).view(np.uint64)
    ones = np.bitwise_count(whole).reshape(-1, BLOCK // 64).sum(1, dtype=np.uint32)
    return (np.cumsum(ones, dtype=np.uint32) - ones).astype("<u4")


def _planes(values: np.ndarray, left: list[int]) -> Iterator[tuple[np.ndarray, int]]:
    """Packed bits and the number of zeros of each plane; left holds how many ids go on below each."""
    for level, size in enumerate(left):
        one = (values & values.dtype.type(1 << level)) != 0
        zeros = len(values) - int(np.count_nonzero(one))
        yield np.packbits(one, bitorder="little"), zeros
        if not size:
            return
        # Piece by piece, by places instead of a mask: several times as fast for random bits.
        parted, low, high = np.empty_like(values), 0, zeros
        for a in range(0, len(values), PIECE):
            v, o = values[a : a + PIECE], one[a : a + PIECE]
            x, y = np.flatnonzero(~o), np.flatnonzero(o)
            parted[low : low + len(x)], parted[high : high + len(y)] = v[x], v[y]
            low, high = low + len(x), high + len(y)
        values = parted[:size]


def _symbols(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct ids, their counts, and the place of each id among them."""
    if not len(ids) or int(ids.max()) >= 1 << 22:
        symbols, place, counts = np.unique(ids, return_inverse=True, return_counts=True)
        return symbols, counts, place
    counts = np.bincount(ids)
    symbols = np.flatnonzero(counts)
    table = np.zeros(len(counts), np.uint16 if len(symbols) <= 1 << 16 else np.uint32)
    table[symbols] = np.arange(len(symbols))
    return symbols, counts[symbols], table[ids]


def encode(ids: np.ndarray, documents: list[int | None] | None = None, lengths: np.ndarray | None = None) -> bytes:
    """One file's content."""
    symbols, counts, place = _symbols(np.asarray(ids))
    codes = Codes(counts)
    kind = np.uint16 if codes.depth <= 16 else np.uint32 if codes.depth <= 32 else np.uint64
    left = (len(place) - np.cumsum([int(counts[e].sum()) for e in codes.ending])).astype(int).tolist()
    parts, zeros = [], []
    for plane, n in _planes(codes.bits.astype(kind)[place], left):
        parts += [_directory(plane).tobytes(), plane.tobytes()]
        zeros.append(n)
    docs = np.array([_NULL_ID if d is None else d for d in documents or []], "<i8")
    text = lambda x: base64.b64encode(zlib.compress(np.asarray(x, "<i8").tobytes(), 1)).decode()
    header = json.dumps({"n": len(place), "sizes": [len(place), *left[:-1]][: codes.depth], "zeros": zeros, "symbols": text(symbols), "counts": text(counts), "docs": text(docs), "lengths": text([] if lengths is None else lengths)}).encode()
    return b"".join([MAGIC, struct.pack("<I", len(header)), header, *parts])


class WaveletMatrix:
    """Reads a file's content: token access, counting and occurrence lookup without decoding the sequence."""

    def __init__(self, blob: bytes) -> None:
        if blob[:4] != MAGIC:
            raise ValueError("not a token file")
        size = struct.unpack("<I", blob[4:8])[0]
        header = json.loads(blob[8 : 8 + size])
        number = lambda k: np.frombuffer(zlib.decompress(base64.b64decode(header[k])), "<i8")
        self.n, self.zeros, self.sizes = header["n"], header["zeros"], header["sizes"]
        self.symbols, self.counts = number("symbols"), number("counts")
        self.documents, self.lengths = [None if d == _NULL_ID else int(d) for d in number("docs")], number("lengths")
        self.codes = Codes(self.counts)
        self._ranks, self._bits, at = [], [], 8 + size
        for n in self.sizes:
            blocks, plane = -(-n // BLOCK), -(-n // 8)
            if at + 4 * blocks + plane > len(blob):
                raise ValueError("the token file is cut short")
            self._ranks.append(np.frombuffer(blob, "<u4", blocks, at))
            self._bits.append(np.frombuffer(blob, np.uint8, plane, at + 4 * blocks))
            at += 4 * blocks + plane
        if at != len(blob):
            raise ValueError("the token file is longer than its planes")

    def rank1(self, level: int, i: int) -> int:
        """Ones before bit i of a plane: its block's number in the directory, and the bits before it in the block."""
        block, bit = divmod(i, BLOCK)
        if block == len(self._ranks[level]):
            return self.sizes[level] - self.zeros[level]
        start, (whole, rest) = block * (BLOCK // 8), divmod(bit, 8)
        plane = self._bits[level]
        ones = int(self._ranks[level][block]) + int(np.bitwise_count(plane[start : start + whole]).sum())
        return ones + (int(plane[start + whole]) & ((1 << rest) - 1)).bit_count() if rest else ones

    def select(self, level: int, bit: int, k: int) -> int:
        """The place of the k-th (from 0) 0 or 1 of a plane: its block by bisection of the directory, then within the block."""
        ranks = self._ranks[level]
        before = (lambda b: int(ranks[b])) if bit else (lambda b: b * BLOCK - int(ranks[b]))
        block = bisect_right(range(len(ranks)), k, key=before) - 1
        bits = np.unpackbits(self._bits[level][block * (BLOCK // 8) : (block + 1) * (BLOCK // 8)], bitorder="little")
        return block * BLOCK + int(np.flatnonzero(bits == bit)[k - before(block)])

    def access(self, i: int) -> int:
        """The id at place i."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        for level, size in enumerate(self.sizes):
            bit = int(self._bits[level][i >> 3]) >> (i & 7) & 1
            ones = self.rank1(level, i)
            i = self.zeros[level] + ones if bit else i - ones
            left = self.sizes[level + 1] if level + 1 < len(self.sizes) else 0
            if i >= left:
                mine = self.codes.ending[level]
                return int(self.symbols[mine[np.searchsorted(np.cumsum(self.counts[mine]), i - left, "right")]])
        return int(self.symbols[0])

    def _symbol(self, token: int) -> int | None:
        s = int(np.searchsorted(self.symbols, token))
        return s if s < len(self.symbols) and self.symbols[s] == token else None

    def _range(self, s: int, end: int) -> tuple[int, int]:
        a, b, code = 0, end, int(self.codes.bits[s])
        for level in range(int(self.codes.lengths[s])):
            x, y = self.rank1(level, a), self.rank1(level, b)
            a, b = (self.zeros[level] + x, self.zeros[level] + y) if code >> level & 1 else (a - x, b - y)
        return a, b

    def count(self, token: int, end: int | None = None) -> int:
        """Occurrences of a token among the first `end` ids (all)."""
        if (s := self._symbol(token)) is None:
            return 0
        a, b = self._range(s, self.n if end is None else end)
        return b - a

    def position(self, token: int, k: int) -> int:
        """The place of a token's k-th occurrence (from 0)."""
        s = self._symbol(token)
        if s is None or not 0 <= k < self.counts[s]:
            raise IndexError(k)
        i, code = self._range(s, 0)[0] + k, int(self.codes.bits[s])
        for level in range(int(self.codes.lengths[s]) - 1, -1, -1):
            bit = code >> level & 1
            i = self.select(level, bit, i - self.zeros[level] if bit else i)
        return i

    def to_array(self) -> np.ndarray:
        """All ids, plane by plane from the lowest up."""
        kind = np.uint16 if not len(self.symbols) or self.symbols[-1] < 1 << 16 else np.uint32
        symbols = self.symbols.astype(kind)
        out = np.zeros(0, kind) if self.codes.depth else np.repeat(symbols, self.counts)
        for level in range(self.codes.depth - 1, -1, -1):
            mine, n = self.codes.ending[level], self.sizes[level]
            parted = np.concatenate([out, np.repeat(symbols[mine], self.counts[mine])]) if len(mine) else out
            one = np.unpackbits(self._bits[level], count=n, bitorder="little").view(bool)
            above, low, high = np.empty(n, kind), 0, self.zeros[level]
            for a in range(0, n, PIECE):
                o, part = one[a : a + PIECE], above[a : a + PIECE]
                x, y = np.flatnonzero(~o), np.flatnonzero(o)
                part[x], part[y] = parted[low : low + len(x)], parted[high : high + len(y)]
                low, high = low + len(x), high + len(y)
            out = above
        return out


#: str.split() also splits here, the normaliser doesn't; such texts are encoded whole.
_ODD = re.compile("[\x1c-\x1f]")


#: A chunk that the tokenizer turns into one id of its own; it parts the words of a joint call.
_MARK = "\x01"
#: Words that a Python worker remembers, at about 150 bytes each.
REMEMBERED = 1_000_000
#: Words whose lower case is that of each character alone, and that normal form C leaves as they are; their stem, which ends with a letter or digit, and the marks after it.
_PLAIN = re.compile(r"([\x21-\x7e\xc0-\xff]*[0-9A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff])([\x21-\x2f\x3a-\x40\x5b-\x60\x7b-\x7e]*)").fullmatch
#: Words of lower-case letters up to U+00FF.
_LETTERS = re.compile("[a-z\xdf-\xf6\xf8-\xff]+").fullmatch
#: How a pre-tokenizer's pattern ends that parts letters, digits and the rest.
_APART = r"[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Normalisers that change nothing in lower-case words of letters up to U+00FF.
_GENTLE = {"NFC", "Replace", "Lowercase"}
#: Byte-level pre-tokenizers write each byte as one visible character: these bytes from U+0100 on, the others as themselves.
_HIDDEN = [*range(0x21), *range(0x7F, 0xA1), 0xAD]
_AS_BYTES = np.arange(256, dtype="<u2")
_AS_BYTES[_HIDDEN] = np.arange(0x100, 0x100 + len(_HIDDEN))
_AS_BYTES[0x20] = 0x20  # parts the words here


class CachedTokenizer:
    """The tokenizers library over white-space separated chunks, each distinct chunk encoded once while it is remembered.

    For tokenizers whose normaliser turns white space into a blank and whose pre-tokenizer drops it, a text's ids are
    those of its chunks in a row. New chunks are encoded many at a time, in one text with marks between them.
    Where the tokenizer itself lower-cases, texts of characters up to U+00FF are lower-cased first; where it parts
    letters and digits from other characters, a plain chunk is taken as its stem and the marks after it. New stems of
    letters alone go through the library's model without the steps that leave them as they are, one blank between
    them: the ids that end a word tell them apart.
    """

    def __init__(self, path: str, most: int = REMEMBERED) -> None:
        import tokenizers

        self._own = tokenizers.Tokenizer.from_file(path)
        self.kind = np.dtype("<u2" if self._own.get_vocab_size() <= 1 << 16 else "<u4")
        self._mark = self._ids(_MARK)
        steps = lambda part: part.get("normalizers") or part.get("pretokenizers") or [part] if part else []
        parts = json.loads(self._own.to_str())
        normal, cut, model = steps(parts["normalizer"]), steps(parts["pre_tokenizer"]), parts["model"]
        self._lowers = any(x["type"] == "Lowercase" for x in normal)
        self._apart = bool(cut) and cut[0]["type"] == "Split" and cut[0]["pattern"].get("Regex", "").endswith(_APART)
        #: Where an added token occurs, in whatever case, nothing is lower-cased or cut before the library sees it.
        self._special = re.compile("|".join(re.escape(x["content"]) for x in parts["added_tokens"]) or "$^", re.IGNORECASE).search
        self._ends = None
        ends = model.get("end_of_word_suffix")
        byte_level = len(cut) == 2 and cut[1]["type"] == "ByteLevel" and not cut[1]["add_prefix_space"] and not cut[1]["use_regex"]
        if self._apart and byte_level and ends and self._lowers and {x["type"] for x in normal} <= _GENTLE and model["type"] == "BPE":
            self._stems = tokenizers.Tokenizer.from_str(json.dumps(parts | {"normalizer": None, "pre_tokenizer": {"type": "WhitespaceSplit"}, "post_processor": None, "added_tokens": []}))
            self._ends = np.zeros(self._own.get_vocab_size(), bool)
            self._ends[[i for t, i in model["vocab"].items() if t.endswith(ends)]] = True
        self._cache = WordCache(self._encode, most)

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self._own.encode(text, add_special_tokens=False).ids, self.kind)

    def _encode(self, words: list[str]) -> list[bytes]:
        """The ids of each word; stems and marks that are new are remembered as well, in the same bytes."""
        known, parts, plain, rest = self._cache.known, [], {}, {}
        for w in words:
            tail = ""
            if self._apart and (found := _PLAIN(w)) and not self._special(w):
                w, tail = found.groups()
                w = w.lower() if self._lowers else w
                if tail and tail not in known:
                    rest[tail] = None
            parts.append((w, tail))
            if w not in known:
                (plain if self._ends is not None and _LETTERS(w) else rest)[w] = None
        known.update(zip(plain, self._letters(list(plain)), strict=True))
        known.update(zip(rest, self._whole(list(rest)), strict=True))
        return [known[stem] + known[tail] if tail else known[stem] for stem, tail in parts]

    def _letters(self, words: list[str]) -> Iterator[bytes]:
        """The ids of lower-case words of plain letters."""
        groups = [words[a : a + 500] for a in range(0, len(words), 500)]
        texts = [_AS_BYTES[np.frombuffer(" ".join(g).encode(), np.uint8)].tobytes().decode("utf-16-le") for g in groups]
        size = self.kind.itemsize
        for part, got in zip(groups, self._stems.encode_batch_fast(texts, add_special_tokens=False), strict=True):
            joint = np.array(got.ids, self.kind)
            cuts = np.flatnonzero(self._ends[joint]) + 1
            if len(cuts) == len(part):
                raw, at = joint.tobytes(), (size * cuts).tolist()
                yield from (raw[s:e] for s, e in zip([0, *at[:-1]], at, strict=True))
            else:  # a character without an id, whose word has no end
                yield from (self._ids(w).tobytes() for w in part)

    def _whole(self, words: list[str]) -> Iterator[bytes]:
        groups = [words[a : a + 500] for a in range(0, len(words), 500)]
        size = self.kind.itemsize
        for part, got in zip(groups, self._own.encode_batch_fast([f" {_MARK} ".join(g) for g in groups], add_special_tokens=False), strict=True):
            joint = np.array(got.ids, self.kind)
            cuts = np.flatnonzero(joint == self._mark[0]) if len(self._mark) == 1 else []
            if len(cuts) == len(part) - 1:
                raw = joint.tobytes()
                yield from (raw[size * s : size * e] for s, e in zip([0, *(cuts + 1).tolist()], [*cuts.tolist(), len(joint)], strict=True))
            else:  # a word holds the mark
                yield from (self._ids(w).tobytes() for w in part)

    def _words(self, text: str) -> list[str]:
        if _ODD.search(text):
            return [text]
        if self._lowers and (text.isascii() or _narrow(text)) and not self._special(text):
            text = text.lower()  # of each character alone
        return text.split()

    def encode(self, texts: list[str], end: int) -> Iterator[np.ndarray]:
        """The ids of each text, with the end id."""
        last = np.array([end], self.kind).tobytes()
        for a in range(0, len(texts), 256):
            rows = self._cache.rows([self._words(t) for t in texts[a : a + 256]])
            yield from (np.frombuffer(r + last, self.kind) for r in rows)


def _narrow(text: str) -> bool:
    """Whether all characters are below U+0100."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


@held_by_worker
def _tokenizer(path: str) -> CachedTokenizer:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one thread for each task
    return CachedTokenizer(path)


def _writer(folder: str, path: str, end: int, shard_ids: int) -> Callable:
    def run(batches):
        held, docs, n = [], [], 0

        def close():
            blob = encode(np.concatenate(held), docs, np.array([len(x) for x in held]))
            return pa.RecordBatch.from_arrays([pa.array([put(folder, "tokens", blob)]), pa.array([_NULL_ID if docs[0] is None else docs[0]], pa.int64()), pa.array([n], pa.int64())], ["name", "first", "n"])

        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                for doc, ids in zip(part.column(0).to_pylist(), _tokenizer(path).encode(part.column(1).to_pylist(), end), strict=True):
                    held.append(ids)
                    docs.append(doc)
                    n += len(ids)
                    if n >= shard_ids:
                        yield close()
                        held, docs, n = [], [], 0
        if held:
            yield close()

    return run


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, end: int = 1, shard_ids: int = SHARD_IDS) -> DataFrame:
    """Tokenizes every text, appends the end id, and writes files in ascending doc_id order: the manifest (name, first, n, start).

    Null texts are empty: only the end id is written. Null ids come first; repeated rows are written repeatedly.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    placed = rows.repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    written = materialise(placed.mapInArrow(_writer(folder, tokenizer, end, shard_ids), "name string, first long, n long").withColumn("part", F.spark_partition_id()).withColumn("place", F.monotonically_increasing_id()), "manifest")
    # One row for each file: a running sum over them is small whatever the corpus.
    order = Window.orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    return written.withColumn("start", F.coalesce(F.sum("n").over(order), F.lit(0))).select("name", "first", "n", "start")


def _reader(batches):
    for batch in batches:
        for blob, start in zip(batch.column(1), batch.column(2).to_pylist(), strict=True):
            w = WaveletMatrix(blob.as_py())
            ids = w.to_array().astype("<u4")
            ends = np.cumsum(w.lengths)
            raw = memoryview(ids.tobytes())
            crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip((ends - w.lengths).tolist(), ends.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(w.documents, pa.int64()), pa.array(ends - w.lengths + start), pa.array(w.lengths), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])


def token_files(docs: DataFrame, tokenizer: str, end: int = 1) -> DataFrame:
    """Writes the token files of docs into the shared folder, reads them back and returns one row per document.

    Columns: doc_id, start (ids of all documents before it), n_tokens (with the end id), ids_crc32 (of its ids as
    little-endian unsigned 32-bit integers). An empty table gives no files and no rows.
    """
    spark = docs.sparkSession
    folder = shared_dir(spark, "tokens")
    manifest = write_tokens(docs, folder, tokenizer, end)
    files = read_files(spark, folder).join(manifest.select("name", "start"), "name")
    return files.mapInArrow(_reader, "doc_id long, start long, n_tokens long, ids_crc32 long")
