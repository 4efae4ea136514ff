"""Helpers that the operators of this subpackage share: the shared folder, Arrow text buffers and word hashes."""

from __future__ import annotations

import ctypes
import hashlib
import tempfile
import uuid
from collections.abc import Callable, Iterable
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Word separators of the contracts: space and the ASCII controls 0x09-0x0D.
SEPARATORS = bytes([0x20, *range(0x09, 0x0E)])
WORD_REGEX = r"[^\x20\x09-\x0D]+"
#: Text handled at once by the numpy kernels; bounds their temporary arrays.
SLICE_BYTES = 1 << 20
#: From this length on words are hashed one by one; shorter ones can't hold colliding patterns.
LONG_WORD = 512


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder name below the folder that driver and executors share (spark.checkpoint.dir).

    Where that setting is unset (tests on one machine), a temporary folder is set as checkpoint folder first; on a
    cluster that is an error, since executors would write to disks of their own.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        if found.isEmpty():
            if not spark.sparkContext.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
            root = "file://" + tempfile.mkdtemp(prefix="halyard-")
            spark.sparkContext.setCheckpointDir(root)
        else:
            root = found.get()
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
    """Writes df as Parquet into the shared folder and reads it back: the lineage ends here."""
    spark = df.sparkSession
    path = shared_dir(spark, name)
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: A hash of the whole row, and a number that no other row of the written table has.
ROW_KEY = ("_mark", "_row")


def with_row_key(df: DataFrame) -> DataFrame:
    """Writes df with the columns of ROW_KEY, which stay the same for all that reads the result."""
    return materialise(df.withColumns({"_mark": F.xxhash64(*df.columns), "_row": F.monotonically_increasing_id()}), "keyed")


def crc_fold(column: str, modulus: int):
    """crc32 of the id as text, modulo modulus; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % modulus


def text_buffer(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of an Arrow string array without nulls, and len + 1 offsets into them; no copy is made."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    wide = pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type)
    _, offsets, data = array.buffers()
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[array.offset : array.offset + len(array) + 1].astype(np.int64) if offsets is not None and len(array) else np.zeros(len(array) + 1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def text_slices(offsets: np.ndarray, most: int = SLICE_BYTES):
    """Ranges of rows of at most so many bytes each; a single longer row makes a range of its own."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1)
        yield first, last
        first = last


_IS_SEP = np.zeros(256, bool)
_IS_SEP[list(SEPARATORS)] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_P = 0x9E3779B97F4A7C15
_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> _U(32))
    x = x * _U(0xD6E8FEB86659FD93)
    x ^= x >> _U(32)
    x *= _U(0xD6E8FEB86659FD93)
    x ^= x >> _U(32)
    return x


@lru_cache(1)
def _byte_values() -> np.ndarray:
    return np.random.default_rng(20240229).integers(0, 2**64, 256, np.uint64, endpoint=False)


@lru_cache(2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = pow(_P, -1, 1 << 64)
    with np.errstate(over="ignore"):
        up = np.concatenate([[_U(1)], np.cumprod(np.full(n, _P, np.uint64))])
        down = np.concatenate([[_U(1)], np.cumprod(np.full(n, inverse, np.uint64))])
    return up, down


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of the texts, and the number of words of each text."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets) - 1, np.int64)
    inside = ~_IS_SEP[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = np.empty(n, bool)
    before[0], before[1:] = True, ~inside[:-1]
    starts = np.flatnonzero(inside & (before | edge[:-1]))
    after = np.empty(n, bool)
    after[-1], after[:-1] = True, ~inside[1:]
    ends = np.flatnonzero(inside & (after | edge[1:])) + 1
    at = np.searchsorted(starts, offsets)
    return starts, ends, np.diff(at)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    """64-bit hashes of the words data[start:end], A-Z lower-cased if asked.

    A word's hash is its polynomial value over random byte values modulo 2**64, read off a running sum over a bounded
    piece of the text and then finalised together with its length; equal words have equal hashes wherever they stand.
    Words of LONG_WORD bytes and more, for which such polynomials can be made to collide, have a BLAKE2 digest.
    """
    size, out = ends - starts, np.zeros(len(starts), np.uint64)
    values = _byte_values()
    values = values[_LOWER] if lower else values
    short = np.flatnonzero(size < LONG_WORD)
    s, e = (starts, ends) if len(short) == len(starts) else (starts[short], ends[short])
    own, first = (out if s is starts else np.zeros(len(short), np.uint64)), 0
    with np.errstate(over="ignore"):
        while first < len(s):
            last = int(np.searchsorted(e, s[first] + SLICE_BYTES, "right"))
            a, b = int(s[first]), int(e[last - 1])
            up, down = _powers(1 << max(16, (b - a).bit_length()))
            run = np.zeros(b - a + 1, np.uint64)
            np.cumsum(values[data[a:b]] * up[: b - a], out=run[1:])
            own[first:last] = (run[e[first:last] - a] - run[s[first:last] - a]) * down[s[first:last] - a]
            first = last
        if own is not out:
            out[short] = own
        out = mix(out + size.astype(np.uint64) * _U(0xA0761D6478BD642F))
    for i in np.flatnonzero(size >= LONG_WORD).tolist():
        word = data[starts[i] : ends[i]]
        out[i] = int.from_bytes(hashlib.blake2b((_LOWER[word] if lower else word).tobytes(), digest_size=8).digest(), "little")
    return out


def trim() -> None:
    """Gives back memory that this Python worker holds from earlier work but doesn't use; workers live on from task to task."""
    _powers.cache_clear()
    pa.default_memory_pool().release_unused()
    give_back = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if give_back is not None:
        give_back(0)


_HELD: list = []


def held_by_worker(load: Callable) -> Callable:
    """Keeps the last result of load in this Python worker, for later tasks of the same operator, until release()."""
    kept = lru_cache(1)(load)
    _HELD.append(kept)
    return kept


def release() -> None:
    """Drops what other operators hold in this worker, such as word tables, and gives the memory back."""
    for kept in _HELD:
        kept.cache_clear()
    trim()


def whole_texts(column: pa.Array) -> pa.Array:
    """A text column of a batch with nulls as empty texts; a column without nulls is not copied."""
    return column.fill_null("") if column.null_count else column


def runs(lengths: np.ndarray) -> np.ndarray:
    """0 .. length - 1 for each length, one after the other."""
    ends = np.cumsum(lengths)
    return np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - lengths, lengths)


class _Known(dict):
    """Codes of words; a word that isn't there is noted, each time it is asked for, and has the code None."""

    def __init__(self) -> None:
        self.missed: list[str] = []

    def __missing__(self, word: str) -> None:
        self.missed.append(word)


class WordCache:
    """Remembers the encoded bytes of words; each distinct word is encoded once while it is remembered.

    When full, the words that came last are forgotten: those that came first are the common ones. A batch's own words
    are all remembered while it is put together.
    """

    def __init__(self, encode: Callable[[list[str]], Iterable[bytes]], most: int) -> None:
        self._encode, self._most, self.known = encode, most, _Known()

    def rows(self, words: list[list[str]]) -> list[bytes]:
        """For each list of words the joined bytes of their codes."""
        known, join = self.known, b"".join
        code, missed, out, late = known.__getitem__, known.missed, [], []
        for w in words:
            before = len(missed)
            codes = list(map(code, w))
            if len(missed) > before:
                late.append(len(out))
                out.append(codes)
            else:
                out.append(join(codes))
        if missed:
            fresh = list(dict.fromkeys(missed))
            missed.clear()
            found = dict(zip(fresh, self._encode(fresh), strict=True))
            for i in late:
                out[i] = join([found[w] if c is None else c for w, c in zip(words[i], out[i], strict=True)])
            known.update(found)
            if len(known) > self._most:
                for x in list(known)[self._most // 2 :]:
                    del known[x]
        return out
