"""MinHash near-duplicate detection by a signature-coordinate inverted join.

Every document is reduced to the set of its word shingles; documents with one and the same set form a class, and
only classes go on. A class is posted under each (coordinate, value) pair of its MinHash signature. Values that a
single class has can match nothing and are skipped, and so are classes with fewer shared values than a match needs.
The rest are joined on a prefix: two signatures that agree on at least t of K coordinates share one of their
K - t + 1 rarest pairs, so only those are kept as postings. Collisions are counted between list members and the
list's hub first; whatever is linked is one component and is not compared again (skip merging). Members left outside
the largest component are compared with the members of other components, in pairs of bounded blocks that spread over
tasks. Pairs of at least t equal coordinates are confirmed on full shingle sets.

t is the largest match count that a pair at exactly the similarity bound misses with probability below `miss`.
"""

from __future__ import annotations

from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from halyard.llm._common import materialise, mix, runs, text_buffer, text_slices, word_hashes, word_spans
from halyard.llm.graph import connected_components

COORDINATES = 48
MISS = 1e-6
#: Class ids are broadcast up to this many (8 MB as longs); beyond, the join shuffles.
BROADCAST_IDS = 1_000_000
#: Members of a block at most on the average; a pair of blocks is compared by one call.
BLOCK = 256
_U = np.uint64


def match_threshold(percent: int, coordinates: int = COORDINATES, miss: float = MISS) -> int:
    """The largest t with P(Binomial(coordinates, percent / 100) < t) <= miss."""
    p, below, t = percent / 100, 0.0, 0
    while t < coordinates:
        below += comb(coordinates, t) * p**t * (1 - p) ** (coordinates - t)
        if below > miss:
            break
        t += 1
    return max(1, t)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text, one after the other, and their number for each text.

    A shingle is `words` words in a row; a text of fewer words is one shingle as a whole, one without words none.
    """
    starts, ends, per = word_spans(data, offsets)
    h = word_hashes(data, starts, ends)
    with np.errstate(over="ignore"):
        first = np.concatenate([[0], np.cumsum(per)])
        n = len(h) - words + 1
        rolled = np.zeros(len(h), np.uint64)
        if n > 0:
            acc = np.zeros(n, np.uint64)
            for k in range(words):
                acc = acc * _U(0x9FB21C651E98DF25) + h[k : k + n]
            rolled[:n] = mix(acc + _U(words))
        out, counts = [], np.zeros(len(per), np.int64)
        for i, c in enumerate(per.tolist()):
            if not c:
                continue
            a = int(first[i])
            if c >= words:
                one = np.unique(rolled[a : a + c - words + 1])
            else:
                acc = np.zeros(1, np.uint64)
                for k in range(c):
                    acc = acc * _U(0x9FB21C651E98DF25) + h[a + k : a + k + 1]
                one = mix(acc + _U(c))
            counts[i] = len(one)
            out.append(one)
    return (np.concatenate(out) if out else np.zeros(0, np.uint64)), counts


def signatures(sets: np.ndarray, counts: np.ndarray, coordinates: int) -> np.ndarray:
    """MinHash signatures, uint32 of shape (texts, coordinates); rows of empty sets are 0."""
    rng = np.random.default_rng(7_919)
    flip = rng.integers(0, 2**64, coordinates, np.uint64, endpoint=False)
    odd = rng.integers(0, 2**64, coordinates, np.uint64, endpoint=False) | _U(1)
    out = np.zeros((len(counts), coordinates), np.uint32)
    full = np.flatnonzero(counts)
    if len(full):
        at = (np.cumsum(counts) - counts)[full]
        work = np.empty_like(sets)
        with np.errstate(over="ignore"):
            for k in range(coordinates):
                np.bitwise_xor(sets, flip[k], out=work)
                np.multiply(work, odd[k], out=work)
                out[full, k] = np.minimum.reduceat(work, at) >> _U(32)
    return out


def set_digests(sets: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """One 64-bit digest for each set, 0 for the empty set."""
    out = np.zeros(len(counts), np.uint64)
    full = np.flatnonzero(counts)
    if len(full):
        with np.errstate(over="ignore"):
            at = (np.cumsum(counts) - counts)[full]
            a, b = np.add.reduceat(mix(sets + _U(0x1234567)), at), np.bitwise_xor.reduceat(mix(sets ^ _U(0xABCDEF0123)), at)
            out[full] = np.maximum(mix(a * _U(0x9E3779B97F4A7C15) + mix(b + counts[full].astype(np.uint64))), _U(1))
    return out


def _sketch(words: int, coordinates: int):
    def run(batches):
        for batch in batches:
            data, offsets = text_buffer(batch.column(1))
            for a, b in text_slices(offsets):
                sets, counts = shingle_sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], words)
                sig = signatures(sets, counts, coordinates)
                width = coordinates * 4
                blob = pa.Array.from_buffers(pa.binary(), b - a, [None, pa.py_buffer((np.arange(b - a + 1) * width).astype(np.int32).tobytes()), pa.py_buffer(sig.astype("<u4").tobytes())])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(counts), pa.array(set_digests(sets, counts).view(np.int64)), blob], ["id", "n_shingles", "cid", "sig"])

    return run


def _sets(words: int):
    """(cid, shingles) of each text; the class is computed again, so no id has to tell it."""

    def run(batches):
        for batch in batches:
            data, offsets = text_buffer(batch.column(0))
            for a, b in text_slices(offsets):
                sets, counts = shingle_sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], words)
                at = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
                yield pa.RecordBatch.from_arrays([pa.array(set_digests(sets, counts).view(np.int64)), pa.ListArray.from_arrays(at, pa.array(sets.view(np.int64)))], ["cid", "shingles"])

    return run


def _explode(coordinates: int):
    """(cid, key) for each coordinate; key holds the coordinate and the value."""

    def run(batches):
        high = np.arange(coordinates, dtype=np.int64) << 32
        for batch in batches:
            data, _ = text_buffer(batch.column(1))
            sig = data.view("<u4").reshape(-1, coordinates).astype(np.int64) | high
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column(0).to_numpy(zero_copy_only=False), coordinates)), pa.array(sig.ravel())], ["cid", "key"])

    return run


def _matches(left, right, coordinates: int):
    """The number of equal coordinates of two signature columns."""

    @F.pandas_udf("int")
    def count(a, b):
        import pandas as pd

        x, y = (np.frombuffer(b"".join(s), "<u4").reshape(-1, coordinates) for s in (a, b))
        return pd.Series((x == y).sum(1, dtype=np.int32))

    return count(left, right)


def _confirm(pairs: DataFrame, classes: DataFrame, sets: DataFrame, t: int, coordinates: int, percent: int) -> DataFrame:
    """Of pairs(a, b), those with t equal coordinates and, on full sets, the similarity asked for: (a, b)."""
    sig = classes.select("cid", "sig")
    near = pairs.join(sig.toDF("a", "sig_a"), "a").join(sig.toDF("b", "sig_b"), "b")
    near = materialise(near.where(_matches(F.col("sig_a"), F.col("sig_b"), coordinates) >= t).select("a", "b"), "near")
    both = near.join(sets.toDF("a", "set_a"), "a").join(sets.toDF("b", "set_b"), "b")
    shared = F.size(F.array_intersect("set_a", "set_b"))
    return materialise(both.where(100 * shared >= percent * (F.size("set_a") + F.size("set_b") - shared)).select("a", "b"), "links")


def _collide(pdf, t: int, coordinates: int):
    """Rows of one pair of blocks as (left frame, right frame, matrix): which pairs have t equal coordinates and lie in different components."""
    left, right = (pdf[pdf.side == side].drop_duplicates("cid").sort_values("cid") for side in (0, 1))
    x, y = (np.frombuffer(b"".join(f.sig), "<u4").reshape(-1, coordinates) for f in (left, right))
    hits = np.zeros((len(x), len(y)), np.int16)
    for k in range(coordinates):
        hits += x[:, k, None] == y[None, :, k]
    return left, right, (hits >= t) & (left.comp.to_numpy()[:, None] != right.comp.to_numpy()[None, :])


def _involved(t: int, coordinates: int):
    """Of a pair of blocks, the members that some retained pair involves."""

    def run(pdf):
        left, right, hit = _collide(pdf, t, coordinates)
        out = pdf.iloc[:0]
        if hit.any():
            import pandas as pd

            out = pd.concat([left[hit.any(1)], right[hit.any(0)]])
        return out[["hub", "i", "j", "side", "cid", "comp", "sig"]]

    return run


def _overlaps(left: list[np.ndarray], right: list[np.ndarray], columns: int = 8192) -> np.ndarray:
    """Sizes of the intersections of every left with every right set, over dense incidence matrices of some columns at a time."""
    universe = np.intersect1d(np.unique(np.concatenate(left)), np.unique(np.concatenate(right)))
    out = np.zeros((len(left), len(right)), np.float32)
    sides = []
    for group in (left, right):
        flat, row = np.concatenate(group), np.repeat(np.arange(len(group)), [len(x) for x in group])
        at = np.searchsorted(universe, flat)
        at[at == len(universe)] = 0
        held = universe[at] == flat if len(universe) else np.zeros(len(flat), bool)
        order = np.argsort(at[held], kind="stable")
        sides.append((at[held][order], row[held][order]))
    for a in range(0, len(universe), columns):
        dense = []
        for (at, row), group in zip(sides, (left, right), strict=True):
            lo, hi = np.searchsorted(at, [a, a + columns])
            m = np.zeros((len(group), min(columns, len(universe) - a)), np.float32)
            m[row[lo:hi], at[lo:hi] - a] = 1
            dense.append(m)
        out += dense[0] @ dense[1].T
    return out.astype(np.int64)


def _link_blocks(t: int, coordinates: int, percent: int):
    """Of a pair of blocks, links confirmed on full sets; of links that close a circle within the blocks, one is left out."""

    def run(pdf):
        import pandas as pd

        left, right, hit = _collide(pdf, t, coordinates)
        ls, rs = [np.asarray(x) for x in left.shingles], [np.asarray(x) for x in right.shingles]
        if not hit.any():
            return pd.DataFrame({"a": np.zeros(0, np.int64), "b": np.zeros(0, np.int64)})
        if hit.sum() > 64:
            shared = _overlaps(ls, rs)
        else:
            shared = np.zeros(hit.shape, np.int64)
            for i, j in zip(*np.nonzero(hit), strict=True):
                shared[i, j] = len(np.intersect1d(ls[i], rs[j], assume_unique=True))
        total = np.array([len(x) for x in ls])[:, None] + np.array([len(x) for x in rs])[None, :]
        a, b = np.nonzero(hit & (100 * shared >= percent * (total - shared)))
        a, b = left.cid.to_numpy()[a], right.cid.to_numpy()[b]
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while (up := parent.setdefault(x, x)) != x:
                parent[x] = x = parent[up]
            return x

        kept = []
        for k, (u, v) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
            u, v = root(u), root(v)
            if u != v:
                parent[u] = v
                kept.append(k)
        return pd.DataFrame({"a": a[kept], "b": b[kept]})

    return run


def near_duplicates(docs: DataFrame, words: int = 3, percent: int = 85, coordinates: int = COORDINATES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Groups documents whose shingle sets have a Jaccard similarity of at least percent / 100.

    Returns one row per input row: id, n_shingles (distinct shingles), component_id (the smallest id of its
    component, itself included) and kept (it is that id). Links go by texts: rows of one id with several texts are
    linked each by its own, and rows without an id are linked as well (a null id comes after all others; a component
    without any id has component_id null). A null, empty or wordless text has an empty set and is
    linked with nothing, so its component is itself. Repeated rows stay rows of their own. Texts are taken whole,
    with A-Z lower-cased and words split at space and 0x09-0x0D. Other columns are ignored.
    """
    t = match_threshold(percent, coordinates)
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    sketched = materialise(source.mapInArrow(_sketch(words, coordinates), "id long, n_shingles long, cid long, sig binary"), "sketch")
    some = sketched.where("n_shingles > 0")
    # One row for each distinct set; the row with the least id stands for it.
    classes = some.groupBy("cid").agg(F.min("id").alias("id"), F.min("sig").alias("sig"))
    classes = materialise(classes, "classes")

    postings = materialise(classes.select("cid", "sig").mapInArrow(_explode(coordinates), "cid long, key long"), "postings")
    # A key or a hub may have a third of all rows. What is known of each is written before it meets the rows, so that
    # both sides of the join come from fresh exchanges and adaptive execution splits an oversized partition.
    shared = materialise(postings.groupBy("key").agg(F.count(F.lit(1)).alias("freq")).where("freq > 1"), "shared")
    held = postings.join(shared, "key").groupBy("cid").agg(F.sort_array(F.collect_list(F.struct("freq", "key"))).alias("own")).where(F.size("own") >= t)
    prefix = materialise(held.select("cid", F.explode(F.slice("own", F.lit(1), F.size("own") - t + 1)).alias("p")).select("cid", F.col("p.key").alias("key")), "prefix")

    # Full sets of the classes that can have a partner, from the documents of the ids that stand for them. Where an id
    # is null or repeated, its other texts are met as well; they go by their own class.
    owners = prefix.select("cid").distinct().join(classes.select("cid", "id"), "cid")
    owners = materialise(owners, "owners")
    few = owners.count() <= BROADCAST_IDS
    wanted, cids = owners.select(F.col("id").alias("wanted")).distinct(), owners.select("cid")
    found = source.join(F.broadcast(wanted) if few else wanted, F.col("id").eqNullSafe(F.col("wanted")), "left_semi").select("text")
    found = found.mapInArrow(_sets(words), "cid long, shingles array<long>").join(F.broadcast(cids) if few else cids, "cid", "left_semi")
    sets = materialise(found.dropDuplicates(["cid"]), "sets")

    # A list's hub is its first member in an order common to all lists. Two classes of one list meet in the group of
    # its hub, so the groups hold every candidate pair, and lists of the same hub are merged into one group.
    hubs = prefix.groupBy("key").agg(F.min_by("cid", F.xxhash64("cid")).alias("hub"), F.count(F.lit(1)).alias("n")).where("n > 1").select("key", "hub")
    hubs = materialise(hubs, "hubs")
    groups = materialise(prefix.join(hubs, "key").select("hub", "cid").distinct(), "groups")
    spokes = groups.where("hub <> cid").select(F.least("hub", "cid").alias("a"), F.greatest("hub", "cid").alias("b")).distinct()
    links = _confirm(spokes, classes, sets, t, coordinates, percent)
    labels = materialise(connected_components(links), "labels")

    # What a hub did not link: members outside the largest component of their group, against the other components.
    members = groups.join(labels.toDF("cid", "comp"), "cid", "left").withColumn("comp", F.coalesce("comp", "cid"))
    sizes = members.groupBy("hub", "comp").agg(F.count(F.lit(1)).alias("n"))
    open_groups = sizes.groupBy("hub").agg(F.sum("n").alias("m"), F.max(F.struct("n", "comp")).alias("main")).where("m > main.n")
    open_groups = open_groups.select("hub", F.col("main.comp").alias("main"), F.ceil((F.col("m") - F.col("main.n")) / BLOCK).cast("int").alias("li"), F.ceil(F.col("m") / BLOCK).cast("int").alias("lj"))
    rows = members.join(materialise(open_groups, "open"), "hub")
    block = F.xxhash64("cid", F.lit(1))
    right = rows.select("hub", F.explode(F.sequence(F.lit(0), F.col("li") - 1)).alias("i"), F.pmod(block, "lj").cast("int").alias("j"), F.lit(1).alias("side"), "cid", "comp")
    left = rows.where("comp <> main").select("hub", F.pmod(block, "li").cast("int").alias("i"), F.explode(F.sequence(F.lit(0), F.col("lj") - 1)).alias("j"), F.lit(0).alias("side"), "cid", "comp")
    blocks = left.union(right).join(classes.select("cid", "sig"), "cid").select("hub", "i", "j", "side", "cid", "comp", "sig")
    near = blocks.groupBy("hub", "i", "j").applyInPandas(_involved(t, coordinates), blocks.schema)
    near = materialise(near, "involved")
    more = near.join(sets, "cid").groupBy("hub", "i", "j").applyInPandas(_link_blocks(t, coordinates, percent), "a long, b long")
    more = materialise(more, "links")
    labels = materialise(connected_components(links.union(more)), "labels")

    named = classes.select("cid", "id").join(labels.toDF("cid", "label"), "cid", "left").withColumn("label", F.coalesce("label", "cid"))
    least = named.groupBy("label").agg(F.min("id").alias("component_id"))
    named = named.join(least, "label").select("cid", "component_id")
    out = sketched.select("id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("cid")).alias("cid")).join(named, "cid", "left")
    out = out.select("id", "n_shingles", F.coalesce("component_id", "id").alias("component_id"))
    return out.select(F.col("id").alias(id_col), "n_shingles", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
