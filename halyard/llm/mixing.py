"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks.

1. Sources get a share of the mix by weight; a target stops at twice its source's size, and the excess is shared anew.
2. The mix is a number of blocks of BLOCK words. Blocks go to sources by highest quotients target / (2 q + 1), and a
   source's blocks go to its shards in the same way by shard size, so every shard has an integer quota.
3. A shard's documents stand in seeded order, twice over; that line is cut into blocks, and the shard takes as many
   blocks in a row as its quota says, from a seeded block on (the line is a circle). All but the documents at the two
   ends are taken whole, and none more than twice.

Word counts are the only thing read from the texts; everything after is sums over (source, shard).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from halyard.llm._common import ROW_KEY, materialise, text_buffer, text_slices, with_row_key, word_spans

BLOCK = 16
SHARD_DOCS = 2_000
#: Shards of one band.
BAND = 4_096
#: Weights of the sources in order, repeating.
WEIGHTS = (3, 1, 2)
SEED = "mix"


def _count_words(batches):
    for batch in batches:
        data, offsets = text_buffer(batch.column(batch.num_columns - 1))
        sizes = [word_spans(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])[2] for a, b in text_slices(offsets)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(np.concatenate(sizes) if sizes else np.zeros(0, np.int64))], [*batch.schema.names[:-1], "size"])


def _hash(*parts: Column) -> Column:
    """32 bits of an MD5, the same in any SQL engine."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(SEED), *parts).cast("binary")), 1, 8), 16, 10).cast("long")


def ranked(df: DataFrame, *order: Column, name: str = "rank") -> DataFrame:
    """Adds each row's place (from 0) in a total order without bringing the rows together: a range-partitioned sort, then offsets from the partitions' counts."""
    placed = materialise(df.orderBy(*order).withColumn("_id", F.monotonically_increasing_id()), "ranked")
    part = F.shiftright("_id", 33)
    counts = sorted(placed.groupBy(part.alias("p")).count().collect())  # one row for each partition of the sort
    base, offsets = 0, []
    for row in counts:
        offsets.append((row["p"], base))
        base += row["count"]
    if not offsets:
        return placed.withColumn(name, F.lit(0).cast("long")).drop("_id")
    table = placed.sparkSession.createDataFrame(offsets, "_part long, _base long")
    return placed.withColumn("_part", part).join(table, "_part").withColumn(name, F.col("_base") + F.col("_id").bitwiseAND((1 << 33) - 1)).drop("_part", "_base", "_id")


def targets(sources: DataFrame, numerator: int = 3, denominator: int = 2) -> DataFrame:
    """Adds weight and target to sources(source, source_size, ...): numerator / denominator of all words by weight, at most twice each source's size."""
    out = ranked(sources, F.col("source").isNull(), F.col("source"))
    out = out.withColumn("weight", F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("rank") % len(WEIGHTS) + 1).cast("int")))
    out = materialise(out, "sources")
    total = out.agg(F.sum("source_size")).first()[0] or 0
    exact = lambda c: c.cast("decimal(38,0)")
    capped = F.lit(False)
    before, num, den = None, 0, 1
    while True:
        held, weight = out.agg(F.sum(F.when(capped, F.col("source_size"))), F.sum(F.when(~capped, F.col("weight")))).first()
        now = (held or 0, weight or 0)
        if now == before or not now[1]:
            break
        before = now
        # Words for one unit of weight, num / den, once the capped sources have twice their size.
        num, den = numerator * total - 2 * denominator * now[0], denominator * now[1]
        capped = exact(2 * F.col("source_size")) * F.lit(den) < exact(F.col("weight")) * F.lit(num)
    share = (exact(F.col("weight")) * F.lit(num)).cast("double") / F.lit(float(den))
    return out.withColumn("target", F.when(capped, (2 * F.col("source_size")).cast("double")).otherwise(share))


def apportion(weights: np.ndarray, seats: int, limit: np.ndarray | None = None) -> np.ndarray:
    """Sainte-Lague seats for each weight, ties to the earlier; none above its limit, and what is above is dealt anew to the others."""
    weights = np.asarray(weights, float)
    if limit is not None:
        out, free = np.zeros(len(weights), np.int64), np.ones(len(weights), bool)
        while free.any():
            given = apportion(np.where(free, weights, 0), seats - int(out[~free].sum()))
            full = free & (given >= limit) & (given > 0)
            out[free] = given[free]
            if not (given[full] > limit[full]).any():
                break
            out[full], free = limit[full], free & ~full
        return out
    seats_of = np.zeros(len(weights), np.int64)
    if seats <= 0 or not weights.sum():
        return seats_of
    low, high = 0.0, 4 * weights.max()  # divisors: at high nobody has a seat
    for _ in range(200):
        mid = (low + high) / 2
        if np.floor(weights / mid + 0.5).sum() > seats:
            low = mid
        else:
            high = mid
        if high - low <= 1e-15 * high:
            break
    seats_of = np.floor(weights / high + 0.5).astype(np.int64)
    while seats_of.sum() < seats:  # those that tie at the divisor
        nxt = weights / (2 * seats_of + 1)
        for i in np.lexsort((np.arange(len(nxt)), -nxt))[: seats - int(seats_of.sum())]:
            if nxt[i] >= nxt.max() * (1 - 1e-12):
                seats_of[i] += 1
    return seats_of


def source_quotas(sources: DataFrame, seats: int) -> DataFrame:
    """Adds the quota of each source: blocks by highest quotients of the targets, ties to the source earlier in order.

    The divisor is found by sums over the table for eight candidates at a time; no list of sources reaches the driver.
    """
    top = sources.agg(F.max("target")).first()[0] or 0.0
    if not top or not seats:
        return sources.withColumn("quota", F.lit(0).cast("long"))
    seats_at = lambda d: F.floor(F.col("target") / F.lit(d) + 0.5)
    low, high = top / (2 * seats + 2), 4 * top
    given = 0
    for _ in range(30):
        grid = [low + (high - low) * i / 9 for i in range(1, 9)]
        found = [int(x or 0) for x in sources.agg(*(F.sum(seats_at(d)) for d in grid)).first()]
        if seats in found:
            high, given = grid[found.index(seats)], seats
            break
        fits = [i for i, x in enumerate(found) if x < seats]
        i = fits[0] if fits else 8
        given = found[i] if i < 8 else given
        low, high = (grid[i - 1] if i else low), (grid[i] if i < 8 else high)
        if high - low <= 1e-14 * high:
            break
    out = sources.withColumn("quota", seats_at(high).cast("long"))
    if given < seats:
        quotient = F.col("target") / (2 * F.col("quota") + 1)
        winners = out.orderBy(quotient.desc(), "rank").limit(seats - given).select("rank", F.lit(1).alias("extra"))
        out = out.join(winners, "rank", "left").withColumn("quota", F.col("quota") + F.coalesce("extra", F.lit(0))).drop("extra")
    return out


def mix(docs: DataFrame, block: int = BLOCK, shard_docs: int = SHARD_DOCS, own: tuple[str, ...] = ()) -> DataFrame:
    """What the mix takes of each document.

    Returns one row per input row: doc_id, size, source_size, target (both of its source), taken (words, repeats
    counted), and the places of its two copies in its shard's line against the window taken (copy0, copy1: start
    word and end word of the parts taken, in order). A null text has size 0 and nothing is taken of it; a null source
    is a source of its own, after all others; repeated rows count as rows. An empty table gives no rows.
    Long columns named in `own` come along and order rows of one doc_id and size.
    """
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), *own, F.coalesce("text", F.lit("")).alias("text"))
    sized = materialise(base.mapInArrow(_count_words, ", ".join(["doc_id long", "source string", *(f"{c} long" for c in own), "size long"])), "sizes")
    sources = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n")))
    sources = materialise(sources.withColumn("shards", F.ceil(F.col("n") / shard_docs)), "targets")
    total = sources.agg(F.sum("target")).first()[0] or 0.0
    sources = source_quotas(sources, int(total / block + 0.5))

    doc_key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    place = sized.join(sources.select(F.col("source").alias("s"), "rank", "source_size", "target", "shards"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    place = place.withColumn("shard", _hash(F.lit("shard"), doc_key) % F.col("shards"))
    of_shard = place.groupBy("rank", "shard").agg(F.sum("size").alias("shard_size"))
    of_shard = materialise(of_shard.withColumn("blocks", F.ceil(F.lit(2) * F.col("shard_size") / block)).withColumn("band", F.floor(F.col("shard") / BAND)), "shards")

    def deal(key: str):
        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(key, kind="stable")
            return pdf.assign(quota=apportion(pdf.shard_size.to_numpy(), int(pdf.quota.iloc[0]), pdf.blocks.to_numpy()))

        return run

    # A source's blocks go to bands of BAND shards, a band's to its shards: no call holds more than a source's bands or a band.
    bands = of_shard.groupBy("rank", "band").agg(F.sum("shard_size").alias("shard_size"), F.sum("blocks").alias("blocks")).join(sources.select("rank", "quota"), "rank")
    bands = bands.groupBy("rank").applyInPandas(deal("band"), "rank long, band long, shard_size long, blocks long, quota long").select("rank", "band", "quota")
    shards = of_shard.join(bands, ["rank", "band"]).select("rank", "band", "shard", "shard_size", "blocks", "quota")
    quotas = shards.groupBy("rank", "band").applyInPandas(deal("shard"), "rank long, band long, shard long, shard_size long, blocks long, quota long").drop("band")
    quotas = quotas.withColumn("first", _hash(F.lit("first"), F.col("rank").cast("string"), F.col("shard").cast("string")) % F.greatest("blocks", F.lit(1)))
    line = place.join(quotas, ["rank", "shard"])
    order = Window.partitionBy("rank", "shard").orderBy(_hash(F.lit("order"), doc_key), "doc_id", "size", *own).rowsBetween(Window.unboundedPreceding, 0)
    line = line.withColumn("at", F.sum("size").over(order) - F.col("size"))
    # The window on the circle: from word a to the end of its run, and what goes on at the start of the line.
    a, end, blocks = F.col("first") * block, (F.col("first") + F.col("quota")) * block, F.col("blocks") * block
    runs = ((a, F.least(end, blocks)), (F.lit(0), F.greatest(end - blocks, F.lit(0))))

    def parts(copy: int) -> Column:
        start = F.col("at") + copy * F.col("shard_size")
        found = [F.struct((F.greatest(lo, start) - start).alias("start"), (F.least(hi, start + F.col("size")) - start).alias("end")) for lo, hi in reversed(runs)]
        return F.filter(F.array(*found), lambda p: p["end"] > p["start"])

    line = line.withColumn("copy0", parts(0)).withColumn("copy1", parts(1))
    words = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda s, p: s + p["end"] - p["start"])
    return line.select("doc_id", "size", "source_size", "target", (words("copy0") + words("copy1")).alias("taken"), "copy0", "copy1", *own)


def _cut(batches):
    for batch in batches:
        at = batch.schema.get_field_index("text")
        data, offsets = text_buffer(batch.column(at))
        raw = data.tobytes()
        sizes, parts = batch.column(batch.num_columns - 2).to_pylist(), batch.column(batch.num_columns - 1).to_pylist()
        texts = []
        for i, (size, own) in enumerate(zip(sizes, parts, strict=True)):
            a, b = int(offsets[i]), int(offsets[i + 1])
            if own == [{"start": 0, "end": size}]:
                texts.append(raw[a:b].decode())
                continue
            starts = word_spans(data[a:b], np.array([0, b - a]))[0].tolist() + [b - a]
            texts.append(b"".join(raw[a + (starts[p["start"]] if p["start"] else 0) : a + starts[p["end"]]] for p in own).decode())
        columns = list(batch.columns[:-2])
        columns[at] = pa.array(texts, pa.string())
        yield pa.RecordBatch.from_arrays(columns, batch.schema.names[:-2])


def mixed_documents(docs: DataFrame, **options: int) -> DataFrame:
    """The mix itself, with the columns of docs: a row for each copy taken, with the words taken; the rest is left out.

    A copy that is taken whole keeps its text byte for byte; one at an end of a shard's window is cut between words.
    Each row goes by its own plan, also where a doc_id is null or repeated: the rows are written with a key, and those of
    one doc_id and size are ordered by their content, so reruns take the same.
    """
    names = docs.columns
    keyed = with_row_key(docs.withColumn("text", F.coalesce("text", F.lit(""))))
    plan = mix(keyed, own=ROW_KEY, **options)
    copies = plan.select("_row", F.col("size").alias("_size"), F.explode(F.array("copy0", "copy1")).alias("_parts")).where(F.size("_parts") > 0)
    rows = keyed.join(copies, "_row").select(*names, "_size", "_parts")
    return rows.mapInArrow(_cut, docs.schema)
