"""Connected components of an edge table, by label contraction on DataFrames alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from halyard.llm._common import materialise


def connected_components(edges: DataFrame) -> DataFrame:
    """Labels each node of edges(a long, b long) with the smallest node that it reaches: (node, label).

    Alternates two steps of the public large-star / small-star scheme. Each step joins every edge to the least
    neighbour of a node; that minimum is a grouped aggregate with map-side partial sums, so a hub with very many
    edges costs it one row per map task. The minima are written before they meet the edges again, so that join is one of
    two fresh exchanges, whose oversized partitions adaptive execution splits. The edge table is written to the shared folder after each round, and the
    loop ends when a round changes nothing (a fingerprint of the table, not the table, reaches the driver).
    Null or self edges are ignored; an empty table gives an empty result.
    """
    pairs = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    pairs = materialise(pairs, "edges")
    seen = None
    while True:
        # Large star: every larger neighbour of u moves to u's least neighbour.
        both = pairs.union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = materialise(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = materialise(large, "large")
        # Small star: u and its smaller neighbours move to the least of them.
        low = materialise(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(low, "u")
        pairs = materialise(small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v"))).where("u <> v").distinct(), "edges")
        mark = pairs.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == seen:
            break
        seen = tuple(mark)
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("label")).union(pairs.select(F.col("v").alias("node"), F.col("v").alias("label"))).distinct()
