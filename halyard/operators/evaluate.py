"""Recall, timings and the throughput at a given recall."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def recall_at_k(found: DataFrame, truth: DataFrame, k: int) -> float:
    """Mean over queries of |found and true ids among the first k| / k, for (qid, rank, id) tables; 0 for no queries or k <= 0."""
    if k <= 0:
        return 0.0
    n, m = (df.select("qid").distinct().count() for df in (found, truth))
    if n != m:
        raise ValueError(f"query counts differ: {n} found, {m} true")
    return recall_table(found, truth, k).agg(F.avg("recall")).first()[0] or 0.0


def recall_table(found: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """(qid, recall) for each query of truth."""
    hits = found.where(F.col("rank") <= k).join(truth.where(F.col("rank") <= k).select("qid", "id"), ["qid", "id"], "left_semi").groupBy("qid").agg(F.count(F.lit(1)).alias("hits"))
    return truth.select("qid").distinct().join(hits, "qid", "left").select("qid", (F.coalesce("hits", F.lit(0)) / F.lit(k)).alias("recall"))


def compute_qps(queries: int, seconds: float) -> float:
    return queries / seconds if queries > 0 and seconds > 0 else 0.0


class Timer:
    """with Timer() as t: ...; t.seconds."""

    seconds = 0.0

    def __enter__(self) -> Timer:
        self._start = time.perf_counter()
        return self

    def __exit__(self, *_: object) -> None:
        self.seconds = time.perf_counter() - self._start


def run_trials(search: Callable[[], object], trials: int = 5, warmups: int = 2) -> list[float]:
    """Seconds of each trial, after warm-ups that don't count."""
    times = []
    for i in range(warmups + trials):
        with Timer() as t:
            search()
        if i >= warmups:
            times.append(t.seconds)
    return times


def summarize_timings(trials: DataFrame, queries: int) -> DataFrame:
    """One row over trials(seconds): mean, median and sample deviation, throughput, and whether the spread exceeds a fifth of the mean."""
    s = F.col("seconds")
    qps = F.when(s > 0, F.lit(float(queries)) / s).otherwise(0.0)
    return trials.agg(
        F.avg(s).alias("mean_s"), F.median(s).alias("median_s"), F.coalesce(F.stddev_samp(s), F.lit(0.0)).alias("stddev_s"),
        F.avg(qps).alias("mean_qps"), F.median(qps).alias("median_qps"), (F.coalesce(F.stddev_samp(s), F.lit(0.0)) > 0.2 * F.avg(s)).alias("high_variance"),
    )


def latency_percentiles(latencies: DataFrame) -> DataFrame:
    """p50, p95 and p99 of latencies(seconds), interpolated linearly."""
    return latencies.agg(*(F.percentile("seconds", F.lit(p / 100)).alias(f"p{p}") for p in (50, 95, 99)))


def compression_ratio(raw_bytes: int, compressed_bytes: int) -> float:
    return raw_bytes / compressed_bytes if compressed_bytes > 0 else 0.0


def iso_recall(sweep: DataFrame, target: float) -> DataFrame:
    """Throughput and parameter of sweep(param, recall, qps) at a recall: (recall, qps, param, method).

    A point within 1e-4 of the target is taken as it is; else the first two neighbours by recall around it are
    interpolated linearly; a target beyond all points gets the nearest of them. No points, no row.
    """
    order = Window.orderBy("recall", "param")  # a sweep has a handful of points
    p = sweep.select(*(F.col(c).cast("double") for c in ("recall", "qps", "param")))
    p = p.withColumn("place", F.row_number().over(order))
    for c in ("recall", "qps", "param"):
        p = p.withColumn(f"next_{c}", F.lead(c).over(order))
    near = F.abs(F.col("recall") - target) < 1e-4
    between = (F.col("recall") <= target) & (target <= F.col("next_recall")) & (F.col("next_recall") > F.col("recall"))
    share = (F.lit(target) - F.col("recall")) / (F.col("next_recall") - F.col("recall"))
    mid = lambda c: F.col(c) + share * (F.col(f"next_{c}") - F.col(c))
    first, last = F.col("place") == 1, F.col("next_recall").isNull()
    picks = F.array(
        F.when(near, F.struct(F.lit(0).alias("kind"), F.col("place"), F.col("recall"), F.col("qps"), F.col("param"), F.lit("exact").alias("method"))),
        F.when(between, F.struct(F.lit(1).alias("kind"), F.col("place"), F.lit(target).alias("recall"), mid("qps").alias("qps"), mid("param").alias("param"), F.lit("linear_interpolation").alias("method"))),
        F.when(first & (F.lit(target) < F.col("recall")), F.struct(F.lit(2).alias("kind"), F.col("place"), F.col("recall"), F.col("qps"), F.col("param"), F.lit("nearest_boundary_lower").alias("method"))),
        F.when(last, F.struct(F.lit(3).alias("kind"), F.col("place"), F.col("recall"), F.col("qps"), F.col("param"), F.lit("nearest_boundary_upper").alias("method"))),
    )
    best = p.select(F.explode(F.filter(picks, lambda x: x.isNotNull())).alias("x")).agg(F.min("x").alias("x")).where("x IS NOT NULL")
    return best.select("x.recall", "x.qps", "x.param", "x.method")


def sweep(params: list[int], search: Callable[[int], DataFrame], truth: DataFrame, k: int, queries: int) -> list[tuple[int, float, float]]:
    """(param, recall, qps) for each value of a search parameter."""
    out = []
    for p in params:
        with Timer() as t:
            found = search(p).cache()
            found.count()
        out.append((p, recall_at_k(found, truth, k), compute_qps(queries, t.seconds)))
        found.unpersist()
    return out


def save_result(row: DataFrame, path: str) -> None:
    row.coalesce(1).write.mode("append").json(path)
