"""The engine's own queries over the driver tables, and DuckDB SQL with the same rows.

Vectors are scaled by row (1 + id % 7), because rows of length 1 rank alike under every metric. Scores are rounded to
6 digits on output only; order and ties are settled on the full values.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from halyard.functions import vector as V
from halyard.operators import evaluate as E
from halyard.operators import topk as T
from halyard.operators.collection import FlatCollection, latest_points
from halyard.operators.hnsw import HnswConfig, HnswIndex, layer_column
from halyard.operators.ivf import IVFIndex, probe_table
from halyard.operators.kmeans import KMeansConfig, assign, centroid_table, kmeans, step
from halyard.operators.metadata import MetadataStore, filtered_top_k, prefiltered
from halyard.operators.pq import Codebooks, IVFPQIndex, PQConfig, encode_table, train_pq
from halyard.operators.search import scan_top_k, search_batch
from halyard.operators.sharding import ShardedCollection, shard_for_id
from halyard.operators.textstore import TextStore
from halyard.plans.catalog import Engine
from halyard.plans.storage import scratch_dir
from halyard.sources import vecs

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
DIM, K = 64, 10

_P = "p AS (SELECT vec_id AS id, list_transform(embedding, lambda x: CAST(x AS DOUBLE) * (1 + vec_id % 7)) AS v FROM embeddings)"
#: Collections keep single precision.
_SINGLE = _P.replace("CAST(x AS DOUBLE) * (1 + vec_id % 7)", "CAST(CAST(CAST(x AS DOUBLE) * (1 + vec_id % 7) AS FLOAT) AS DOUBLE)")
_Q = "q AS (SELECT id AS qid, v FROM p WHERE id % 50 = 0)"
_SCORES = {
    "euclidean": "sqrt(list_sum(list_transform(range(1, 65), lambda i: (q.v[i] - p.v[i]) * (q.v[i] - p.v[i]))))",
    "dot_product": "list_sum(list_transform(range(1, 65), lambda i: q.v[i] * p.v[i]))",
}
_NORM = "sqrt(list_sum(list_transform({}, lambda x: x * x)))"
_SCORES["cosine"] = f"CASE WHEN {_NORM.format('q.v')} * {_NORM.format('p.v')} = 0 THEN 0 ELSE {_SCORES['dot_product']} / ({_NORM.format('q.v')} * {_NORM.format('p.v')}) END"
_RANKED = "SELECT qid, CAST(rank AS INTEGER) AS rank, id, round(score, 6) AS score FROM r WHERE rank <= {k}"


def query(oracle: str | None = None):
    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, vector): the embeddings with lengths from 1 to 7."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("id"), F.transform("embedding", lambda x: x.cast("double") * (1 + F.col("vec_id") % 7)).alias("vector"))


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.withColumn("score", V.round_to("score", digits))


def _sql(metric: str, where: str = "", k: int = K, order: str | None = None, more: str = "") -> str:
    order = order or ("score" if metric == "euclidean" else "score DESC")
    return f"WITH {_P}, {_Q}{more}, s AS (SELECT q.qid, p.id, {_SCORES[metric]} AS score FROM q, p {where}), r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY {order}, id) AS rank FROM s) " + _RANKED.format(k=k)


# Vector arithmetic.


@query(f"WITH {_P} SELECT id, round({_NORM.format('v')}, 6) AS l2, round(list_sum(list_transform(v, lambda x: abs(x))), 6) AS l1 FROM p")
def vec_norms(spark, sf_dir):
    return points(spark, sf_dir).select("id", V.round_to(V.l2_norm("vector"), 6).alias("l2"), V.round_to(V.l1_norm("vector"), 6).alias("l1"))


@query(f"WITH {_P} SELECT id, list_transform(v, lambda x: round(x / {_NORM.format('v')}, 6)) AS unit FROM p")
def vec_normalize(spark, sf_dir):
    return points(spark, sf_dir).select("id", V.round_all(V.normalize("vector"), 6).alias("unit"))


@query(f"WITH {_P} SELECT q.id, round({_SCORES['dot_product']}, 6) AS dot, round({_SCORES['euclidean']}, 6) AS l2, round({_SCORES['cosine']}, 6) AS cosine, round(power({_SCORES['euclidean']}, 2), 5) AS squared FROM p q JOIN p ON p.id = q.id + 1")
def vec_pair_scores(spark, sf_dir):
    p = points(spark, sf_dir)
    both = p.toDF("id", "a").join(p.select((F.col("id") - 1).alias("id"), F.col("vector").alias("b")), "id")
    return both.select("id", V.round_to(V.dot_product("a", "b"), 6).alias("dot"), V.round_to(V.euclidean_distance("a", "b"), 6).alias("l2"), V.round_to(V.cosine_similarity("a", "b"), 6).alias("cosine"), V.round_to(V.squared_euclidean("a", "b"), 5).alias("squared"))


@query("SELECT vec_id AS id FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: NOT isfinite(x))) = 0")
def vec_valid(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").where(V.is_finite("embedding") & (F.size(V.check_dim("embedding", DIM)) == DIM)).select(F.col("vec_id").alias("id"))


# Top-k lists and exact search.


@query("SELECT CAST(row_number() OVER (ORDER BY c_acctbal, c_custkey) AS INTEGER) AS rank, c_custkey AS id, c_acctbal AS score FROM customer ORDER BY 1 LIMIT 25")
def topk_smallest(spark, sf_dir):
    return T.top_k_smallest(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("score")), 25)


@query("SELECT CAST(row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) AS INTEGER) AS rank, c_custkey AS id, c_acctbal AS score FROM customer ORDER BY 1 LIMIT 25")
def topk_largest(spark, sf_dir):
    return T.top_k_largest(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("score")), 25)


@query("SELECT qid, CAST(rank AS INTEGER) AS rank, id, score FROM (SELECT c_nationkey AS qid, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS rank, c_custkey AS id, c_acctbal AS score FROM customer) WHERE rank <= 5")
def topk_merge(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("qid"), F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("score"))
    parts = [T.top_k_per_query(c.where(F.col("id") % 4 == i), 5, True).drop("rank") for i in range(4)]
    return T.top_k_per_query(reduce(DataFrame.unionByName, parts), 5, True)


def _flat(metric: str) -> None:
    @query(_sql(metric, "WHERE q.qid = 0").replace("SELECT qid, CAST(rank", "SELECT CAST(rank").replace(_P, _SINGLE))
    def one(spark, sf_dir):
        c = FlatCollection.from_table(points(spark, sf_dir), "id", "vector", DIM, metric)
        return rounded(c.search(c.get_vector(0), K))

    @query(_sql(metric).replace(_P, _SINGLE))
    def many(spark, sf_dir):
        c = FlatCollection.from_table(points(spark, sf_dir), "id", "vector", DIM, metric)
        return rounded(c.search_batch(c.points.where("id % 50 = 0").select(F.col("id").alias("qid"), "vector"), K))

    for f, name in ((one, f"flat_topk_{metric}"), (many, f"flat_topk_batch_{metric}")):
        QUERIES[name], ORACLES[name] = QUERIES.pop(f.__name__), ORACLES.pop(f.__name__)


for _metric in ("euclidean", "cosine", "dot_product"):
    _flat(_metric)


def _f32(metric: str, where: str = "", k: int = K, more: str = "", p: str | None = None) -> str:
    """As _sql, over the unscaled single-precision vectors that collections keep."""
    own = p or "p AS (SELECT vec_id AS id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings)"
    return _sql(metric, where, k, more=more).replace(_P, own)


def _collection(spark: SparkSession, sf_dir: str, metric: str = "euclidean") -> FlatCollection:
    return FlatCollection.from_table(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", DIM, metric)


def _plain_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").where(F.col("vec_id") % 50 == 0).select(F.col("vec_id").alias("qid"), F.col("embedding").cast("array<double>").alias("vector"))


@query(_f32("euclidean", "WHERE p.id % 3 <> 0"))
def flat_tombstone_search(spark, sf_dir):
    c = _collection(spark, sf_dir)
    c = FlatCollection(c.points, c.points.where("id % 3 = 0").select("id"), DIM, c.metric)
    return rounded(c.search_batch(_plain_queries(spark, sf_dir), K))


@query(_f32("euclidean", p="p AS (SELECT vec_id AS id, list_transform(embedding, lambda x: CASE WHEN vec_id % 5 = 1 THEN -1 ELSE 1 END * CAST(x AS DOUBLE)) AS v FROM embeddings)"))
def flat_update_search(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    first = e.select(F.lit(1).alias("seq"), F.lit("insert").alias("op"), "id", "vector")
    second = e.where("id % 5 = 1").select(F.lit(2).alias("seq"), F.lit("insert").alias("op"), "id", F.transform("vector", lambda x: -x).alias("vector"))
    return rounded(search_batch(latest_points(first.unionByName(second)), _plain_queries(spark, sf_dir), K))


_CHANGED = "p AS (SELECT vec_id AS id, list_transform(embedding, lambda x: CASE WHEN vec_id = 5 THEN -1 ELSE 1 END * CAST(x AS DOUBLE)) AS v FROM embeddings WHERE vec_id <> 3 UNION ALL SELECT CAST(1000000 AS BIGINT), list_transform(range(64), lambda i: CAST(0.125 AS DOUBLE)))"


@query(_f32("euclidean", p=_CHANGED))
def flat_change_search(spark, sf_dir):
    """A batch, a point, a delete, an update and a compaction, each through the collection."""
    c = FlatCollection.create(spark, DIM).add_batch(_collection(spark, sf_dir).points)
    c = c.add(1_000_000, [0.125] * DIM).delete(3)
    c = c.update(5, [-x for x in c.get_vector(5)]).compact()
    return rounded(c.search_batch(c.live().where("id % 50 = 0").select(F.col("id").alias("qid"), "vector"), K))


@query("SELECT count(*) AS total, count(*) FILTER (WHERE vec_id % 3 <> 0) AS live, count(*) FILTER (WHERE vec_id % 3 <> 0) AS compacted FROM embeddings")
def flat_compact_count(spark, sf_dir):
    c = _collection(spark, sf_dir)
    c = FlatCollection(c.points, c.points.where("id % 3 = 0").select("id"), DIM, c.metric)
    n = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    return n(c.points, "total").crossJoin(n(c.live(), "live")).crossJoin(n(c.compact().points, "compacted"))  # one row each


@query("SELECT vec_id AS id, list_transform(embedding, lambda x: round(CAST(x AS DOUBLE), 6)) AS vector FROM embeddings WHERE vec_id = 7")
def flat_point_lookup(spark, sf_dir):
    found = _collection(spark, sf_dir).get_vector(7)
    held = spark.createDataFrame([] if found is None else [(7, found)], "id long, vector array<double>")
    return held.select("id", V.round_all("vector", 6).alias("vector"))


# Metadata.

_META = "m AS (SELECT d.doc_id AS id, d.lang, d.source, d.n_chars, l.quality, l.toxic FROM documents d LEFT JOIN labels l USING (doc_id))"


def _store(spark: SparkSession, sf_dir: str) -> MetadataStore:
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return MetadataStore.from_columns(d, "doc_id", ["lang", "source", "n_chars", "quality", "toxic"])


#: Filters with their SQL: a missing or mistyped field is false, also below a negation.
_FILTERS = {
    "eq": (("eq", "lang", "en"), "lang = 'en'"),
    "gt": (("gt", "n_chars", 2000), "n_chars > 2000"),
    "lt": (("lt", "n_chars", 500.5), "n_chars < 500.5"),
    "and": (("and", ("eq", "lang", "en"), ("gt", "n_chars", 2000)), "lang = 'en' AND n_chars > 2000"),
    "or": (("or", ("eq", "lang", "fr"), ("lt", "n_chars", 500)), "lang = 'fr' OR n_chars < 500"),
    "not": (("not", ("eq", "lang", "en")), "NOT (lang = 'en')"),
    "missing_field": (("not", ("eq", "quality", 1)), "NOT coalesce(quality = 1, false)"),
    "mixed_type": (("or", ("eq", "n_chars", 1000.0), ("or", ("gt", "lang", 1), ("eq", "quality", 0.0))), "n_chars = 1000 OR coalesce(quality = 0, false)"),
}


def _meta(name: str) -> None:
    expr, sql = _FILTERS[name]

    def run(spark, sf_dir):
        return _store(spark, sf_dir).matching(expr)

    QUERIES[f"meta_{name}"], ORACLES[f"meta_{name}"] = run, f"WITH {_META} SELECT id FROM m WHERE {sql}"


for _name in _FILTERS:
    _meta(_name)


@query("SELECT count(DISTINCT doc_id) AS ids FROM documents")
def meta_count(spark, sf_dir):
    return spark.createDataFrame([(len(_store(spark, sf_dir)),)], "ids long")


@query(f"WITH {_META} SELECT id FROM m WHERE (lang = 'en' OR id = 2) AND id NOT IN (1, 4)")
def meta_set_remove(spark, sf_dir):
    """A field that is set again counts as last set; a removed id matches nothing."""
    store = _store(spark, sf_dir).set(2, "lang", "en").set(1, "lang", "xx").set(1, "lang", "yy").remove(4)
    return store.matching(("eq", "lang", "en"))


@query(f"WITH {_META} SELECT id, map_from_entries(list_filter([('lang', lang), ('source', source), ('n_chars', CAST(n_chars AS VARCHAR)), ('quality', CAST(quality AS VARCHAR)), ('toxic', CAST(toxic AS VARCHAR))], lambda e: e[2] IS NOT NULL))['n_chars'] AS n_chars, (lang IS NOT NULL)::INTEGER + (source IS NOT NULL)::INTEGER + (n_chars IS NOT NULL)::INTEGER + (quality IS NOT NULL)::INTEGER + (toxic IS NOT NULL)::INTEGER AS fields FROM m")
def meta_fields(spark, sf_dir):
    """All fields of every id as a map: one of them, and how many there are."""
    maps = _store(spark, sf_dir).maps()
    return maps.select("id", F.try_element_at("meta", F.lit("n_chars"))["int_val"].cast("string").alias("n_chars"), F.size("meta").alias("fields"))


_FILTERED = _f32("euclidean", k=50)
_FILTERED = _FILTERED[: _FILTERED.index(" SELECT qid, CAST(rank")] + f", {_META}, f AS (SELECT r.qid, r.id, r.score, row_number() OVER (PARTITION BY qid ORDER BY r.rank) AS rank FROM r JOIN m USING (id) WHERE r.rank <= 50 AND lang = 'en') SELECT qid, CAST(rank AS INTEGER) AS rank, id, round(score, 6) AS score FROM f WHERE rank <= 5"


@query(_FILTERED)
def filtered_topk(spark, sf_dir):
    found = _collection(spark, sf_dir).search_batch(_plain_queries(spark, sf_dir), 50)
    return rounded(filtered_top_k(found, _store(spark, sf_dir), ("eq", "lang", "en"), 5))


@query(_f32("euclidean", "JOIN m ON m.id = p.id WHERE lang = 'en'", 5, more=f", {_META}"))
def prefiltered_topk(spark, sf_dir):
    c = _collection(spark, sf_dir)
    return rounded(search_batch(prefiltered(c.points, _store(spark, sf_dir), ("eq", "lang", "en")), _plain_queries(spark, sf_dir), 5))


# Shards.

_M64 = "18446744073709551615::UHUGEINT"
_SHARD = f"""z0 AS (SELECT vec_id AS id, (vec_id::UHUGEINT + 11400714819323198485::UHUGEINT) & {_M64} AS z FROM embeddings),
z1 AS (SELECT id, (xor(z, z >> 30) * 13787848793156543929::UHUGEINT) & {_M64} AS z FROM z0),
z2 AS (SELECT id, (xor(z, z >> 27) * 10723151780598845931::UHUGEINT) & {_M64} AS z FROM z1),
z3 AS (SELECT id, CAST(xor(z, z >> 31) % 8 AS INTEGER) AS shard FROM z2)"""
_SHARD = _SHARD.replace("(xor(z, z >> 30) * 13787848793156543929::UHUGEINT)", "((xor(z, z >> 30) % 4294967296 * 13787848793156543929::UHUGEINT) + (((xor(z, z >> 30) >> 32) * 13787848793156543929::UHUGEINT % 4294967296::UHUGEINT) << 32))").replace("(xor(z, z >> 27) * 10723151780598845931::UHUGEINT)", "((xor(z, z >> 27) % 4294967296 * 10723151780598845931::UHUGEINT) + (((xor(z, z >> 27) >> 32) * 10723151780598845931::UHUGEINT % 4294967296::UHUGEINT) << 32))")


@query(f"WITH {_SHARD} SELECT id, shard FROM z3")
def shard_of_id(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), shard_for_id("vec_id", 8).alias("shard"))


@query(f"WITH {_SHARD} SELECT s.shard, count(z3.id) AS size FROM (SELECT unnest(range(8))::INTEGER AS shard) s LEFT JOIN z3 ON z3.shard = s.shard GROUP BY s.shard")
def shard_sizes(spark, sf_dir):
    return ShardedCollection(_collection(spark, sf_dir), 8).shard_sizes()


@query(_f32("euclidean"))
def sharded_topk(spark, sf_dir):
    return rounded(ShardedCollection(_collection(spark, sf_dir), 8).search_batch(_plain_queries(spark, sf_dir), K))


def _saved_shards(spark: SparkSession, sf_dir: str) -> ShardedCollection:
    path = scratch_dir(spark, "shards")
    ShardedCollection(_collection(spark, sf_dir), 8).save(path)
    return ShardedCollection.load(spark, path)


@query(_f32("dot_product"))
def sharded_saved_topk(spark, sf_dir):
    saved = _saved_shards(spark, sf_dir)
    flat = FlatCollection(saved.flat.points, saved.flat.tombstones, DIM, "dot_product")
    return rounded(ShardedCollection(flat, 8).search_batch(_plain_queries(spark, sf_dir), K))


@query("SELECT vec_id AS id, list_transform(embedding, lambda x: round(CAST(x AS DOUBLE), 6)) AS vector FROM embeddings WHERE vec_id = 11")
def sharded_point_lookup(spark, sf_dir):
    """From one shard's folder."""
    return _saved_shards(spark, sf_dir).lookup(11).select("id", V.round_all("vector", 6).alias("vector"))


# K-means and inverted files.

_PLAIN = "p AS (SELECT vec_id AS id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v, label FROM embeddings)"
_GAP = "list_sum(list_transform(range(1, 65), lambda i: (p.v[i] - c.v[i]) * (p.v[i] - c.v[i])))"


def _kmeans_sql(rounds: int) -> str:
    ctes = [_PLAIN, "c0 AS (SELECT CAST(id AS INTEGER) AS k, v FROM p WHERE id < 5)"]
    for i in range(rounds):
        ctes.append(f"a{i} AS (SELECT id, v, k FROM (SELECT p.id, p.v, c.k, row_number() OVER (PARTITION BY p.id ORDER BY {_GAP}, c.k) AS n FROM p, c{i} c) WHERE n = 1)")
        ctes.append(f"u{i} AS (SELECT k, i, avg(v[i]) AS x FROM a{i}, (SELECT unnest(range(1, 65)) AS i) GROUP BY k, i)")
        ctes.append(f"c{i + 1} AS (SELECT k, list(x ORDER BY i) AS v FROM u{i} GROUP BY k)")
    return f"WITH {', '.join(ctes)} SELECT k AS cluster_id, (SELECT count(*) FROM a{rounds - 1} WHERE a{rounds - 1}.k = c.k) AS size, list_transform(v, lambda x: round(x, 6)) AS centroid FROM c{rounds} c"


def _steps(spark: SparkSession, sf_dir: str, rounds: int) -> DataFrame:
    p = _collection(spark, sf_dir).points
    c = np.array([r.vector for r in p.where("id < 5").orderBy("id").collect()], float)
    n = None
    for _ in range(rounds):
        c, n = step(p, c)
    sizes = spark.createDataFrame([(i, int(x)) for i, x in enumerate(n)], "cluster_id int, size long")
    return centroid_table(spark, c).join(sizes, "cluster_id").select("cluster_id", "size", V.round_all("centroid", 6).alias("centroid"))


@query(_kmeans_sql(1))
def kmeans_one_step(spark, sf_dir):
    return _steps(spark, sf_dir, 1)


@query(_kmeans_sql(3))
def kmeans_three_steps(spark, sf_dir):
    return _steps(spark, sf_dir, 3)


@query()
def kmeans_fit(spark, sf_dir):
    found = kmeans(_collection(spark, sf_dir).points, KMeansConfig(k=8, max_iterations=10), seed=42)
    return found.assignments.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("size"))


@query("SELECT CAST(8 AS BIGINT) AS clusters, count(*) AS points, TRUE AS settled, TRUE AS nearest FROM embeddings")
def kmeans_invariants(spark, sf_dir):
    """Of a fit: clusters with rows, rows, whether a further step moves the centroids little, and whether rows lie nearest to their own."""
    p = _collection(spark, sf_dir).points
    found = kmeans(p, KMeansConfig(k=8, max_iterations=60), seed=42)
    moved, _ = step(p, found.centroids)
    again = assign(p, found.centroids).select("id", F.col("cluster_id").alias("own")).join(found.assignments, "id")
    settled = bool(np.sqrt(((moved - found.centroids) ** 2).sum()) < 0.05)
    out = again.agg(F.countDistinct("cluster_id").alias("clusters"), F.count(F.lit(1)).alias("points"), (F.avg((F.col("own") == F.col("cluster_id")).cast("int")) > 0.97).alias("nearest"))
    return out.select("clusters", "points", F.lit(settled).alias("settled"), "nearest")


def _label_means(spark: SparkSession, sf_dir: str) -> np.ndarray:
    """A centroid for each of the ten labels: the mean of its vectors."""
    e = table(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("i", "x"))
    rows = e.groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("x")).collect()
    out = np.zeros((10, DIM))
    for r in rows:
        out[r.label, r.i] = r.x
    return out


_MEANS = f"{_PLAIN}, u AS (SELECT label AS k, i, avg(v[i]) AS x FROM p, (SELECT unnest(range(1, 65)) AS i) GROUP BY 1, 2), c AS (SELECT k, list(x ORDER BY i) AS v FROM u GROUP BY k), a AS (SELECT id, v, k FROM (SELECT p.id, p.v, c.k, row_number() OVER (PARTITION BY p.id ORDER BY {_GAP}, c.k) AS n FROM p, c) WHERE n = 1)"
_PROBES = f"b AS (SELECT id AS qid, v, k FROM (SELECT p.id, p.v, c.k, row_number() OVER (PARTITION BY p.id ORDER BY {_GAP}, c.k) AS n FROM p, c WHERE p.id % 50 = 0) WHERE n <= 3)"


def _ivf(spark: SparkSession, sf_dir: str) -> IVFIndex:
    c = _collection(spark, sf_dir)
    index = IVFIndex.create(spark, DIM, 10).with_centroids(_label_means(spark, sf_dir))
    return IVFIndex(DIM, 10, "euclidean", index.centroids, assign(c.points, index.centroids), index.tombstones)


@query(f"WITH {_MEANS} SELECT id, k AS cluster_id FROM a")
def ivf_assign(spark, sf_dir):
    return _ivf(spark, sf_dir).postings.select("id", "cluster_id")


@query(f"WITH {_MEANS} SELECT c.k AS cluster_id, count(a.id) AS size FROM c LEFT JOIN a ON a.k = c.k GROUP BY c.k")
def ivf_cluster_sizes(spark, sf_dir):
    return _ivf(spark, sf_dir).cluster_sizes()


@query(f"WITH {_MEANS}, {_PROBES} SELECT b.qid, count(*) AS candidates FROM b JOIN a ON a.k = b.k GROUP BY b.qid")
def ivf_coverage(spark, sf_dir):
    index = _ivf(spark, sf_dir)
    probes = probe_table(_plain_queries(spark, sf_dir), centroid_table(spark, index.centroids), 3)
    return probes.join(index.cluster_sizes(), "cluster_id").groupBy("qid").agg(F.sum("size").alias("candidates"))


def _ivf_sql(metric: str) -> str:
    order = "score" if metric == "euclidean" else "score DESC"
    return f"WITH {_MEANS}, {_PROBES}, s AS (SELECT q.qid, p.id, {_SCORES[metric]} AS score FROM b q JOIN a p ON p.k = q.k), r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY {order}, id) AS rank FROM s) " + _RANKED.format(k=K)


@query(_ivf_sql("euclidean"))
def ivf_topk(spark, sf_dir):
    return rounded(_ivf(spark, sf_dir).search_batch(_plain_queries(spark, sf_dir), K, nprobe=3))


@query(_ivf_sql("dot_product"))
def ivf_topk_dot_product(spark, sf_dir):
    index = _ivf(spark, sf_dir)
    return rounded(IVFIndex(DIM, 10, "dot_product", index.centroids, index.postings, index.tombstones).search_batch(_plain_queries(spark, sf_dir), K, nprobe=3))


def _trained_ivf(spark: SparkSession, sf_dir: str) -> IVFIndex:
    """Trained, filled, saved by cluster, and loaded again."""
    p, path = _collection(spark, sf_dir).points, scratch_dir(spark, "ivf")
    IVFIndex.create(spark, DIM, 8).train(p, KMeansConfig(k=8, max_iterations=10)).add_batch(p).save(path)
    return IVFIndex.load(spark, path)


@query(_f32("euclidean"))
def ivf_trained_topk(spark, sf_dir):
    """All clusters probed: as exact as the flat search."""
    return rounded(_trained_ivf(spark, sf_dir).search_batch(_plain_queries(spark, sf_dir), K, nprobe=8))


@query("SELECT count(*) AS live, TRUE AS few_read, TRUE AS itself_first FROM embeddings WHERE vec_id <> 9")
def ivf_saved_probe(spark, sf_dir):
    """One point deleted; a search of one cluster compares fewer rows than there are, and finds the query itself first."""
    index = _trained_ivf(spark, sf_dir).delete(9)
    q = _collection(spark, sf_dir).get_vector(0)
    first = index.search(q, 1, nprobe=1).first()
    return spark.createDataFrame([(len(index), index.nprobe_coverage(q, 1) < len(index), first.id == 0)], "live long, few_read boolean, itself_first boolean")


# Product quantisation: the codebooks are the subvectors of the first 16 rows.


def _books(spark: SparkSession, sf_dir: str) -> Codebooks:
    rows = _collection(spark, sf_dir).points.where("id < 16").orderBy("id").collect()
    return Codebooks(np.array([r.vector for r in rows], float).reshape(16, 8, 8).transpose(1, 0, 2))


_CODES = f"""{_PLAIN}, b AS (SELECT CAST(id AS INTEGER) AS k, v FROM p WHERE id < 16),
g AS (SELECT p.id, m, b.k, list_sum(list_transform(range(1, 9), lambda i: power(p.v[m * 8 + i] - b.v[m * 8 + i], 2))) AS gap FROM p, b, (SELECT unnest(range(8)) AS m)),
e AS (SELECT id, m, k FROM (SELECT *, row_number() OVER (PARTITION BY id, m ORDER BY gap, k) AS n FROM g) WHERE n = 1),
code AS (SELECT id, list(k ORDER BY m) AS code FROM e GROUP BY id)"""


@query(f"WITH {_CODES} SELECT id, code FROM code")
def pq_encode(spark, sf_dir):
    codes = encode_table(_collection(spark, sf_dir).points, _books(spark, sf_dir))
    byte = lambda i: F.conv(F.substring(F.hex("code"), 2 * i + 1, 2), 16, 10).cast("int")
    return codes.select("id", F.array(*map(byte, range(8))).alias("code"))


@query(f"WITH {_CODES} SELECT e.id, list(round(b.v[e.m * 8 + i], 6) ORDER BY e.m, i) AS vector FROM e JOIN b ON b.k = e.k, (SELECT unnest(range(1, 9)) AS i) GROUP BY e.id")
def pq_decode(spark, sf_dir):
    books = _books(spark, sf_dir)
    p = _collection(spark, sf_dir).points.select("id", books.encode_column(F.col("vector").cast("array<double>")).alias("code"))
    return p.select("id", V.round_all(books.decode_column("code"), 6).alias("vector"))


_ADC = f"WITH {_CODES}, t AS (SELECT id AS qid, m, k, gap FROM g WHERE id % 50 = 0), s AS (SELECT t.qid, e.id, sum(t.gap) AS score FROM e JOIN t ON t.m = e.m AND t.k = e.k GROUP BY 1, 2)"


@query(f"{_ADC} SELECT id, round(score, 6) AS score FROM s WHERE qid = 0")
def pq_adc(spark, sf_dir):
    """The distances of one query to every code."""
    c = _collection(spark, sf_dir)
    books = _books(spark, sf_dir)
    coded = c.points.select("id", books.encode_column(F.col("vector").cast("array<double>")).alias("code"))
    return coded.select("id", V.round_to(books.adc_column(c.get_vector(0), "code"), 6).alias("score"))


def _ivfpq(spark: SparkSession, sf_dir: str) -> IVFPQIndex:
    index = IVFPQIndex.create(spark, DIM, 10, PQConfig(8, 16)).with_model(_label_means(spark, sf_dir), _books(spark, sf_dir))
    return index.add_batch(_collection(spark, sf_dir).points)


@query(f"""WITH {_CODES}, u AS (SELECT label AS k, i, avg(v[i]) AS x FROM p, (SELECT unnest(range(1, 65)) AS i) GROUP BY 1, 2), c AS (SELECT k, list(x ORDER BY i) AS v FROM u GROUP BY k),
o AS (SELECT p.id, c.k, row_number() OVER (PARTITION BY p.id ORDER BY {_GAP}, c.k) AS n FROM p, c),
t AS (SELECT id AS qid, m, k, gap FROM g WHERE id % 50 = 0),
s AS (SELECT x.id AS qid, y.id, list_sum(list(t.gap ORDER BY t.m)) AS score FROM o x JOIN o y ON x.id % 50 = 0 AND x.n <= 3 AND y.n = 1 AND x.k = y.k JOIN e ON e.id = y.id JOIN t ON t.qid = x.id AND t.m = e.m AND t.k = e.k GROUP BY 1, 2)
SELECT qid, CAST(rank AS INTEGER) AS rank, id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score, id) AS rank FROM s) WHERE rank <= 10""")
def ivfpq_topk(spark, sf_dir):
    """Written by cluster and read again; a search opens the folders of the clusters that it probes."""
    path = scratch_dir(spark, "ivfpq")
    _ivfpq(spark, sf_dir).save(path)
    return rounded(IVFPQIndex.load(spark, path).search_batch(_plain_queries(spark, sf_dir), K, nprobe=3))


@query("SELECT CAST(count(*) * 8 + 10 * 64 * 4 + 8 * 16 * 8 * 4 AS BIGINT) AS bytes FROM embeddings")
def ivfpq_footprint(spark, sf_dir):
    return spark.createDataFrame([(_ivfpq(spark, sf_dir).memory_footprint_bytes(),)], "bytes long")


@query()
def pq_train(spark, sf_dir):
    return train_pq(_collection(spark, sf_dir).points, PQConfig(8, 16, 10)).to_table(spark)


@query("SELECT 8 AS m, 16 AS k, TRUE AS better_than_rows FROM (SELECT 1)")
def pq_train_invariants(spark, sf_dir):
    """Codebooks that were trained reproduce the vectors better than codebooks of the first rows do."""
    p = _collection(spark, sf_dir).points

    def error(books: Codebooks) -> float:
        coded = p.select(F.col("vector").cast("array<double>").alias("v")).withColumn("d", books.decode_column(books.encode_column("v")))
        return coded.agg(F.avg(V.squared_euclidean("v", "d"))).first()[0]

    books = train_pq(p, PQConfig(8, 16, 10))
    return spark.createDataFrame([(books.m, books.k, error(books) < error(_books(spark, sf_dir)))], "m int, k int, better_than_rows boolean")


# Small-world graphs.


@query()
def hnsw_topk(spark, sf_dir):
    index = HnswIndex.create(spark, DIM, "euclidean", HnswConfig(8, 64, 64)).insert_batch(_collection(spark, sf_dir).points)
    return rounded(index.search_batch(_plain_queries(spark, sf_dir), K, ef=100))


@query("SELECT vec_id AS qid, CAST(10 AS BIGINT) AS rows, TRUE AS itself_first, TRUE AS in_order, TRUE AS most_found FROM embeddings WHERE vec_id % 50 = 0")
def hnsw_invariants(spark, sf_dir):
    """Half of the rows built, the others inserted, saved and loaded: rows found, the query itself first, scores in order, and 8 of the 10 nearest."""
    p, path, q = _collection(spark, sf_dir).points, scratch_dir(spark, "hnsw"), _plain_queries(spark, sf_dir)
    index = HnswIndex.create(spark, DIM, "euclidean", HnswConfig(16, 100, 64)).insert_batch(p.where("id % 2 = 0")).insert_batch(p.where("id % 2 = 1"))
    index.save(path)
    found = HnswIndex.load(spark, path).search_batch(q, K, ef=200)
    recall = E.recall_table(found, search_batch(p, q, K), K)
    facts = found.groupBy("qid").agg(F.count(F.lit(1)).alias("rows"), (F.min_by("id", "rank") == F.col("qid")).alias("itself_first"), F.array_sort(F.collect_list(F.struct("rank", "score"))).alias("s"))
    in_order = F.forall(F.sequence(F.lit(1), F.size("s") - 1), lambda i: F.col("s")[i]["score"] >= F.col("s")[i - 1]["score"])
    return facts.join(recall, "qid").select("qid", "rows", "itself_first", in_order.alias("in_order"), (F.col("recall") >= 0.8).alias("most_found"))


@query("SELECT count(*) AS nodes, TRUE AS bounded, TRUE AS entries_top FROM embeddings")
def hnsw_structure(spark, sf_dir):
    """Nodes; whether no node has more links than 2 m (layer 0) and m; whether walks start on each shard's highest layer."""
    index = HnswIndex.create(spark, DIM, "euclidean", HnswConfig(8, 32, 32)).insert_batch(_collection(spark, sf_dir).points)
    nodes = index.nodes()
    bounded = F.forall("neighbours", lambda links: F.size(links) <= 16) & F.forall(F.slice("neighbours", 2, 64), lambda links: F.size(links) <= 8)
    tops = nodes.groupBy("shard").agg(F.max("max_layer").alias("top")).join(index.entry_points(), "shard").agg(F.bool_and(F.col("top") == F.col("max_layer")).alias("entries_top"))
    return nodes.agg(F.count(F.lit(1)).alias("nodes"), F.bool_and(bounded).alias("bounded")).crossJoin(tops)  # one row each


@query()
def hnsw_layers(spark, sf_dir):
    index = HnswIndex.create(spark, DIM, "euclidean", HnswConfig(8, 32, 32)).insert_batch(_collection(spark, sf_dir).points)
    return index.max_layer_distribution()


@query("SELECT l_orderkey, l_linenumber, CAST(floor(-ln(least(1.0, greatest(CAST(l_discount AS DOUBLE), 1.1920928955078125e-07))) * (1 / ln(16))) AS INTEGER) AS layer FROM lineitem")
def hnsw_layer_draw(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", layer_column("l_discount", 16).alias("layer"))


# Evaluation.


@query(f"WITH {_PLAIN}, {_Q}, s AS (SELECT q.qid, p.id, {_SCORES['euclidean']} AS score FROM q, p), r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score, id) AS rank FROM s), f AS (SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY score, id) AS rank FROM s WHERE id % 4 <> 1) SELECT qid, (SELECT count(*) FROM r JOIN f USING (qid, id) WHERE r.qid = q.qid AND r.rank <= 10 AND f.rank <= 10) / 10.0::DOUBLE AS recall FROM q".replace("q AS (SELECT id AS qid, v FROM p", "q AS (SELECT id AS qid, v FROM p"))
def recall_at_k(spark, sf_dir):
    q, c = _plain_queries(spark, sf_dir), _collection(spark, sf_dir)
    return E.recall_table(search_batch(c.points.where("id % 4 <> 1"), q, K), search_batch(c.points, q, K), K)


@query("SELECT round(avg(s), 6) AS mean_s, round(median(s), 6) AS median_s, round(stddev_samp(s), 6) AS stddev_s, round(avg(q), 6) AS mean_qps, round(median(q), 6) AS median_qps, stddev_samp(s) > 0.2 * avg(s) AS high_variance FROM (SELECT s, 100 / s AS q FROM (SELECT value AS s FROM events WHERE value > 0))")
def timing_summary(spark, sf_dir):
    out = E.summarize_timings(table(spark, sf_dir, "events").where("value > 0").select(F.col("value").alias("seconds")), 100)
    return out.select(*(V.round_to(c, 6).alias(c) for c in out.columns[:-1]), "high_variance")


@query("SELECT round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99 FROM events")
def latency_percentiles(spark, sf_dir):
    out = E.latency_percentiles(table(spark, sf_dir, "events").select(F.col("value").alias("seconds")))
    return out.select(*(V.round_to(c, 6).alias(c) for c in out.columns))


@query("""WITH s AS (SELECT * FROM (VALUES (1.0, 0.40, 2000.0), (5.0, 0.80, 1000.0), (10.0, 0.92, 600.0)) t(param, recall, qps)),
n AS (SELECT *, lead(param) OVER w AS p2, lead(recall) OVER w AS r2, lead(qps) OVER w AS q2 FROM s WINDOW w AS (ORDER BY recall))
SELECT 0.9::DOUBLE AS recall, round(qps + (0.9 - recall) / (r2 - recall) * (q2 - qps), 6)::DOUBLE AS qps, round(param + (0.9 - recall) / (r2 - recall) * (p2 - param), 6)::DOUBLE AS param, 'linear_interpolation' AS method FROM n WHERE recall <= 0.9 AND r2 >= 0.9""")
def iso_recall(spark, sf_dir):
    out = E.iso_recall(spark.createDataFrame([(1, 0.40, 2000.0), (5, 0.80, 1000.0), (10, 0.92, 600.0)], "param int, recall double, qps double"), 0.9)
    return out.select("recall", V.round_to("qps", 6).alias("qps"), V.round_to("param", 6).alias("param"), "method")


# The operation log: events are operations on users; purchases delete.

_OPS = "o AS (SELECT event_id AS seq, CASE WHEN event_type = 'purchase' THEN 'delete' ELSE 'insert' END AS op, user_id AS id, [CAST(value AS FLOAT)] AS vector FROM events)"
_LAST = "l AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY seq DESC) AS n FROM o)"


def _ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("seq"), F.when(F.col("event_type") == "purchase", "delete").otherwise("insert").alias("op"), F.col("user_id").alias("id"), F.array(F.col("value").cast("float")).alias("vector"))


@query(f"WITH {_OPS}, {_LAST} SELECT id, round(CAST(vector[1] AS DOUBLE), 4) AS x FROM l WHERE n = 1 AND op <> 'delete'")
def wal_replay(spark, sf_dir):
    return latest_points(_ops(spark, sf_dir)).select("id", V.round_to(F.col("vector")[0], 4).alias("x"))


def _engine(spark: SparkSession) -> tuple[Engine, str]:
    root = scratch_dir(spark, "engine")
    return Engine(spark, root), root


@query("SELECT vec_id AS id, round(CAST(embedding[1] AS DOUBLE), 4) AS x FROM embeddings WHERE vec_id <> 2 UNION ALL SELECT 1000000, 0.5")
def checkpoint_recover(spark, sf_dir):
    """A batch, a delete, a checkpoint, a batch and a point after it; another engine reads snapshot and log anew."""
    engine, root = _engine(spark)
    p = _collection(spark, sf_dir).points
    engine.create_collection("c", DIM, "flat")
    engine.insert_batch("c", p.where("id % 2 = 0"))
    engine.delete("c", 2)
    engine.checkpoint("c")
    engine.insert_batch("c", p.where("id % 2 = 1"))
    engine.insert("c", 1_000_000, [0.5] * DIM)
    return Engine(spark, root).points("c").select("id", V.round_to(F.col("vector")[0], 4).alias("x"))


@query("SELECT * FROM (VALUES ('even', 64, 'flat', 'euclidean', 0), ('odd', 64, 'hnsw', 'cosine', 1)) t(name, dim, index_type, metric, r), LATERAL (SELECT count(*) AS vector_count FROM embeddings WHERE vec_id % 2 = t.r)".replace("SELECT *", "SELECT name, dim, index_type, metric, vector_count"))
def catalog_list(spark, sf_dir):
    """Two collections filled and a third one deleted."""
    engine, _ = _engine(spark)
    p = _collection(spark, sf_dir).points
    for name, kind, metric, rest in (("even", "flat", "euclidean", 0), ("odd", "hnsw", "cosine", 1), ("gone", "flat", "euclidean", 0)):
        engine.create_collection(name, DIM, kind, metric)
        engine.insert_batch(name, p.where(F.col("id") % 2 == rest))
    engine.delete_collection("gone")
    failed = engine.checkpoint_all()
    assert not failed, failed
    return engine.list_collections()


@query(_f32("euclidean", "WHERE q.qid = 0").replace("SELECT qid, CAST(rank", "SELECT CAST(rank"))
def catalog_search(spark, sf_dir):
    engine, _ = _engine(spark)
    c = _collection(spark, sf_dir)
    engine.create_collection("c", DIM, "flat")
    engine.insert_batch("c", c.points)
    engine.checkpoint("c")
    return rounded(engine.search("c", c.get_vector(0), K))


@query("SELECT vec_id AS id, list_transform(embedding, lambda x: round(CAST(x AS DOUBLE), 6)) AS vector FROM embeddings")
def fvecs_roundtrip(spark, sf_dir):
    """Written as fvecs files, the ids as ivecs, and both read back."""
    path, p = scratch_dir(spark, "vecs"), _collection(spark, sf_dir).points
    vecs.write_vecs(p.repartitionByRange("id").sortWithinPartitions("id"), f"{path}/f", "fvecs", ids=f"{path}/i")
    return vecs.read_vecs_with_ids(spark, f"{path}/f", f"{path}/i").select("id", V.round_all("vector", 6).alias("vector"))


def letter_frequencies(texts: list[str]) -> list[list[float]]:
    """A plain embedding: how often each letter a to z occurs."""
    return [[t.lower().count(chr(97 + i)) / max(len(t), 1) for i in range(26)] for t in texts]


_LETTERS = "list_transform(range(97, 123), lambda c: (len(lower({t})) - len(replace(lower({t}), chr(c::INTEGER), ''))) / greatest(len({t}), 1)::DOUBLE)"


@query(f"WITH b AS (SELECT item_id AS id, text, {_LETTERS.format(t='text')} AS v FROM benchmark), q AS (SELECT v FROM b WHERE id = 0) SELECT CAST(row_number() OVER (ORDER BY s, id) AS INTEGER) AS rank, id, round(s, 6) AS score, text FROM (SELECT b.id, b.text, sqrt(list_sum(list_transform(range(1, 27), lambda i: power(b.v[i] - q.v[i], 2)))) AS s FROM b, q) ORDER BY s, id LIMIT 4")
def text_similarity(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), "text")
    text = b.where("id = 0").first().text
    return rounded(TextStore.from_table(b, letter_frequencies).similarity_search(text, 4)).select("rank", "id", "score", "text")


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest vectors of each of the first ten: (qid, rank, id, score)."""
    e = table(spark, sf_dir, "embeddings")
    q = e.where("vec_id < 10").select(F.col("vec_id").alias("qid"), "embedding").toDF("qid", "vector")
    return search_batch(e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector")), q, K)


__all__ = ["ORACLES", "QUERIES", "entry", "scan_top_k"]
