"""The thin queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: (spark, folder of the tables) -> the operator's full result.
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@query
def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from halyard.llm.near_dedup import near_duplicates

    return near_duplicates(_documents(spark, sf_dir), words=3, percent=85)


@query
def op10_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    from halyard.llm.warc import archive

    return archive(spark.read.parquet(f"{sf_dir}/pages.parquet"), least_bytes=0)


@query
def op2_mtree_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from halyard.llm.mtree import exact_topk

    return exact_topk(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), k=10, every=100)


@query
def op6_inverted_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    from halyard.llm.multi_index import nearest

    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), k=20, every=20)


@query
def op7_sainte_lague_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from halyard.llm.mixing import mix

    return mix(_documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


@query
def op1_crf_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from halyard.llm.quality_crf import score_quality, train

    docs = _documents(spark, sf_dir)
    return score_quality(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


@query
def op3_hierarchical_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from halyard.llm.language_id import identify, train

    docs = _documents(spark, sf_dir)
    return identify(docs, train(docs))


@query
def op5_wavelet_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from halyard.llm.wavelet import token_files

    return token_files(_documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), end=1)


@query
def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from halyard.llm.pieces import encode_decode

    return encode_decode(_documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))


@query
def op8_katz_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    from halyard.llm.katz import score_documents

    return score_documents(_documents(spark, sf_dir), modulus=10, held=0)
