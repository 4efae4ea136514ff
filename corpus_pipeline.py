"""The training-data pipeline: five stages over `documents`, each of which keeps, drops, mixes or encodes whole texts.

Each stage is (spark, docs, sf_dir) -> DataFrame; run() writes every stage's result as Parquet into the shared folder
and reads it again as the next one's docs. All stages but the last return the columns of `documents`. Stages go by
rows: null and repeated ids are rows like others, extra columns come along, and an empty table stays empty.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from halyard.llm import language_id, near_dedup, pieces, quality_crf
from halyard.llm._common import ROW_KEY, materialise, shared_dir, with_row_key
from halyard.llm.mixing import mixed_documents

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in which no language is found (`und`) or none with a score of 0.2.

    Null, empty and letterless texts have no language and go. Repeated rows share their fate.
    """
    return language_id.keep_identified(docs, language_id.train(docs))


def keep_good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose quality is below 0.5; the classifier learns from `labels`.

    Null and empty texts are scored as one empty line. Repeated rows share their fate.
    """
    return quality_crf.keep_good(docs, quality_crf.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row, that of the smallest id, of each group that shares 0.8 of its five-word shingles.

    Rows go by a key of their own: null ids come after all others, and rows of one id by their content. Null, empty and
    wordless texts are like nothing and stay; of repeated rows one stays.
    """
    keyed = with_row_key(docs)
    found = materialise(near_dedup.near_duplicates(keyed, words=5, percent=80, id_col="_row").select("_row", "component_id"), "groups")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", *ROW_KEY)
    first = found.join(keyed.select("doc_id", *ROW_KEY), "_row").groupBy("component_id").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("n"))
    # Written before it meets the rows: adaptive execution then splits a group of very many rows over tasks.
    dropped = found.join(materialise(first.where("n > 1"), "first"), "component_id").where(F.col("_row") != F.col("first._row")).select("_row")
    return keyed.join(dropped, "_row", "left_anti").select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes from each source the words of its target; a document taken twice has two rows.

    Texts without words are not taken. A null source is a source. A text that is cut at the end of a shard's share has
    its n_chars counted anew.
    """
    mixed = mixed_documents(docs)
    return mixed.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else mixed


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encodes the texts into piece ids, and decodes them again to see that nothing is lost; null texts have no pieces."""
    import public_tokenizers

    return pieces.encode_decode(docs, public_tokenizers.path("piece_bpe_32k.model"), with_ids=True)


STAGES: list[tuple[str, Stage]] = [
    ("language_id", identify_language),
    ("quality", keep_good_quality),
    ("near_dedup", drop_near_duplicates),
    ("mixing", mix_sources),
    ("sentencepiece", encode_pieces),
]

#: SQL can express neither the classifiers nor the encoder; tests hold each stage against a plain version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over `documents`, one after the other."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = shared_dir(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
