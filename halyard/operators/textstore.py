"""Texts searched by the similarity of their embeddings; the caller brings the embedding function."""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from halyard.functions.vector import metric_name
from halyard.operators.search import search


def text_id(id: str | int) -> int:
    """A number as it is, a numeric string as its number, any other string by a hash of 63 bits."""
    if isinstance(id, int):
        return id
    return int(id) if id.isdigit() else int.from_bytes(hashlib.sha256(id.encode()).digest()[:8], "big") >> 1


@dataclass(frozen=True)
class TextStore:
    """documents(id, text, metadata, vector). embed takes a list of texts and returns a list of vectors."""

    documents: DataFrame
    embed: Callable[[list[str]], list[list[float]]]
    metric: str = "euclidean"

    @staticmethod
    def from_table(texts: DataFrame, embed: Callable[[list[str]], list[list[float]]], metric: str = "euclidean") -> TextStore:
        """Over texts(id, text[, metadata map<string, string>])."""

        @F.pandas_udf("array<double>")
        def vector(t: pd.Series) -> pd.Series:
            return pd.Series(embed(t.tolist()), index=t.index)

        meta = F.col("metadata") if "metadata" in texts.columns else F.lit(None).cast("map<string,string>")
        return TextStore(texts.select(F.col("id").cast("long"), "text", meta.alias("metadata"), vector("text").alias("vector")), embed, metric_name(metric))

    def add_texts(self, texts: DataFrame) -> TextStore:
        return TextStore(self.documents.unionByName(TextStore.from_table(texts, self.embed, self.metric).documents), self.embed, self.metric)

    def similarity_search(self, query: str, k: int = 4) -> DataFrame:
        """(rank, id, score, text, metadata) of the k nearest texts."""
        found = search(self.documents, list(self.embed([query])[0]), k, self.metric)
        return found.join(self.documents.select("id", "text", "metadata"), "id").orderBy("rank").select("rank", "id", "score", "text", "metadata")
