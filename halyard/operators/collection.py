"""A collection of vectors with deletes, updates and compaction.

State is two DataFrames, points(id, vector) and tombstones(id). Every change returns a new collection; readers of the
old one are not disturbed, which is all that concurrent readers need. An id is unique among all points.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from halyard.functions.vector import is_finite, metric_name
from halyard.operators.search import search, search_batch

POINTS = "id long, vector array<float>"


def _rows(spark: SparkSession, rows) -> DataFrame:
    return spark.createDataFrame([(int(i), [float(x) for x in v]) for i, v in rows], POINTS)


def batch_from_parts(spark: SparkSession, data: list[float], dim: int, n: int) -> DataFrame:
    """(row, vector) from a row-major buffer whose length is checked."""
    if len(data) != dim * n:
        raise ValueError(f"buffer length {len(data)} doesn't match {n} vectors of dimension {dim}")
    return spark.createDataFrame([(i, [float(x) for x in data[i * dim : (i + 1) * dim]]) for i in range(n)], "row long, vector array<float>")


@dataclass(frozen=True)
class FlatCollection:
    """Vectors of one dimension under one metric, searched exactly."""

    points: DataFrame
    tombstones: DataFrame
    dim: int
    metric: str

    @staticmethod
    def create(spark: SparkSession, dim: int, metric: str = "euclidean") -> FlatCollection:
        if dim <= 0:
            raise ValueError("dimension must be greater than 0")
        return FlatCollection(spark.createDataFrame([], POINTS), spark.createDataFrame([], "id long"), dim, metric_name(metric))

    @staticmethod
    def from_table(df: DataFrame, id_col: str, vector_col: str, dim: int, metric: str = "euclidean") -> FlatCollection:
        """Wraps a table as it is; ids must be unique and vectors of the dimension (validate() checks that)."""
        points = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<float>").alias("vector"))
        return FlatCollection(points, df.sparkSession.createDataFrame([], "id long"), dim, metric_name(metric))

    @property
    def spark(self) -> SparkSession:
        return self.points.sparkSession

    def validate(self) -> FlatCollection:
        """Raises for repeated or negative ids, wrong dimensions, and components that aren't finite."""
        bad = self.points.where((F.size("vector") != self.dim) | ~is_finite("vector") | (F.col("id") < 0) | F.col("id").isNull())
        if not bad.isEmpty():
            raise ValueError("a point has a wrong dimension, a negative id or a component that isn't finite")
        if not self.points.groupBy("id").count().where("count > 1").isEmpty():
            raise ValueError("an id occurs more than once")
        return self

    def live(self) -> DataFrame:
        """The points without the deleted ones."""
        return self.points.join(self.tombstones, "id", "left_anti")

    def __len__(self) -> int:
        return self.live().count()

    def total_records(self) -> int:
        return self.points.count()

    def is_empty(self) -> bool:
        return self.live().isEmpty()

    def _check(self, rows: DataFrame) -> None:
        wrong = F.col("vector").isNull() | (F.size("vector") != self.dim)
        bad = wrong | ~F.coalesce(is_finite("vector"), F.lit(False)) | F.coalesce(F.col("id") < 0, F.lit(True))
        found = rows.where(bad).select(wrong.alias("wrong")).limit(1).collect()
        if found and found[0].wrong:
            raise ValueError(f"vector dimension mismatch: expected {self.dim}")
        if found:
            raise ValueError("an id is null or negative, or a component isn't finite")

    def add(self, id: int, vector: list[float], strict: bool = False) -> FlatCollection:
        """Adds a point. A live id is an error; a deleted one comes back with the new vector, unless strict."""
        new = _rows(self.spark, [(id, vector)])
        self._check(new)
        if not self.points.where(F.col("id") == id).isEmpty():
            if strict or self.tombstones.where(F.col("id") == id).isEmpty():
                raise ValueError(f"duplicate id: {id}")
            return replace(self, points=self.points.where(F.col("id") != id).unionByName(new), tombstones=self.tombstones.where(F.col("id") != id))
        return replace(self, points=self.points.unionByName(new))

    def add_batch(self, rows: DataFrame) -> FlatCollection:
        """Adds rows(id, vector) at once, or none: ids that repeat, or that the collection has, deleted or not, are an error."""
        rows = rows.select(F.col("id").cast("long").alias("id"), F.col("vector").cast("array<float>").alias("vector"))
        self._check(rows)
        twice = rows.groupBy("id").count().where("count > 1").select("id")
        known = rows.join(self.points.select("id"), "id", "left_semi").select("id")
        if (found := twice.union(known).limit(1).collect()):
            raise ValueError(f"duplicate id: {found[0].id}")
        return replace(self, points=self.points.unionByName(rows))

    def delete(self, id: int) -> FlatCollection:
        if self.live().where(F.col("id") == id).isEmpty():
            raise ValueError(f"id not found: {id}")
        return replace(self, tombstones=self.tombstones.union(self.spark.createDataFrame([(id,)], "id long")))

    def update(self, id: int, vector: list[float]) -> FlatCollection:
        """Deletes and adds anew."""
        return self.delete(id).add(id, vector)

    def compact(self) -> FlatCollection:
        """Drops the deleted points for good."""
        return replace(self, points=self.live(), tombstones=self.spark.createDataFrame([], "id long"))

    def get_vector(self, id: int) -> list[float] | None:
        found = self.live().where(F.col("id") == id).select("vector").first()
        return None if found is None else list(found.vector)

    def clear(self) -> FlatCollection:
        return FlatCollection.create(self.spark, self.dim, self.metric)

    def search(self, query: list[float], k: int) -> DataFrame:
        """(rank, id, score) of the k nearest live points."""
        if len(query) != self.dim:
            raise ValueError(f"vector dimension mismatch: expected {self.dim}, got {len(query)}")
        return search(self.live(), query, k, self.metric)

    def search_batch(self, queries: DataFrame, k: int) -> DataFrame:
        """(qid, rank, id, score) for queries(qid, vector)."""
        return search_batch(self.live(), queries, k, self.metric)


def latest_points(ops: DataFrame) -> DataFrame:
    """The live points after an operation log ops(seq, op, id, vector): each id's last operation counts, `delete` removes.

    One aggregate by id with map-side partial maxima; no window over an id's history.
    """
    last = ops.groupBy("id").agg(F.max_by(F.struct("op", "vector"), "seq").alias("last"))
    return last.where("last.op <> 'delete'").select("id", F.col("last.vector").alias("vector"))
