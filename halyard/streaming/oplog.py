"""Continuous ingestion of operations into a table, exactly once by sequence number."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from halyard.operators.collection import latest_points
from halyard.plans.catalog import OPS


def read_ops(spark: SparkSession, folder: str, files_per_trigger: int | None = None) -> DataFrame:
    """A stream of ops(seq, op, id, vector) from Parquet files that appear in a folder."""
    reader = spark.readStream.schema(OPS)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(folder)


def ingest(ops: DataFrame, target: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Appends a stream of operations to target. A batch that runs again replaces its own folder, so nothing is written twice."""

    def write(batch: DataFrame, number: int) -> None:
        batch.dropDuplicates(["seq"]).write.mode("overwrite").parquet(f"{target}/batch={number}")

    writer = ops.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def current_points(spark: SparkSession, target: str) -> DataFrame:
    """The live points after all ingested operations; an operation that came more than once counts once."""
    ops = spark.read.schema(OPS + ", batch int").parquet(target).groupBy("seq").agg(F.min_by(F.struct("op", "id", "vector"), "batch").alias("o"))
    return latest_points(ops.select("seq", "o.op", "o.id", "o.vector"))
