"""Files of this subpackage's own formats: executors write them through Arrow's file systems, Spark reads them back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def put(folder: str, name: str, blob: bytes) -> str:
    """Writes one file into a shared folder and returns its name, which no other attempt uses.

    A task that is run again writes another file; only names that reach the result of the job count, so what a
    lost attempt left behind is never read.
    """
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}" if folder.startswith("/") else folder.replace("file:/", "file:///", 1))
    system.create_dir(path, recursive=True)
    name = f"{name}-{uuid.uuid4().hex}"
    with system.open_output_stream(f"{path}/{name}") as out:
        out.write(blob)
    return name


def read_files(spark: SparkSession, folder: str) -> DataFrame:
    """(name, content) of every file of a folder; empty where nothing was written."""
    from pyspark.sql import functions as F

    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], "name string, content binary")
    return spark.read.format("binaryFile").load(folder).select(F.element_at(F.split("path", "/"), -1).alias("name"), "content")
