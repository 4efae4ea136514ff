"""Folders that driver and executors share, and small JSON files in them."""

from __future__ import annotations

import json
import tempfile
import uuid

from pyspark.sql import SparkSession


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A new folder name below spark.checkpoint.dir; without that setting, below a temporary folder, if Spark is local."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="halyard-")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def file_system(spark: SparkSession, path: str):
    """Hadoop's file system and path of a URI."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def write_json(spark: SparkSession, path: str, value: dict) -> None:
    fs, p = file_system(spark, path)
    out = fs.create(p, True)
    out.write(bytearray(json.dumps(value).encode()))
    out.close()


def read_json(spark: SparkSession, path: str) -> dict:
    fs, p = file_system(spark, path)
    stream = fs.open(p)
    raw = bytes(stream.readAllBytes())
    stream.close()
    return json.loads(raw)
