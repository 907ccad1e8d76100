"""Intermediate tables in the folder that the cluster shares, and joins whose small side is checked."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (spark.checkpoint.dir); a temporary one only where none is named, on one machine."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("name a folder that all executors share in spark.checkpoint.dir")
    if not getattr(spark, "_lawmesh_store", None):
        spark._lawmesh_store = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return spark._lawmesh_store


def new_path(spark: SparkSession) -> str:
    """A place in the shared folder that nothing has yet."""
    return f"{shared_dir(spark)}/lawmesh-{uuid.uuid4().hex}"


def folder(spark: SparkSession, path: str):
    """The file system of a path, and the path as that knows it."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = folder(spark, path)
    return fs.exists(at)


def written(df: DataFrame) -> DataFrame:
    """df as a Parquet table: what reads it again doesn't make it again, nor does losing an executor."""
    path = new_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame, most: int = 100_000) -> DataFrame:
    """df for the small side of a join: broadcast if it has at most so many rows, else left to a shuffle."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df
