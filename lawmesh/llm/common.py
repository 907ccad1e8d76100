"""What several operators share: reading tables, cutting lineage, connected components."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; a temporary one only where none is named, on one machine."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("name a folder that all executors share in spark.checkpoint.dir")
    if not getattr(spark, "_lawmesh_dir", None):
        spark._lawmesh_dir = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return spark._lawmesh_dir


def settle(df: DataFrame) -> DataFrame:
    """Writes df as Parquet into the shared folder and reads it back.

    This cuts the lineage: later steps survive lost executors without running
    what made df again, and ids drawn from row positions stay as they are.
    """
    path = f"{shared_dir(df.sparkSession)}/lawmesh-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def broadcast_value(df: DataFrame, value):
    return df.sparkSession.sparkContext.broadcast(value)


_kept: dict = {}


def kept(key, make):
    """What a Python worker keeps between tasks, one thing at a time: workers are reused by later operators."""
    if key not in _kept:
        _kept.clear()
        _kept[key] = make()
    return _kept[key]


def give_back() -> None:
    """Freed memory goes back to the system, else a reused worker holds the most it ever needed."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # where the C library has no such call
        ctypes.CDLL(None).malloc_trim(0)


def slices(batch: pa.RecordBatch, rows: int, most: int):
    """The batch in slices of at most `rows` rows and, but for a single longer row, `most` bytes."""
    for at in range(0, batch.num_rows, rows):
        waiting = [batch.slice(at, rows)]
        while waiting:
            some = waiting.pop()
            n = some.num_rows
            if n > 1 and some.nbytes > most:
                waiting += [some.slice(n // 2), some.slice(0, n // 2)]
            else:
                yield some


def map_arrow(df: DataFrame, make, schema: str, rows: int = 512, most: int = 16 << 20) -> DataFrame:
    """mapInArrow over slices of at most `rows` rows and about `most` bytes.

    make() runs once in each task and returns the function that takes a
    RecordBatch and gives a dict of columns, or a list of such dicts; what
    make() returns may have a finish() for what is left at the end.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    spark_schema = df.sparkSession.createDataFrame([], schema).schema
    arrow = to_arrow_schema(spark_schema)

    def run(batches):
        step = make()

        def out(got):
            for columns in got if isinstance(got, list) else [got]:
                made = pa.RecordBatch.from_arrays([pa.array(columns[f.name], type=f.type) for f in arrow], schema=arrow)
                if made.num_rows:
                    yield made

        for batch in batches:
            for some in slices(batch, rows, most):
                yield from out(step(some))
        if hasattr(step, "finish"):
            yield from out(step.finish())
        del step
        give_back()

    return df.mapInArrow(run, spark_schema)


def components(links: DataFrame) -> DataFrame:
    """(a, b) links between longs -> (node, component): the smallest node that links reach.

    Alternating large-star and small-star steps; each halves paths roughly, so
    their number grows with the logarithm of the longest path. Every step is
    an aggregation and a join on the node; no group is gathered anywhere.
    """

    edges = settle(
        links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    )
    before = edges.count()
    while before:
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(least, "u")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .where("u <> v")
            .unionAll(least.select("u", F.col("m").alias("v")))
            .distinct()
        )
        was, edges = edges, settle(small)
        after = edges.count()
        if after == before and not edges.join(was, ["u", "v"], "left_anti").limit(1).count():
            break
        before = after
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
