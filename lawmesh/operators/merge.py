"""Stored tables that are merged into: an upsert rewrites the parts that it changes, and meets the stored rows without a shuffle of them."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lawmesh.operators.graph import Graph, keep_last
from lawmesh.operators.store import folder, shared_dir
from lawmesh.schema import EDGE, NODE

PART = "_part"


@dataclass(frozen=True)
class Stored:
    """A table kept by one key, in `parts` folders by its hash, and in `buckets` files of each by the key."""

    spark: SparkSession
    name: str
    path: str
    schema: StructType
    key: str
    parts: int
    buckets: int

    def rows(self) -> DataFrame:
        return self.spark.table(self.name).select(*self.schema.names)


def create(spark: SparkSession, name: str, path: str, schema: StructType, key: str, parts: int, buckets: int) -> None:
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    fs, at = folder(spark, path)
    fs.mkdirs(at)
    spark.sql(f"CREATE TABLE {name} ({columns}, `{PART}` int) USING parquet PARTITIONED BY (`{PART}`) CLUSTERED BY (`{key}`) SORTED BY (`{key}`) INTO {buckets} BUCKETS LOCATION '{path}'")


def stored(spark: SparkSession, path: str, schema: StructType, key: str = "id", parts: int = 16, buckets: int = 8) -> Stored:
    """The table at path, which is made where there is none; parts and buckets must be those that it was made with."""
    name = f"lawmesh_{uuid.uuid4().hex}"
    create(spark, name, path, schema, key, parts, buckets)
    spark.sql(f"ALTER TABLE {name} RECOVER PARTITIONS")
    return Stored(spark, name, path, schema, key, parts, buckets)


def upsert_stored(table: Stored, rows: DataFrame, order: str | None = "ord", on_create: bool = False) -> int:
    """Rows into the table: those of a key it has overwrite it, others join it; with on_create only the others count. -> rows that changed it.

    Of new rows with one key the last by `order` counts (None: keys are once
    in them). Only the new rows are shuffled: they are written by part and
    bucket as the table is, so that both are joined bucket by bucket. Parts
    without a row that is new or differs keep their files, so a second run
    writes nothing. Parts are replaced when all are written whole; a run that
    breaks off before leaves the table as it was. Rows with a null key go.
    """
    spark, key = table.spark, table.key
    rows = rows.select(*table.schema.names).where(F.col(key).isNotNull())
    if order:
        rows = keep_last(rows, key, order)
    staged = f"{table.name}_{uuid.uuid4().hex}"
    # of the table's own kind and layout, in the shared folder, so that no row of either side moves again
    create(spark, staged, f"{shared_dir(spark)}/lawmesh-{staged}", table.schema, key, table.parts, table.buckets)
    with dynamic(spark):
        placed = rows.withColumn(PART, F.pmod(F.xxhash64(key), F.lit(table.parts)).cast("int"))
        placed.repartition(table.buckets, key).write.insertInto(staged)
        spark.sql(f"ALTER TABLE {staged} RECOVER PARTITIONS")
        new, old = spark.table(staged), spark.table(table.name)
        changed = changes(new, old, table, on_create)
        touched = {r[PART]: r["n"] for r in changed.groupBy(PART).agg(F.count("*").alias("n")).collect()}  # at most `parts` rows
        if touched:
            whole = merged(new.where(F.col(PART).isin(list(touched))), old.where(F.col(PART).isin(list(touched))), table, on_create)
            whole.write.mode("overwrite").insertInto(table.name)
    spark.sql(f"DROP TABLE {staged}")
    return sum(touched.values())


class dynamic:
    """Within it, an overwrite replaces the partitions that it writes to, and joins of buckets are planned as such."""

    SETTINGS = {"spark.sql.sources.partitionOverwriteMode": "dynamic", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.sources.bucketing.autoBucketedScan.enabled": "false"}

    def __init__(self, spark: SparkSession):
        self.spark = spark

    def __enter__(self):
        self.before = {k: self.spark.conf.get(k, None) for k in self.SETTINGS}
        for k, v in self.SETTINGS.items():
            self.spark.conf.set(k, v)

    def __exit__(self, *_):
        for k, v in self.before.items():
            self.spark.conf.unset(k) if v is None else self.spark.conf.set(k, v)


def changes(new: DataFrame, old: DataFrame, table: Stored, on_create: bool) -> DataFrame:
    """The new rows that the table lacks, or with on_create those of keys that it lacks."""
    if on_create:
        return new.join(old.select(table.key), table.key, "left_anti")
    was = old.select(table.key, F.struct(*(c for c in table.schema.names if c != table.key)).alias("_was"))
    now = F.struct(*(c for c in table.schema.names if c != table.key))
    return new.join(was, table.key, "left").where(F.col("_was").isNull() | ~now.eqNullSafe(F.col("_was")))


def merged(new: DataFrame, old: DataFrame, table: Stored, on_create: bool) -> DataFrame:
    columns = [*table.schema.names, PART]
    a, b = (old, new) if on_create else (new, old)
    return a.select(*columns).unionByName(b.join(a.select(table.key), table.key, "left_anti").select(*columns))


def merge_graph(spark: SparkSession, path: str, g: Graph, on_create: bool = False, **layout) -> tuple[int, int]:
    """A graph into the one stored at path: nodes by id, edges by eid. -> nodes and edges that changed it."""
    return (
        upsert_stored(stored(spark, f"{path}/nodes", NODE, "id", **layout), g.nodes, None, on_create),
        upsert_stored(stored(spark, f"{path}/edges", EDGE, "eid", **layout), g.edges, None, on_create),
    )


def merged_graph(spark: SparkSession, path: str, **layout) -> Graph:
    return Graph(stored(spark, f"{path}/nodes", NODE, "id", **layout).rows(), stored(spark, f"{path}/edges", EDGE, "eid", **layout).rows())
