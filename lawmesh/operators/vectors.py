"""A stored vector index: vectors by their nearest pivot, and exact questions that skip what the triangle inequality rules out."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lawmesh.operators.retrieve import cosine

#: What rounding to 6 digits, single precision and sums in another order may move a distance by, with room to spare.
SLACK = 1e-3


@dataclass(frozen=True)
class Index:
    rows: DataFrame
    cells: DataFrame
    pivots: np.ndarray


def pivots_of(sample: np.ndarray, n: int) -> np.ndarray:
    """n vectors of the sample far from each other: each the farthest from those before, the first of the sample first."""
    out = [sample[0]]
    least = np.linalg.norm(sample - out[0], axis=1)
    while len(out) < n and least.max() > 0:
        out.append(sample[int(least.argmax())])
        least = np.minimum(least, np.linalg.norm(sample - out[-1], axis=1))
    return np.stack(out)


def build(items: DataFrame, path: str, n: int = 32, sampled: int = 4096, key: str = "id", group: str = "label", vector: str = "embedding") -> None:
    """Items into path: vectors at length 1 lie in a folder for each pivot, sorted by their distance to it, which Parquet's statistics tell.

    The pivots come from `sampled` vectors, those of the least hashes of their
    keys. Vectors that are null, zero, not finite or not as long as most of the
    sample are not indexed: they have no cosine with a question that is.
    """
    spark = items.sparkSession
    rows = items.select(F.col(key).alias("id"), F.col(group).alias("label"), F.col(vector).cast("array<double>").alias("v")).where("v is not null and size(v) > 0")
    rows = rows.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0))
    some = [r.v for r in rows.orderBy(F.xxhash64("id"), "id").select("v").limit(sampled).collect()]
    lengths = [len(v) for v in some]
    dims = max(set(lengths), key=lengths.count) if lengths else 0
    sample = np.array([v for v in some if len(v) == dims]) if some else np.zeros((1, 1))
    pivots = pivots_of(sample / np.maximum(np.linalg.norm(sample, axis=1, keepdims=True), 1e-300), n) if some else np.zeros((0, 0))
    shared = spark.sparkContext.broadcast(pivots)

    def near(batches):
        for batch in batches:
            flat = batch.column("v").flatten().to_numpy(zero_copy_only=False)
            v = flat.reshape(len(batch), -1) if len(batch) else np.zeros((0, dims))
            d = np.sqrt(np.maximum(0, 2 - 2 * (v / np.linalg.norm(v, axis=1, keepdims=True)) @ shared.value.T))
            pivot = d.argmin(axis=1)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), batch.column("v"), pa.array(d[np.arange(len(v)), pivot]), pa.array(pivot.astype(np.int32))], names=["id", "label", "v", "d", "pivot"])

    id_kind, label_kind = (items.schema[c].dataType.simpleString() for c in (key, group))
    placed = rows.where(F.size("v") == dims).mapInArrow(near, f"id {id_kind}, label {label_kind}, v array<double>, d double, pivot int")
    writer = placed.repartition("pivot", F.pmod(F.xxhash64("id"), F.lit(4))).sortWithinPartitions("pivot", "d").write.mode("overwrite")
    (writer.partitionBy("pivot") if some else writer).parquet(f"{path}/rows")  # without rows there are no folders, and a file tells the columns
    cells = spark.read.schema(placed.schema).parquet(f"{path}/rows").groupBy("pivot", "label").agg(F.count("*").alias("n"), F.min("d").alias("low"), F.max("d").alias("high"))
    cells.coalesce(1).write.mode("overwrite").parquet(f"{path}/cells")
    spark.createDataFrame([(k, p.tolist()) for k, p in enumerate(pivots)], "pivot int, v array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/pivots")


def load(spark: SparkSession, path: str) -> Index:
    """The index; its pivots, at most n of them, come to the driver."""
    found = spark.read.parquet(f"{path}/pivots").orderBy("pivot").collect()
    return Index(spark.read.parquet(f"{path}/rows"), spark.read.parquet(f"{path}/cells"), np.array([r.v for r in found]))


def top(index: Index, query: list[float], k: int, digits: int = 6) -> DataFrame:
    """id, label, score, rank: the k nearest of each label by cosine, as `vector_top` gives them, from the cells that can hold them.

    A cell's vectors are at least |distance to its pivot - the question's| away.
    Those nearest by that bound, enough to hold k of a label, are read first
    and give its k-th score; then the other cells are read that can hold a
    score as high, and of each only the rows at a distance from the pivot
    that can.
    """
    spark, q = index.rows.sparkSession, np.array(query, dtype=float)
    length = np.linalg.norm(q)
    if not len(index.pivots) or len(q) != index.pivots.shape[1] or not length > 0:
        return scored(index.rows.where("false"), query, digits).withColumn("rank", F.lit(0)).limit(0)
    to = np.sqrt(np.maximum(0, 2 - 2 * index.pivots @ (q / length)))
    told = spark.createDataFrame([(i, float(x)) for i, x in enumerate(to)], "pivot int, q double")
    cells = index.cells.join(F.broadcast(told), "pivot")  # a row for each pivot
    bound = F.greatest(F.lit(0.0), F.col("q") - F.col("high"), F.col("low") - F.col("q"))
    before = Window.partitionBy("label").orderBy("bound", "pivot").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("bound", bound).withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0)) < k)
    cells = cells.select("pivot", "label", "bound", "first", "q").collect()  # pivots x labels rows
    first = ranked(scored(of_cells(index, [c for c in cells if c["first"]]), query, digits), k)
    least = {r["label"]: r["score"] for r in first.where(F.col("rank") == k).select("label", "score").collect()}
    reach = {c["label"]: np.sqrt(max(0.0, 4 - 4 * least[c["label"]])) + SLACK if c["label"] in least else 3.0 for c in cells}
    wanted = [c for c in cells if c["bound"] <= reach[c["label"]]]
    return ranked(scored(of_cells(index, wanted, reach), query, digits), k)


def of_cells(index: Index, cells, reach: dict | None = None) -> DataFrame:
    """The rows of some cells; the folders of other pivots are not read, nor row groups out of reach."""
    hit = F.lit(False)
    for c in cells:
        one = (F.col("pivot") == c["pivot"]) & F.col("label").eqNullSafe(F.lit(c["label"]))
        if reach:
            r = reach[c["label"]]
            one = one & (F.col("d") >= c["q"] - r) & (F.col("d") <= c["q"] + r)
        hit = hit | one
    return index.rows.where(F.col("pivot").isin([c["pivot"] for c in cells])).where(hit)


def scored(rows: DataFrame, query: list[float], digits: int) -> DataFrame:
    q = F.array(*(F.lit(float(x)) for x in query))
    return rows.select("id", "label", F.round((1 + cosine(F.col("v"), q)) / 2, digits).alias("score")).where("score is not null")


def ranked(rows: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("label").orderBy(F.desc("score"), "id")
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
