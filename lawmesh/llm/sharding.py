"""Sharding by a consistent-hash ring with virtual nodes and bounded loads."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lawmesh.llm.common import settle

RING = 1 << 16


def ring_arcs(spark, n_shards: int, vnodes: int, seed: int) -> DataFrame:
    """arc, slot (its end on the ring), turn: the shards in clockwise order from there."""
    points = (
        spark.range(n_shards * vnodes, numPartitions=1)
        .select(
            F.floor(F.col("id") / vnodes).cast("int").alias("shard"),  # a shard's points don't depend on the others
            F.pmod(F.xxhash64(F.lit(seed), F.floor(F.col("id") / vnodes), F.col("id") % vnodes), F.lit(RING)).alias("slot"),
        )
        .groupBy("slot")
        .agg(F.min("shard").alias("shard"))
    )
    ring = points.agg(F.array_sort(F.collect_list(F.struct("slot", "shard"))).alias("ring"))
    turned = "array_distinct(transform(concat(slice(ring, arc + 1, size(ring)), slice(ring, 1, arc)), p -> p.shard))"
    return ring.select("ring", F.posexplode("ring").alias("arc", "point")).select(
        "arc",
        F.col("point.slot").alias("slot"),
        F.expr("ring[greatest(arc - 1, 0)].slot").alias("before"),
        F.expr(turned).alias("turn"),
    )


def shard_documents(
    docs: DataFrame,
    n_shards: int = 8,
    vnodes: int = 256,
    parts: int = 16,
    slack: float = 0.0005,
    seed: int = 17,
) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard.

    A document's id is hashed onto a ring of 65,536 places and belongs to the
    next virtual node clockwise. The documents of one arc between virtual
    nodes are dealt into `parts` groups by a hash of doc_id, so that where the
    rows lie in the input decides nothing; only the rows of an id that repeats
    and has more than a group's share of all bytes are dealt by their places,
    as such an id must not be one unit (there are at most as many such ids as
    groups, and they are broadcast). A shard is full from
    (1 + slack) x total / n_shards bytes on; the groups that find it full go on
    clockwise to the next other shard. All shards can't be full before all
    groups are placed, so balance holds up to slack and one group. The law is
    `bytes`. There are at most n_shards x vnodes x parts groups, whatever the
    input: only they are walked round the ring, the rows are joined to them.

    Null text: size 1, crc32 of nothing. Null doc_id: hashed as one more id.
    Repeated rows: each gets a slot of its own. Empty input: no rows. Further
    columns are ignored.
    """
    spark = docs.sparkSession
    arcs = settle(ring_arcs(spark, n_shards, vnodes, seed))
    last = F.lit(RING - 1)
    # the places after the last point belong to the first one
    places = arcs.select(
        "arc",
        F.explode(
            F.when(
                F.col("arc") == 0,
                F.concat(F.sequence(F.lit(0), F.col("slot").cast("int")), F.sequence(F.lit(0), last.cast("int"))),
            ).otherwise(F.sequence((F.col("before") + 1).cast("int"), F.col("slot").cast("int")))
        ).alias("place"),
    )
    places = places.groupBy("place").agg(F.max("arc").alias("arc"))
    told = settle(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
            F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
            F.pmod(F.xxhash64("doc_id"), F.lit(RING)).cast("int").alias("place"),
            F.monotonically_increasing_id().alias("at"),
        )
        .join(F.broadcast(places), "place")  # RING rows
        .drop("place")
    )
    sums = told.groupBy("doc_id").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
    units = n_shards * vnodes * parts
    total = told.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    heavy = settle(sums.where((F.col("n") > 1) & (F.col("bytes") * units > total)).select(F.col("doc_id").alias("heavy_id"), F.lit(True).alias("heavy")))
    by = F.when(F.col("heavy"), F.col("at")).otherwise(F.xxhash64(F.lit(seed + 1), "doc_id"))
    rows = (
        told.join(F.broadcast(heavy), F.col("doc_id").eqNullSafe(F.col("heavy_id")), "left")  # at most n_shards x vnodes x parts ids
        .withColumn("part", F.pmod(by, F.lit(parts)).cast("int"))
        .drop("heavy_id", "heavy")
    )
    groups = rows.groupBy("arc", "part").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
    state = settle(groups.join(F.broadcast(arcs.select("arc", "turn")), "arc").withColumn("shard", F.lit(None).cast("int")))
    room = (1 + slack) * total / n_shards
    for k in range(n_shards):
        if not state.where("shard is null").limit(1).count():
            break
        loads = state.where("shard is not null").groupBy(F.col("shard").alias("want")).agg(F.sum("bytes").alias("load"))
        waiting = state.where("shard is null").withColumn("want", F.col("turn")[k])
        earlier = Window.partitionBy("want").orderBy(F.desc("bytes"), "arc", "part").rowsBetween(
            Window.unboundedPreceding, -1
        )
        placed = (
            waiting.join(F.broadcast(loads), "want", "left")  # n_shards rows
            .withColumn("filled", F.coalesce("load", F.lit(0)) + F.coalesce(F.sum("bytes").over(earlier), F.lit(0)))
            .withColumn("shard", F.when(F.col("filled") < room, F.col("want")))
        )
        state = settle(state.where("shard is not null").unionByName(placed.select(state.columns)))
    before = Window.partitionBy("shard").orderBy("arc", "part").rowsBetween(Window.unboundedPreceding, -1)
    homes = state.select(
        "arc", "part", "shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first_slot")
    )
    within = Window.partitionBy("arc", "part").orderBy("doc_id", "text_crc32", "at")
    return rows.join(F.broadcast(homes), ["arc", "part"]).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("first_slot") + F.row_number().over(within) - 1).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
