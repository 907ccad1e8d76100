"""The property graph as two DataFrames, and what is counted, merged and checked on them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lawmesh.schema import EDGE, EDGE_TYPES, LABELS, NODE, UNIQUE


@dataclass(frozen=True)
class Graph:
    nodes: DataFrame
    edges: DataFrame

    def label(self, label: str) -> DataFrame:
        """A label scan; prunes partitions where nodes are stored by label."""
        if label not in LABELS:
            raise ValueError(f"no label {label!r}")
        return self.nodes.where(F.col("label") == label)

    def type(self, *types: str) -> DataFrame:
        if bad := set(types) - set(EDGE_TYPES):
            raise ValueError(f"no edge types {sorted(bad)}")
        return self.edges.where(F.col("type").isin(*types)) if types else self.edges

    def both_ways(self, *types: str) -> DataFrame:
        """Each edge from both of its ends; a loop once."""
        e = self.type(*types)
        back = e.where("src <> dst").withColumns({"src": F.col("dst"), "dst": F.col("src")})
        return e.unionByName(back)


def as_nodes(df: DataFrame, **values) -> DataFrame:
    """df with all columns of a node: those it has, those given, null for the rest."""
    given = {k: v if isinstance(v, Column) else F.lit(v) for k, v in values.items()}
    return df.select(
        *(
            (given[f.name] if f.name in given else F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in NODE
        )
    )


def as_edges(df: DataFrame, kind: str, evidence=None, reason=None, confidence=None, once: bool = False) -> DataFrame:
    """(src, dst) rows as edges, each once; without properties only the ids are shuffled. With `once` they are so already, and nothing is."""
    eid = F.concat_ws("|", F.lit(kind), "src", "dst").alias("eid")
    if evidence is None and reason is None and confidence is None:
        rows = df.select("src", "dst") if once else df.select("src", "dst").distinct()
        return rows.select(eid, "src", "dst", F.lit(kind).alias("type"), F.lit(None).cast(EDGE["props"].dataType).alias("props")).to(EDGE)
    props = F.struct(
        (F.lit(None) if evidence is None else evidence).cast("string").alias("evidence"),
        (F.lit(None) if reason is None else reason).cast("string").alias("reason"),
        (F.lit(None) if confidence is None else confidence).cast("double").alias("confidence"),
    )
    rows = df.withColumn("props", props)
    if not once:
        rows = rows.groupBy("src", "dst").agg(F.min("props").alias("props"))
    return rows.select(eid, "src", "dst", F.lit(kind).alias("type"), "props").to(EDGE)


def keep_first(df: DataFrame, key, order="ord") -> DataFrame:
    """The first row of each key in the given order; rows with a null or empty key go."""
    key = F.col(key) if isinstance(key, str) else key
    keyed = df.withColumn("_key", key).where("_key is not null and _key <> ''")
    w = Window.partitionBy("_key").orderBy(*([order] if isinstance(order, str) else order))
    return keyed.withColumn("_row", F.row_number().over(w)).where("_row = 1").drop("_key", "_row")


def keep_last(df: DataFrame, key: str, order: str = "ord") -> DataFrame:
    """Upsert: of rows with one key the last is written; one aggregation, without a sort."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*rest), F.col(order)).alias("_v")).select(key, "_v.*").select(*df.columns)


def upsert(stored: DataFrame, new: DataFrame, key: str = "id", on_create: bool = False) -> DataFrame:
    """Stored rows overwritten by new ones of their key, or with on_create only joined by those of other keys."""
    if on_create:
        return stored.unionByName(new.join(stored.select(key), key, "left_anti"))
    return stored.join(new.select(key), key, "left_anti").unionByName(new)


def totals(g: Graph) -> DataFrame:
    """total_nodes, total_relationships; zeros for an empty graph."""
    n = g.nodes.agg(F.count("*").alias("total_nodes"), F.lit(0).alias("total_relationships"))
    e = g.edges.agg(F.lit(0).alias("total_nodes"), F.count("*").alias("total_relationships"))
    return n.unionAll(e).agg(F.sum("total_nodes").alias("total_nodes"), F.sum("total_relationships").alias("total_relationships"))


def count_by_label(g: Graph) -> DataFrame:
    return g.nodes.groupBy("label").agg(F.count("*").alias("count")).orderBy(F.desc("count"), "label")


def count_by_type(g: Graph) -> DataFrame:
    return g.edges.groupBy("type").agg(F.count("*").alias("count")).orderBy(F.desc("count"), "type")


def duplicates(g: Graph) -> DataFrame:
    """label, value, count of what should be unique and isn't."""
    key = F.coalesce(*(F.when(F.col("label") == label, F.col(c)) for label, c in UNIQUE.items()))
    return (
        g.nodes.withColumn("value", key).where("value is not null").groupBy("label", "value").agg(F.count("*").alias("count")).where("count > 1")
    )


def verify(df: DataFrame, schema) -> list[str]:
    """What df lacks of a schema, or has with another type."""
    have = {f.name: f.dataType for f in df.schema}
    return [f.name for f in schema if have.get(f.name) != f.dataType]


def degree(g: Graph, label: str, limit: int = 20) -> DataFrame:
    """Nodes of a label by edges in, out and in total; a loop counts both ways.

    A graph has each edge once, so the edges are read once and their ends
    counted, in the tasks first; only ids are shuffled.
    """
    ends = F.explode(F.array(F.struct(F.col("src").alias("id"), F.lit(1).alias("out_degree"), F.lit(0).alias("in_degree")), F.struct(F.col("dst").alias("id"), F.lit(0).alias("out_degree"), F.lit(1).alias("in_degree"))))
    both = g.edges.select(ends.alias("e")).select("e.*")
    both = both.groupBy("id").agg(F.sum("in_degree").alias("in_degree"), F.sum("out_degree").alias("out_degree"))
    return (
        g.label(label)
        .join(both, "id")
        .select("id", F.coalesce("text", "description", "name", "term").alias("text"), "in_degree", "out_degree", (F.col("in_degree") + F.col("out_degree")).alias("total_degree"))
        .orderBy(F.desc("total_degree"), "id")
        .limit(limit)
    )


def communities(g: Graph, min_size: int = 3, limit: int = 10, shown: int = 10) -> DataFrame:
    """Processes by how many requirements apply to them, with the first of these by id.

    The count needs no list, and the list keeps `shown` ids while it is made,
    so a process of any size fits.
    """
    pairs = g.type("APPLIES_TO").select("src", "dst").distinct()
    pairs = pairs.join(g.label("Requirement").select(F.col("id").alias("src")), "src", "left_semi")
    size = pairs.groupBy("dst").agg(F.count("*").alias("requirement_count")).where(F.col("requirement_count") >= min_size)
    procs = g.label("Process").select(F.col("id").alias("dst"), F.col("name").alias("process"))
    top = size.join(procs, "dst").orderBy(F.desc("requirement_count"), "dst").limit(limit)
    w = Window.partitionBy("dst").orderBy("src")
    first = pairs.join(F.broadcast(top.select("dst")), "dst", "left_semi")  # at most `limit` rows
    first = first.withColumn("k", F.row_number().over(w)).where(F.col("k") <= shown)
    lists = first.groupBy("dst").agg(F.array_sort(F.collect_list("src")).alias("requirements"))
    return top.join(lists, "dst").select(F.col("dst").alias("process_id"), "process", "requirement_count", F.array_join("requirements", ",").alias("requirements"))


def part_of(df: DataFrame, order, start: int, count: int) -> DataFrame:
    """`count` rows from place `start` on, in an order that must tell rows apart."""
    return df.orderBy(*([order] if isinstance(order, str) else order)).offset(start).limit(count)


def stamped(nodes: DataFrame, at: str) -> DataFrame:
    """Nodes with a given time: of creation where they have none, of their update always."""
    time = F.lit(at).cast("timestamp")
    return nodes.withColumns({"created_at": F.coalesce("created_at", time), "updated_at": time})
