"""A stored graph that grows by batches of entities: each rule is evaluated for what a batch adds, not anew for all."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lawmesh.operators import merge
from lawmesh.operators.build import (
    IDENTITY,
    applies_to,
    canonical,
    conflicts_apart,
    contains_by_name,
    contains_by_source,
    defines,
    directive_nodes,
    entity_nodes,
    exempt_from,
    flat,
    requires_between,
    same,
    source_nodes,
    supersedes_in,
    supersessions,
)
from lawmesh.operators.graph import Graph
from lawmesh.operators.store import exists, small, written
from lawmesh.schema import EDGE, NODE

LAYOUT = {"parts": 8, "buckets": 4}
#: Folders beside the merged edges: conflicts that only one batch can make, and the ends of those that the merged edges have again.
FIRST, REPLACED = "conflicts", "replaced"
FIRST_SCHEMA = T.StructType([f for f in EDGE if f.name != "eid"])


def known(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """The entities of earlier batches with the ids of their nodes; none where there is no batch yet."""
    return spark.read.schema(like.schema).parquet(f"{path}/entities").select(*like.columns) if exists(spark, f"{path}/entities") else like.where("false")


def placed(entities: DataFrame, old: DataFrame, label: str) -> DataFrame:
    """A batch's entities of a label with the ids of their nodes: those of an earlier text, term or name keep its id."""
    made_of, unique = IDENTITY[label]
    own = canonical(entities, label).withColumn("met", F.lit(False))
    if not unique:
        return own
    first = old.where(F.col("entity_type") == label).groupBy(same(unique).alias("same")).agg(F.min("id").alias("had"))
    own = own.withColumn("same", same(unique)).join(first, "same", "left")
    return own.withColumns({"met": F.col("had").isNotNull(), "id": F.coalesce("had", "id")}).drop("same", "had")


def union(frames) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def add_entities(spark: SparkSession, path: str, entities: DataFrame, batch: str) -> tuple[int, int]:
    """A batch of entities into the graph stored at path, which is then that of all batches together. -> nodes and edges that changed it.

    What stands for a text, term or name is the first entity that has it, so a
    batch's `ord` must come after those before; a node's id stays. A rule
    between two kinds is evaluated for the new of one with all of the other
    and the old of the one with the new of the other; supersessions are few
    and are looked up again. A batch named before changes nothing; one that
    broke off may be run again, as its entities are written last.

    Conflicts of which one requirement has no row but one of the batch can't
    have been made before: they lie beside the merged edges as their tasks
    make them, a folder a batch, and are neither shuffled nor looked up.
    """
    nodes, edges = (merge.stored(spark, f"{path}/{n}", schema, key, **LAYOUT) for n, schema, key in (("nodes", NODE, "id"), ("edges", EDGE, "eid")))
    if exists(spark, f"{path}/entities/batch={batch}"):
        return 0, 0
    entities = written(entities)
    like = flat(entities).withColumn("id", F.lit(""))
    old = known(spark, path, like).where(F.col("entity_type").isin(*IDENTITY))
    new = written(union(placed(entities, old, label).select(*like.columns, "met") for label in IDENTITY))
    whole = old.unionByName(new.drop("met"))

    # nodes: of what is met for the first time; a regulation's own entity stands over what is known of its source
    def first_met(label: str) -> DataFrame:
        return entity_nodes(entities, label).join(new.where((F.col("entity_type") == label) & ~F.col("met")).select("id").distinct(), "id", "left_semi").select(*NODE.names)

    directives = directive_nodes(supersessions(flat(entities).where("entity_type = 'Requirement'")))
    made = union([source_nodes(entities), directives, *(first_met(label) for label in IDENTITY if label not in ("CrossReference", "Regulation"))])
    changed = merge.upsert_stored(nodes, written(made), None, on_create=True)
    own = first_met("Regulation").join(nodes.rows().where("label = 'Regulation' and ord >= 0").select("id"), "id", "left_anti").select(*NODE.names)
    changed += merge.upsert_stored(nodes, written(own.unionByName(entity_nodes(entities, "CrossReference"))), None)

    def of(rows: DataFrame, label: str) -> DataFrame:
        return rows.where(F.col("entity_type") == label).drop("met")

    def across(rule, left: str, right: str) -> list[DataFrame]:
        return [rule(entities, made={left: of(a, left), right: of(b, right)}) for a, b in ((new, whole), (old, new))]

    now = nodes.rows()
    mine = written(now.join(small(new.select("id").unionByName(source_nodes(entities).select("id")).distinct()), "id", "left_semi"))
    regulations, requirements = now.where("label = 'Regulation'"), now.where("label = 'Requirement'")
    found = [
        contains_by_source(mine.where("label = 'Regulation'").unionByName(requirements)), contains_by_source(regulations.unionByName(mine.where("label = 'Requirement'"))),
        *across(contains_by_name, "Regulation", "Requirement"), *across(applies_to, "Process", "Requirement"), *across(defines, "Definition", "Requirement"), *across(exempt_from, "Exemption", "Requirement"),
        requires_between(of(new, "Requirement"), of(whole, "Requirement")), requires_between(of(old, "Requirement"), of(new, "Requirement")),
        supersedes_in(whole, now, of(whole, "Regulation")),
    ]
    both = of(old, "Requirement").withColumn("fresh", F.lit(False)).unionByName(of(new, "Requirement").withColumn("fresh", F.lit(True)))
    again = add_conflicts(spark, path, both, written(requirements.select("id")), batch)
    found += [] if again is None else [again]
    found = written(union(found))
    # of an edge that is told more than once the least properties stay
    before = edges.rows().join(found.select("eid").distinct(), "eid", "left_semi")
    found = found.unionByName(before).groupBy("eid", "src", "dst", "type").agg(F.min("props").alias("props"))
    ids = now.select("id")
    found = found.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    links = merge.upsert_stored(edges, written(found.select(*EDGE.names)), None) + spark.read.schema(FIRST_SCHEMA).parquet(f"{path}/{FIRST}/batch={batch}").count()
    new.select(*like.columns).write.mode("overwrite").parquet(f"{path}/entities/batch={batch}")
    return changed, links


def add_conflicts(spark: SparkSession, path: str, requirements: DataFrame, ids: DataFrame, batch: str) -> DataFrame | None:
    """The conflicts with a fresh requirement that no other batch can make, put beside the merged edges; the others are returned, to be merged.

    Of these, what an earlier batch has put there stays as it was, or goes to
    the merged edges if its properties are less now.
    """
    first, again = conflicts_apart(requirements, ids)
    first.drop("eid").write.mode("overwrite").parquet(f"{path}/{FIRST}/batch={batch}")
    if again is None:
        return None
    again = written(again)
    had = first_edges(spark, path, batch).join(small(again.select("src", "dst")), ["src", "dst"], "left_semi")
    again = written(again.join(had.groupBy("src", "dst").agg(F.min("props").alias("had")), ["src", "dst"], "left").where("had is null or props < had"))
    again.where("had is not null").select("src", "dst").write.mode("overwrite").parquet(f"{path}/{REPLACED}/batch={batch}")
    return again.drop("had")


def first_edges(spark: SparkSession, path: str, but: str | None = None) -> DataFrame:
    """The conflicts that lie beside the merged edges, with their batch, without those that the merged edges have instead; but for what one batch did."""
    schema = T.StructType([*FIRST_SCHEMA, T.StructField("batch", T.StringType())])
    if not exists(spark, f"{path}/{FIRST}"):
        return spark.createDataFrame([], schema)
    others = F.lit(True) if but is None else F.col("batch") != but
    rows = spark.read.schema(schema).parquet(f"{path}/{FIRST}").where(others)
    if exists(spark, f"{path}/{REPLACED}"):
        gone = spark.read.schema("src string, dst string, batch string").parquet(f"{path}/{REPLACED}").where(others).select("src", "dst")
        rows = rows.join(small(gone), ["src", "dst"], "left_anti")
    return rows.select(*schema.names)


def grown_graph(spark: SparkSession, path: str) -> Graph:
    g = merge.merged_graph(spark, path, **LAYOUT)
    return Graph(g.nodes, g.edges.unionByName(first_edges(spark, path).drop("batch").withColumn("eid", F.concat_ws("|", "type", "src", "dst")).to(EDGE)))
