"""The given tables seen as a graph, as documents and as entities; the same views in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lawmesh.operators.graph import Graph, as_edges, as_nodes
from lawmesh.operators.store import exists, new_path
from lawmesh.schema import PROPERTIES
from lawmesh.sources.files import load_graph, save_graph


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def graph(spark: SparkSession, sf_dir: str) -> Graph:
    """Orders are requirements, parts processes, suppliers definitions, customers and nations sections, regions regulations.

    A line item says that its order applies to its part and that its supplier
    defines its order; an order requires the customer's next one, and is in
    conflict with it where one is mandatory and the other isn't.
    """
    t = lambda n: table(spark, sf_dir, n)
    o = F.concat(F.lit("o"), "o_orderkey")
    nodes = as_nodes(
        t("orders"), id=o, label="Requirement", text=F.concat_ws(" ", "o_orderpriority", F.lit("order"), "o_orderkey"), source_doc=F.concat(F.lit("C"), "o_custkey"),
        citation_text=F.concat(F.lit("C"), "o_custkey", F.lit(" O"), "o_orderkey"), category=F.col("o_orderstatus"), severity=F.col("o_orderpriority"),
        scope=F.concat(F.lit("status "), "o_orderstatus"), mandatory=F.col("o_totalprice") > 150000,
    )
    more = (
        as_nodes(t("part"), id=F.concat(F.lit("p"), "p_partkey"), label="Process", name=F.col("p_name"), text=F.col("p_type"), process_type=F.col("p_type"), source_doc=F.col("p_brand")),
        as_nodes(t("supplier"), id=F.concat(F.lit("s"), "s_suppkey"), label="Definition", term=F.col("s_name"), text=F.concat(F.lit("supplier of nation "), "s_nationkey"), citation_text=F.concat(F.lit("S"), "s_suppkey"), domain=F.concat(F.lit("n"), "s_nationkey")),
        as_nodes(t("customer"), id=F.concat(F.lit("c"), "c_custkey"), label="Section", name=F.col("c_name"), text=F.col("c_mktsegment"), citation_text=F.concat(F.lit("C"), "c_custkey")),
        as_nodes(t("nation"), id=F.concat(F.lit("n"), "n_nationkey"), label="Section", name=F.col("n_name"), citation_text=F.concat(F.lit("N"), "n_nationkey")),
        as_nodes(t("region"), id=F.concat(F.lit("r"), "r_regionkey"), label="Regulation", name=F.col("r_name"), citation_text=F.concat(F.lit("R"), "r_regionkey")),
    )
    more += (
        as_nodes(t("orders").where("o_orderstatus = 'P'"), id=F.concat(F.lit("x"), "o_orderkey"), label="CrossReference", text=F.concat(F.lit("order "), "o_orderkey"), source_doc=F.concat(F.lit("C"), "o_custkey"), target_doc=F.col("o_orderpriority"), target_section=F.col("o_orderstatus"), reference_type="refers"),
        as_nodes(t("part").where("p_size >= 45"), id=F.concat(F.lit("e"), "p_partkey"), label="Exemption", text=F.col("p_name"), condition=F.col("p_type"), scope=F.col("p_brand"), citation_text=F.concat(F.lit("P"), "p_partkey")),
    )
    for m in more:
        nodes = nodes.unionByName(m)
    link = lambda df, a, x, b, y: df.select(F.concat(F.lit(a), x).alias("src"), F.concat(F.lit(b), y).alias("dst"))
    later = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    price = F.col("o_totalprice") > 150000
    chain = t("orders").select("o_orderkey", F.lead("o_orderkey").over(later).alias("next"), (price != F.lead(price).over(later)).alias("differs")).where("next is not null")
    lines = t("lineitem")
    edges = as_edges(link(lines, "o", "l_orderkey", "p", "l_partkey"), "APPLIES_TO")
    for m in (
        as_edges(link(lines, "s", "l_suppkey", "o", "l_orderkey"), "DEFINES"),
        as_edges(link(chain, "o", "o_orderkey", "o", "next"), "REQUIRES"),
        as_edges(link(chain.where("differs"), "o", "o_orderkey", "o", "next"), "CONFLICTS_WITH"),
        as_edges(link(t("nation"), "r", "n_regionkey", "n", "n_nationkey"), "CONTAINS"),
        as_edges(link(t("customer"), "n", "c_nationkey", "c", "c_custkey"), "CONTAINS"),
        as_edges(link(t("orders"), "c", "o_custkey", "o", "o_orderkey"), "CONTAINS"),
    ):
        edges = edges.unionByName(m)
    return Graph(nodes, edges)


_stored: dict = {}


def stored_graph(spark: SparkSession, sf_dir: str) -> Graph:
    """`graph` saved by label and type in the shared folder, once for a session and the files as they are now; paths and neighbours read that."""
    key = (spark.sparkContext.applicationId, sf_dir, *(table(spark, sf_dir, n).select(F.max("_metadata.file_modification_time")).first()[0] for n in ("orders", "lineitem")))
    if key not in _stored or not exists(spark, f"{_stored[key]}/edges"):
        path = new_path(spark)
        save_graph(graph(spark, sf_dir), path)
        _stored.clear()
        _stored[key] = path
    return load_graph(spark, _stored[key])


SQL = """
WITH nodes AS (
  SELECT 'o' || o_orderkey AS id, 'Requirement' AS label, NULL AS name, NULL AS term, o_orderpriority || ' order ' || o_orderkey AS text, 'C' || o_custkey AS source_doc,
         'C' || o_custkey || ' O' || o_orderkey AS citation_text, o_orderstatus AS category, o_orderpriority AS severity, 'status ' || o_orderstatus AS scope,
         o_totalprice > 150000 AS mandatory, NULL AS domain, NULL AS condition, NULL AS target_doc, NULL AS target_section, NULL AS reference_type FROM orders
  UNION ALL SELECT 'p' || p_partkey, 'Process', p_name, NULL, p_type, p_brand, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM part
  UNION ALL SELECT 's' || s_suppkey, 'Definition', NULL, s_name, 'supplier of nation ' || s_nationkey, NULL, 'S' || s_suppkey, NULL, NULL, NULL, NULL, 'n' || s_nationkey, NULL, NULL, NULL, NULL FROM supplier
  UNION ALL SELECT 'c' || c_custkey, 'Section', c_name, NULL, c_mktsegment, NULL, 'C' || c_custkey, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM customer
  UNION ALL SELECT 'n' || n_nationkey, 'Section', n_name, NULL, NULL, NULL, 'N' || n_nationkey, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM nation
  UNION ALL SELECT 'r' || r_regionkey, 'Regulation', r_name, NULL, NULL, NULL, 'R' || r_regionkey, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM region
  UNION ALL SELECT 'x' || o_orderkey, 'CrossReference', NULL, NULL, 'order ' || o_orderkey, 'C' || o_custkey, NULL, NULL, NULL, NULL, NULL, NULL, NULL, o_orderpriority, o_orderstatus, 'refers' FROM orders WHERE o_orderstatus = 'P'
  UNION ALL SELECT 'e' || p_partkey, 'Exemption', NULL, NULL, p_name, NULL, 'P' || p_partkey, NULL, NULL, p_brand, NULL, NULL, p_type, NULL, NULL, NULL FROM part WHERE p_size >= 45
), chain AS (
  SELECT o_orderkey, lead(o_orderkey) OVER w AS nxt, (o_totalprice > 150000) <> (lead(o_totalprice) OVER w > 150000) AS differs
  FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)
), pairs AS (
  SELECT DISTINCT 'o' || l_orderkey AS src, 'p' || l_partkey AS dst, 'APPLIES_TO' AS type FROM lineitem
  UNION ALL SELECT DISTINCT 's' || l_suppkey, 'o' || l_orderkey, 'DEFINES' FROM lineitem
  UNION ALL SELECT 'o' || o_orderkey, 'o' || nxt, 'REQUIRES' FROM chain WHERE nxt IS NOT NULL
  UNION ALL SELECT 'o' || o_orderkey, 'o' || nxt, 'CONFLICTS_WITH' FROM chain WHERE differs
  UNION ALL SELECT 'r' || n_regionkey, 'n' || n_nationkey, 'CONTAINS' FROM nation
  UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey, 'CONTAINS' FROM customer
  UNION ALL SELECT 'c' || o_custkey, 'o' || o_orderkey, 'CONTAINS' FROM orders
), edges AS (SELECT type || '|' || src || '|' || dst AS eid, src, dst, type FROM pairs)
, both_ways AS (SELECT eid, src, dst, type FROM edges UNION ALL SELECT eid, dst, src, type FROM edges WHERE src <> dst)
"""


def requirements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as requirements: their language is the category, their quality tells whether they are mandatory."""
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return docs.select(F.col("doc_id").alias("ord"), "text", F.col("source").alias("source_doc"), F.col("lang").alias("category"), (F.col("quality") == 1).alias("mandatory"))


def entity_rows(df: DataFrame, kind: str, ord, text, source, **properties) -> DataFrame:
    """A table's rows as entities of one kind."""
    props = F.struct(*((properties.get(p, F.lit(None))).cast("boolean" if p == "mandatory" else "string").alias(p) for p in PROPERTIES))
    return df.select(
        F.lit(kind).alias("entity_type"), text.alias("text"), F.lit(None).cast("string").alias("source_chunk_id"), source.alias("source_doc"), F.lit("1").alias("section_id"),
        F.lit(None).cast("string").alias("section_heading"), props.alias("properties"), F.lit(0.9).alias("confidence"), ord.cast("long").alias("ord"),
    )


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities of all kinds: documents, benchmark items with their first words as terms, parts as processes."""
    req = requirements(spark, sf_dir)
    items, parts = table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "part")
    first = F.array_join(F.slice(F.split("text", " "), 1, 4), " ")
    return (
        entity_rows(req, "Requirement", F.col("ord"), F.col("text"), F.col("source_doc"), category=F.col("category"), mandatory=F.col("mandatory"))
        .unionByName(entity_rows(items, "Definition", F.col("item_id"), F.col("text"), F.lit("benchmark"), term=first))
        .unionByName(entity_rows(items, "Exemption", F.col("item_id"), F.col("text"), F.lit("benchmark")))
        .unionByName(entity_rows(parts, "Process", F.col("p_partkey"), F.col("p_type"), F.col("p_brand"), name=F.col("p_name")))
    )
