"""The query templates: each takes a graph and parameters and gives a DataFrame."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lawmesh.functions.text import any_contains, contains, severity_rank
from lawmesh.operators.graph import Graph
from lawmesh.operators.paths import directed
from lawmesh.operators.store import small, written


def named(nodes: DataFrame, prefix: str, *columns: str) -> DataFrame:
    return nodes.select(*(F.col(c).alias(f"{prefix}_{c}") for c in columns))


def hop(g: Graph, kind: str, left: DataFrame, right: DataFrame, on_left: str, on_right: str, how: str = "inner") -> DataFrame:
    """left -[kind]-> right on their id columns; with how="left" unmatched left rows stay, as an optional match."""
    edges = g.type(kind).select(F.col("src").alias(on_left), F.col("dst").alias(on_right)).distinct()
    return left.join(edges.join(right, on_right), on_left, how)


def by_severity(df: DataFrame, limit: int, ranked: bool, *ties: str) -> DataFrame:
    """Severities as strings downwards with nulls first, as the templates have it; ranked: by their scale."""
    key = severity_rank("severity") if ranked else F.col("severity")
    return df.orderBy(key.desc_nulls_first(), *ties).limit(limit)


def requirements_for_process(g: Graph, process_name: str, limit: int = 20, severity_ranked: bool = False) -> DataFrame:
    req = named(g.label("Requirement"), "req", "id", "text", "citation_text", "category", "severity", "mandatory")
    proc = named(g.label("Process").where(contains("name", process_name)), "proc", "id", "name")
    found = hop(g, "APPLIES_TO", req, proc, "req_id", "proc_id").select(
        F.col("req_text").alias("requirement"),
        F.col("req_citation_text").alias("source"),
        F.col("req_category").alias("category"),
        F.col("req_severity").alias("severity"),
        F.col("req_mandatory").alias("mandatory"),
        F.col("proc_name").alias("process"),
    )
    return by_severity(found, limit, severity_ranked, "requirement", "process")


def first_of(req: DataFrame, columns: dict[str, str], order: list, limit: int, width: int = 8) -> DataFrame:
    """Requirements whose columns, of which results are made, are among the first `limit` in an order; ties by all of the columns.

    So many rows are taken that they have `limit` different ones: what comes
    after these isn't joined with anything.
    """
    keys, n, done = [f"req_{c}" for c in columns], limit, False
    while not done:
        n *= width
        some = written(req.select(*keys).orderBy(*order, *keys).limit(n))
        first = written(some.distinct().orderBy(*order, *keys).limit(limit))
        done = first.count() >= limit or some.count() < n
    first = first.select(*(F.col(k).alias(f"{k}_") for k in keys))
    return req.join(small(first), reduce(and_, (F.col(k).eqNullSafe(F.col(f"{k}_")) for k in keys)), "left_semi")


def with_processes(g: Graph, req: DataFrame, columns: dict[str, str], name: str) -> DataFrame:
    """Requirements and the distinct names of the processes they apply to, joined by |; of the edges only those of the requirements are shuffled."""
    req = written(req)
    proc = named(g.label("Process"), "proc", "id", "name")
    edges = g.type("APPLIES_TO").select(F.col("src").alias("req_id"), F.col("dst").alias("proc_id")).join(small(req.select("req_id")), "req_id", "left_semi")
    got = req.join(edges.distinct().join(proc, "proc_id"), "req_id", "left")
    keys = [F.col(f"req_{c}").alias(a) for c, a in columns.items()]
    return got.groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_set("proc_name")), "|").alias(name))


def regulation_applicability(g: Graph, keyword: str, limit: int = 20) -> DataFrame:
    req = named(g.label("Requirement").where(any_contains(("text", "scope"), keyword)), "req", "id", "text", "citation_text", "scope")
    columns = {"text": "requirement", "citation_text": "source", "scope": "scope"}
    req = first_of(req, columns, ["req_text", "req_citation_text", "req_scope"], limit)
    return with_processes(g, req, columns, "applicable_processes").orderBy("requirement", "source", "scope").limit(limit)


def cross_references(g: Graph, source_doc: str = "", target_doc: str = "", limit: int = 20) -> DataFrame:
    return (
        g.label("CrossReference")
        .where(contains("source_doc", source_doc) | contains("target_doc", target_doc))
        .select(
            F.col("source_doc").alias("from_document"),
            F.col("target_doc").alias("to_document"),
            F.col("target_section").alias("section"),
            F.col("reference_type").alias("type"),
            F.col("text").alias("context"),
        )
        .orderBy("from_document", "to_document", "context")
        .limit(limit)
    )


def term_definitions(g: Graph, term: str, limit: int = 10, related: int = 3) -> DataFrame:
    defn = named(g.label("Definition").where(contains("term", term)), "defn", "id", "term", "text", "citation_text", "domain")
    req = named(g.label("Requirement"), "req", "id", "text")
    got = hop(g, "DEFINES", defn, req, "defn_id", "req_id", "left")
    return (
        got.groupBy(
            F.col("defn_term").alias("term"),
            F.col("defn_text").alias("definition"),
            F.col("defn_citation_text").alias("source"),
            F.col("defn_domain").alias("domain"),
        )
        .agg(F.array_join(F.slice(F.array_sort(F.collect_set("req_text")), 1, related), "|").alias("related_requirements"))
        .orderBy("term", "definition", "source")
        .limit(limit)
    )


def detect_conflicts(g: Graph, keyword: str = "", limit: int = 20) -> DataFrame:
    a, b = (named(g.label("Requirement"), p, "id", "text", "citation_text") for p in ("r1", "r2"))
    got = hop(g, "CONFLICTS_WITH", a, b, "r1_id", "r2_id").where(contains("r1_text", keyword) | contains("r2_text", keyword))
    return (
        got.select(
            F.col("r1_text").alias("requirement1"),
            F.col("r1_citation_text").alias("source1"),
            F.col("r2_text").alias("requirement2"),
            F.col("r2_citation_text").alias("source2"),
        )
        .orderBy("requirement1", "requirement2", "source1", "source2")
        .limit(limit)
    )


def find_exemptions(g: Graph, keyword: str = "", limit: int = 20) -> DataFrame:
    return (
        g.label("Exemption")
        .where(any_contains(("text", "condition", "scope"), keyword))
        .select(F.col("text").alias("exemption"), F.col("citation_text").alias("source"), "condition", "scope")
        .orderBy("exemption", "source")
        .limit(limit)
    )


def dependency_chain(g: Graph, keyword: str, limit: int = 20) -> DataFrame:
    starts = g.label("Requirement").where(contains("text", keyword)).select("id")
    paths = directed(g, starts, ("REQUIRES",), 3, g.label("Requirement")).orderBy("length", "nodes").limit(limit)
    steps = paths.select("length", "nodes", F.posexplode("nodes").alias("k", "id"))
    item = F.struct("k", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("citation_text", F.lit("")).alias("source"))
    lists = (
        steps.join(g.nodes.select("id", "text", "citation_text"), "id", "left")
        .groupBy("length", "nodes")
        .agg(F.array_sort(F.collect_list(item)).alias("items"))
    )
    joined = lambda f: F.array_join(F.transform("items", lambda x: x[f]), " > ")
    return lists.select(
        joined("text").alias("dependency_chain"), joined("source").alias("sources"), F.col("length").alias("chain_length")
    ).orderBy("chain_length", "dependency_chain")


def related_requirements(g: Graph, node_id: str, limit: int = 20) -> DataFrame:
    """Requirements that share a process or a definition with one; an edge is never taken twice, so it isn't its own relative."""
    out = None
    for kind, forth, back in (("APPLIES_TO", "src", "dst"), ("DEFINES", "dst", "src")):
        e = g.type(kind)
        first = e.where(F.col(forth) == node_id).select(F.col(back).alias("via"), F.col("eid").alias("eid_1"))
        second = e.select(F.col(back).alias("via"), F.col(forth).alias("id"), F.col("eid").alias("eid_2"))
        one = first.join(second, "via").where("eid_1 <> eid_2").select("id")
        out = one if out is None else out.unionAll(one)
    return (
        g.label("Requirement")
        .join(out.distinct(), "id", "left_semi")
        .select(F.col("text").alias("requirement"), F.col("citation_text").alias("source"), "category")
        .distinct()
        .orderBy("requirement", "source", "category")
        .limit(limit)
    )


def search_requirements(g: Graph, search_term: str, limit: int = 20, severity_ranked: bool = False) -> DataFrame:
    req = named(g.label("Requirement").where(contains("text", search_term)), "req", "id", "text", "citation_text", "category", "severity")
    columns = {"text": "requirement", "citation_text": "source", "category": "category", "severity": "severity"}
    severity = severity_rank("req_severity") if severity_ranked else F.col("req_severity")
    req = first_of(req, columns, [severity.desc_nulls_first(), "req_text", "req_citation_text"], limit)
    return by_severity(with_processes(g, req, columns, "processes"), limit, severity_ranked, "requirement", "source", "category")


def citation_context(g: Graph, citation: str, limit: int = 20, shown: int | None = None) -> DataFrame:
    """Nodes by citation or source with their outgoing edges; one of nulls where there are none."""
    node = named(
        g.nodes.where((F.col("citation_text") == citation) | (F.col("source_doc") == citation)), "n", "id", "label", "text", "citation_text"
    )
    edges = g.edges.select(F.col("src").alias("n_id"), F.col("dst").alias("t_id"), "type")
    target = named(g.nodes, "t", "id", "label", "text")
    got = node.join(edges.join(target, "t_id"), "n_id", "left")
    told = F.concat_ws(":", *(F.coalesce(c, F.lit("-")) for c in ("type", "t_label", "t_text")))
    return (
        got.groupBy(F.col("n_label").alias("entity_type"), F.col("n_text").alias("content"), F.col("n_citation_text").alias("source"))
        .agg(F.array_join(F.array_sort(F.collect_set(told)), "|").alias("relationships"))
        .orderBy("entity_type", "content", "source")
        .limit(limit)
    )


TEMPLATES = {
    f.__name__: f
    for f in (
        requirements_for_process, regulation_applicability, cross_references, term_definitions, detect_conflicts,
        find_exemptions, dependency_chain, related_requirements, search_requirements, citation_context,
    )
}
BY_TYPE = {
    "applicability": regulation_applicability,
    "requirements": requirements_for_process,
    "cross_reference": cross_references,
    "conflict": detect_conflicts,
    "dependency": dependency_chain,
    "definition": term_definitions,
    "exemption": find_exemptions,
}


def template(kind: str):
    return BY_TYPE.get(kind, search_requirements)


def all_templates() -> dict[str, tuple[str, ...]]:
    """Every template by name, with its parameters."""
    return {name: f.__code__.co_varnames[1 : f.__code__.co_argcount] for name, f in TEMPLATES.items()}
