"""A small graph to try templates and paths on: a regulation, two sections, three requirements, a process."""

from __future__ import annotations

from pyspark.sql import SparkSession

from lawmesh.operators.graph import Graph, as_edges, as_nodes

SOURCE = "MHRA GMP"
#: id, label, name, text, section_id; the wording is ours.
NODES = (
    ("sample-reg-001", "Regulation", SOURCE, None, None),
    ("sample-sec-001", "Section", "Chapter 5", "Production", "5"),
    ("sample-sec-002", "Section", "5.1", "Sterile products", "5.1"),
    ("sample-req-001", "Requirement", None, "Aseptic filling takes place in grade A with a grade B background", "5.1.1"),
    ("sample-req-002", "Requirement", None, "Aseptic areas are monitored for particles and microbes", "5.1.2"),
    ("sample-req-003", "Requirement", None, "Staff for aseptic work are trained and requalified every year", "5.1.3"),
    ("sample-proc-001", "Process", "Aseptic Filling", None, None),
)
EDGES = {
    "CONTAINS": (("reg-001", "sec-001"), ("sec-001", "sec-002"), ("sec-002", "req-001"), ("sec-002", "req-002"), ("sec-002", "req-003")),
    "APPLIES_TO": (("req-001", "proc-001"), ("req-002", "proc-001"), ("req-003", "proc-001")),
}


def sample_graph(spark: SparkSession) -> Graph:
    rows = [
        (i, label, name, text, None if label == "Process" else SOURCE, section, None if label == "Process" else " ".join(filter(None, (SOURCE, section))), *(("Critical", True) if label == "Requirement" else (None, None)))
        for i, label, name, text, section in NODES
    ]
    nodes = as_nodes(spark.createDataFrame(rows, "id string, label string, name string, text string, source_doc string, section_id string, citation_text string, severity string, mandatory boolean"))
    edges = None
    for kind, ends in EDGES.items():
        one = as_edges(spark.createDataFrame([(f"sample-{a}", f"sample-{b}") for a, b in ends], "src string, dst string"), kind)
        edges = one if edges is None else edges.unionByName(one)
    return Graph(nodes, edges)
