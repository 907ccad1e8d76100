"""Labels, edge types and record schemas; nothing is ever inferred from data."""

from __future__ import annotations

from pyspark.sql import types as T

LABELS = ("Regulation", "Section", "Requirement", "Definition", "Process", "Exemption", "CrossReference", "Topic")
EDGE_TYPES = (
    "CONTAINS", "APPLIES_TO", "DEFINES", "REQUIRES", "SUPERSEDES", "CONFLICTS_WITH", "REFERENCES", "MENTIONS", "EXEMPT_FROM",
)
#: Where uniqueness is asked for: by id, but definitions by term.
UNIQUE = {label: "term" if label == "Definition" else "id" for label in LABELS}

STRING, LONG, INT, DOUBLE, BOOLEAN, TIME = T.StringType(), T.LongType(), T.IntegerType(), T.DoubleType(), T.BooleanType(), T.TimestampType()
VECTOR = T.ArrayType(T.FloatType())


def struct(*strings: str, **others: T.DataType) -> T.StructType:
    """String fields by name, then others by type."""
    return T.StructType([T.StructField(n, STRING) for n in strings] + [T.StructField(n, t) for n, t in others.items()])


NODE = struct(
    "id", "label", "name", "term", "text", "description", "source_doc", "source_url", "section_id", "citation_text",
    "category", "severity", "scope", "domain", "condition", "process_type", "industry", "target_doc", "target_section",
    "reference_type", "issued_by", "effective_date", "version", "directive_code",
    mandatory=BOOLEAN, level=INT, embedding=VECTOR, created_at=TIME, updated_at=TIME, ord=LONG,
)
EDGE = struct("eid", "src", "dst", "type", props=struct("evidence", "reason", confidence=DOUBLE))
SECTION = struct("section_id", "heading", "content", level=INT, page_num=INT)
PARSED = struct(
    metadata=struct("filename", "filepath", "title", "error", num_pages=INT, parsed_at=TIME), full_text=STRING, sections=T.ArrayType(SECTION)
)
CHUNK = struct(
    "chunk_id", "doc_id", "source", "section_id", "section_heading", "text",
    char_count=INT, token_estimate=DOUBLE, embedding=VECTOR, metadata=struct(chunk_index=INT, created_at=TIME),
)
PROPERTIES = (
    "category", "severity", "scope", "mandatory", "term", "domain", "condition", "name", "process_type",
    "target_doc", "target_section", "reference_type", "issued_by", "effective_date", "version",
)
ENTITY = struct(
    "entity_type", "text", "source_chunk_id", "source_doc", "section_id", "section_heading",
    properties=T.StructType([T.StructField(p, BOOLEAN if p == "mandatory" else STRING) for p in PROPERTIES]), confidence=DOUBLE, ord=LONG,
)
CONTEXT = struct(
    "text", "node_id", "node_type", "source_doc", "section_id", "citation_text", "retrieval_method", "category", "severity",
    mandatory=BOOLEAN, relevance_score=DOUBLE, ord=LONG,
)


def describe() -> str:
    """The schemas as text."""
    out = []
    for name, schema in (("Node", NODE), ("Edge", EDGE), ("Chunk", CHUNK), ("Entity", ENTITY)):
        out += [name, *(f"  {f.name}: {f.dataType.simpleString()}" for f in schema)]
    return "\n".join([*out, "Labels: " + ", ".join(LABELS), "Edge types: " + ", ".join(EDGE_TYPES)])
