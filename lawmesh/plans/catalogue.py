"""The registered queries over the given tables, each with its SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lawmesh.functions import text as fn
from lawmesh.operators import answer, build, conflict, delta, extract, fulltext, graph, ingest, merge, paths, retrieve, vectors
from lawmesh.operators.store import exists, new_path, written
from lawmesh.plans import router, tables, templates
from lawmesh.plans.tables import SQL, table
from lawmesh.sources import files

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def joined(df, **columns):
    """Arrays as text, for results that are compared."""
    return df.withColumns({c: F.array_join(c, by) for c, by in columns.items()})


# ------------------------------------------------------------ templates


@query("SELECT doc_id, source FROM documents WHERE contains(lower(text), 'license')")
def scan_filter_contains(spark, sf):
    return table(spark, sf, "documents").where(fn.contains("text", "license")).select("doc_id", "source")


@query(
    SQL + """SELECT r.text AS requirement, r.citation_text AS source, r.category, r.severity, r.mandatory, p.name AS process
FROM edges e JOIN nodes r ON e.src = r.id AND r.label = 'Requirement' JOIN nodes p ON e.dst = p.id AND p.label = 'Process'
WHERE e.type = 'APPLIES_TO' AND contains(lower(p.name), 'ring') ORDER BY r.severity DESC NULLS FIRST, requirement, process LIMIT 500"""
)
def template_requirements_for_process(spark, sf):
    return templates.requirements_for_process(tables.stored_graph(spark, sf), "Ring", 500)


@query(
    SQL + """SELECT r.text AS requirement, r.citation_text AS source, r.scope, coalesce(string_agg(DISTINCT p.name, '|' ORDER BY p.name), '') AS applicable_processes
FROM nodes r LEFT JOIN (SELECT src, name FROM edges JOIN nodes ON dst = id WHERE type = 'APPLIES_TO' AND label = 'Process') p ON p.src = r.id
WHERE r.label = 'Requirement' AND (contains(lower(r.text), 'urgent') OR contains(lower(r.scope), 'urgent')) GROUP BY 1, 2, 3 ORDER BY 1, 2, 3 LIMIT 500"""
)
def template_applicability(spark, sf):
    return templates.regulation_applicability(tables.stored_graph(spark, sf), "urgent", 500)


@query(
    SQL + """SELECT source_doc AS from_document, target_doc AS to_document, target_section AS section, reference_type AS type, text AS context FROM nodes
WHERE label = 'CrossReference' AND (contains(lower(source_doc), 'c1') OR contains(lower(target_doc), 'low')) ORDER BY 1, 2, 5 LIMIT 1000"""
)
def template_crossref(spark, sf):
    return templates.cross_references(tables.stored_graph(spark, sf), "C1", "low", 1000)


@query(
    SQL + """SELECT d.term, d.text AS definition, d.citation_text AS source, d.domain, array_to_string(list_slice(list_sort(list(DISTINCT r.text) FILTER (WHERE r.text IS NOT NULL)), 1, 3), '|') AS related_requirements
FROM nodes d LEFT JOIN (SELECT src, text FROM edges JOIN nodes ON dst = id WHERE type = 'DEFINES' AND label = 'Requirement') r ON r.src = d.id
WHERE d.label = 'Definition' AND contains(lower(d.term), 'supplier') GROUP BY 1, 2, 3, 4 ORDER BY 1, 2, 3 LIMIT 500"""
)
def template_definitions(spark, sf):
    return templates.term_definitions(tables.stored_graph(spark, sf), "supplier", 500)


@query(
    SQL + """SELECT a.text AS requirement1, a.citation_text AS source1, b.text AS requirement2, b.citation_text AS source2
FROM edges e JOIN nodes a ON e.src = a.id JOIN nodes b ON e.dst = b.id
WHERE e.type = 'CONFLICTS_WITH' AND (contains(lower(a.text), 'medium') OR contains(lower(b.text), 'medium')) ORDER BY 1, 3, 2, 4 LIMIT 500"""
)
def template_conflicts(spark, sf):
    return templates.detect_conflicts(tables.stored_graph(spark, sf), "medium", 500)


@query(
    SQL + """SELECT text AS exemption, citation_text AS source, condition, scope FROM nodes
WHERE label = 'Exemption' AND (contains(lower(text), 'eco') OR contains(lower(condition), 'eco') OR contains(lower(scope), 'eco')) ORDER BY 1, 2 LIMIT 500"""
)
def template_exemptions(spark, sf):
    return templates.find_exemptions(tables.stored_graph(spark, sf), "eco", 500)


def _walk(starts: str, edges: str, depth: int) -> str:
    out = f", w0 AS (SELECT id AS start, id AS at, [id] AS nodes, CAST([] AS VARCHAR[]) AS eids, CAST([] AS VARCHAR[]) AS types FROM ({starts}))"
    for k in range(1, depth + 1):
        out += f""", w{k} AS (SELECT w.start, e.dst AS at, list_append(w.nodes, e.dst) AS nodes, list_append(w.eids, e.eid) AS eids, list_append(w.types, e.type) AS types
  FROM w{k - 1} w JOIN {edges} e ON w.at = e.src WHERE NOT list_contains(w.eids, e.eid))"""
    return out + ", walks AS (" + " UNION ALL ".join(f"SELECT *, {k} AS length FROM w{k}" for k in range(1, depth + 1)) + ") "


@query(
    SQL + _walk("SELECT id FROM nodes WHERE label = 'Requirement' AND contains(lower(text), 'urgent order 1')", "(SELECT * FROM edges WHERE type = 'REQUIRES')", 3)
    + """, best AS (SELECT length, nodes FROM walks ORDER BY length, nodes LIMIT 300)
SELECT array_to_string(list_transform(nodes, lambda x: t[x]), ' > ') AS dependency_chain, array_to_string(list_transform(nodes, lambda x: c[x]), ' > ') AS sources, length AS chain_length
FROM best, (SELECT map_from_entries(list((id, text))) AS t, map_from_entries(list((id, citation_text))) AS c FROM nodes WHERE label = 'Requirement')"""
)
def dependency_chain(spark, sf):
    return templates.dependency_chain(tables.stored_graph(spark, sf), "urgent order 1", 300)


@query(
    SQL + """SELECT DISTINCT n.text AS requirement, n.citation_text AS source, n.category FROM nodes n JOIN (
  SELECT b.src AS id FROM edges a JOIN edges b ON a.dst = b.dst AND a.eid <> b.eid WHERE a.type = 'APPLIES_TO' AND b.type = 'APPLIES_TO' AND a.src = 'o10'
  UNION ALL SELECT b.dst FROM edges a JOIN edges b ON a.src = b.src AND a.eid <> b.eid WHERE a.type = 'DEFINES' AND b.type = 'DEFINES' AND a.dst = 'o10') r ON n.id = r.id
WHERE n.label = 'Requirement' ORDER BY 1, 2, 3 LIMIT 2000"""
)
def related_requirements(spark, sf):
    return templates.related_requirements(tables.stored_graph(spark, sf), "o10", 2000)


@query(
    SQL + """SELECT r.text AS requirement, r.citation_text AS source, r.category, r.severity, coalesce(string_agg(DISTINCT p.name, '|' ORDER BY p.name), '') AS processes
FROM nodes r LEFT JOIN (SELECT src, name FROM edges JOIN nodes ON dst = id WHERE type = 'APPLIES_TO' AND label = 'Process') p ON p.src = r.id
WHERE r.label = 'Requirement' AND contains(lower(r.text), 'order 1') GROUP BY 1, 2, 3, 4 ORDER BY r.severity DESC NULLS FIRST, 1, 2 LIMIT 500"""
)
def search_requirements(spark, sf):
    return templates.search_requirements(tables.stored_graph(spark, sf), "order 1", 500)


@query(
    SQL + """SELECT n.label AS entity_type, n.text AS content, n.citation_text AS source,
  string_agg(DISTINCT concat_ws(':', coalesce(r.type, '-'), coalesce(r.label, '-'), coalesce(r.text, '-')), '|' ORDER BY concat_ws(':', coalesce(r.type, '-'), coalesce(r.label, '-'), coalesce(r.text, '-'))) AS relationships
FROM nodes n LEFT JOIN (SELECT e.src, e.type, t.label, t.text FROM edges e JOIN nodes t ON e.dst = t.id) r ON r.src = n.id
WHERE n.citation_text = 'C7' OR n.source_doc = 'C7' GROUP BY 1, 2, 3 ORDER BY 1, 2, 3 LIMIT 100"""
)
def citation_context(spark, sf):
    return templates.citation_context(tables.stored_graph(spark, sf), "C7", 100)


# ------------------------------------------------------------ counts and paths


@query(SQL + "SELECT (SELECT count(*) FROM nodes) AS total_nodes, (SELECT count(*) FROM edges) AS total_relationships")
def graph_totals(spark, sf):
    return graph.totals(tables.stored_graph(spark, sf))


@query(SQL + "SELECT label, count(*) AS count FROM nodes GROUP BY label")
def count_by_label(spark, sf):
    return graph.count_by_label(tables.stored_graph(spark, sf))


@query(SQL + "SELECT type, count(*) AS count FROM edges GROUP BY type")
def count_by_type(spark, sf):
    return graph.count_by_type(tables.stored_graph(spark, sf))


@query(
    SQL + """, d AS (SELECT id, sum(i) AS in_degree, sum(o) AS out_degree FROM (SELECT dst AS id, 1 AS i, 0 AS o FROM edges UNION ALL SELECT src, 0, 1 FROM edges) GROUP BY id)
SELECT n.id, n.text, CAST(in_degree AS BIGINT) AS in_degree, CAST(out_degree AS BIGINT) AS out_degree, CAST(in_degree + out_degree AS BIGINT) AS total_degree
FROM d JOIN nodes n ON d.id = n.id WHERE n.label = 'Requirement' ORDER BY total_degree DESC, n.id LIMIT 200"""
)
def degree_centrality(spark, sf):
    return graph.degree(tables.stored_graph(spark, sf), "Requirement", 200)


@query(
    SQL + """SELECT e.dst AS process_id, n.name AS process, count(*) AS requirement_count, array_to_string(list_slice(list_sort(list(e.src)), 1, 10), ',') AS requirements
FROM edges e JOIN nodes n ON e.dst = n.id WHERE e.type = 'APPLIES_TO' GROUP BY 1, 2 HAVING count(*) >= 3 ORDER BY requirement_count DESC, process_id LIMIT 50"""
)
def communities(spark, sf):
    return graph.communities(tables.stored_graph(spark, sf), 3, 50)


@query(
    SQL + """SELECT DISTINCT n.id, n.label, coalesce(n.text, n.name, n.term) AS text, n.citation_text, b.type AS relationship
FROM both_ways b JOIN nodes n ON b.dst = n.id WHERE b.src = 'p3' ORDER BY 1, 5 LIMIT 100"""
)
def neighbors(spark, sf):
    return paths.neighbors(tables.stored_graph(spark, sf), "p3", (), 100)


ENDS = _walk("SELECT id FROM nodes WHERE id = 'c1'", "both_ways", 4)


@query(SQL + ENDS + """SELECT array_to_string(nodes, '>') AS nodes, array_to_string(types, '>') AS types, CAST(length AS INTEGER) AS length FROM walks WHERE walks."at" = 'c2' ORDER BY walks.length, walks.nodes, walks.types LIMIT 1""")
def shortest_path(spark, sf):
    return joined(paths.shortest_path(tables.stored_graph(spark, sf), "c1", "c2", 4), nodes=">", types=">")


# a supplier reaches a region by an order, its customer and the customer's nation, and in no shorter way
@query(
    """WITH w AS (SELECT DISTINCT 's' || s_suppkey AS s, 'r' || n.n_regionkey AS r, ['s' || s_suppkey, 'o' || o_orderkey, 'c' || c_custkey, 'n' || c_nationkey, 'r' || n.n_regionkey] AS nodes
  FROM supplier JOIN nation m ON s_nationkey = m.n_nationkey JOIN lineitem ON l_suppkey = s_suppkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation n ON c_nationkey = n.n_nationkey
  WHERE n.n_regionkey = m.n_regionkey)
SELECT s AS "start", r AS "end", array_to_string(min(nodes), '>') AS nodes, 'DEFINES>CONTAINS>CONTAINS>CONTAINS' AS types, 4 AS length FROM w GROUP BY s, r"""
)
def shortest_paths(spark, sf):
    """From each supplier to the region of its nation."""
    pairs = table(spark, sf, "supplier").join(table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(F.concat(F.lit("s"), "s_suppkey").alias("start"), F.concat(F.lit("r"), "n_regionkey").alias("end"))
    return joined(paths.shortest_paths(tables.stored_graph(spark, sf), pairs, 4), nodes=">", types=">")


@query(SQL + ENDS + """SELECT array_to_string(nodes, '>') AS nodes, array_to_string(types, '>') AS types, CAST(length AS INTEGER) AS length FROM walks WHERE walks."at" = 'c2' ORDER BY walks.length, walks.nodes, walks.types LIMIT 50""")
def all_paths(spark, sf):
    return joined(paths.all_paths(tables.stored_graph(spark, sf), "c1", "c2", 4, 50), nodes=">", types=">")


@query(
    SQL + _walk("SELECT id FROM nodes WHERE id = 'o3'", "(SELECT * FROM edges WHERE type = 'REQUIRES')", 3)
    + """SELECT walks."start" AS start, walks."at" AS at, array_to_string(nodes, '>') AS nodes, array_to_string(types, '>') AS types, CAST(length AS INTEGER) AS length FROM walks ORDER BY walks.length, walks.nodes LIMIT 20"""
)
def dependencies(spark, sf):
    return joined(paths.dependencies(tables.stored_graph(spark, sf), "o3"), nodes=">", types=">")


@query(
    SQL + _walk("SELECT id FROM nodes WHERE citation_text = 'R1' OR source_doc = 'R1'", "(SELECT * FROM edges WHERE type IN ('CONTAINS', 'APPLIES_TO'))", 3)
    + """SELECT walks."start" AS start, walks."at" AS at, array_to_string(nodes, '>') AS nodes, array_to_string(types, '>') AS types, CAST(length AS INTEGER) AS length FROM walks ORDER BY walks.length, walks.nodes LIMIT 500"""
)
def citation_chain(spark, sf):
    return joined(paths.citation_chain(tables.stored_graph(spark, sf), "R1", 3, 500, ("CONTAINS", "APPLIES_TO")), nodes=">", types=">")


# ------------------------------------------------------------ entities


@query("SELECT doc_id, source FROM (SELECT *, row_number() OVER (PARTITION BY regexp_replace(lower(text), '^\\s+|\\s+$', '', 'g') ORDER BY doc_id) AS k FROM documents WHERE text <> '') WHERE k = 1")
def dedup_first(spark, sf):
    return graph.keep_first(table(spark, sf, "documents"), fn.strip(F.lower("text")), "doc_id").select("doc_id", "source")


@query("SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS k FROM events) WHERE k = 1")
def upsert_last(spark, sf):
    return graph.keep_last(table(spark, sf, "events").select("user_id", "event_id", "event_type", "value"), "user_id", "event_id")


# the events as two batches, the later one over the earlier one
@query("SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS k FROM events) WHERE k = 1")
def upsert_stored(spark, sf):
    rows = table(spark, sf, "events").select("user_id", "event_id", "event_type", "value")
    half = rows.agg(F.max("event_id")).first()[0] // 2
    kept = merge.stored(spark, new_path(spark), rows.schema, "user_id")
    for batch in (rows.where(F.col("event_id") <= half), rows.where(F.col("event_id") > half)):
        merge.upsert_stored(kept, batch, "event_id")
    return kept.rows()


@query(
    """SELECT doc_id AS ord, source AS source_chunk_id, lang AS entity_type FROM (SELECT *, row_number() OVER (PARTITION BY source, lang, substr(text, 1, 100) ORDER BY doc_id % 2, doc_id) AS k FROM documents) WHERE k = 1"""
)
def merge_entities(spark, sf):
    e = table(spark, sf, "documents").select(F.col("source").alias("source_chunk_id"), F.col("lang").alias("entity_type"), "text", F.col("doc_id").alias("ord"))
    return extract.merge(e.where("ord % 2 = 0"), e.where("ord % 2 = 1")).select("ord", "source_chunk_id", "entity_type")


@query("SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def resume_anti_join(spark, sf):
    return extract.remaining(table(spark, sf, "documents"), table(spark, sf, "labels"), key="doc_id").select("doc_id", "source")


NODE_ID = r"'requirement_' || replace(lower(source), ' ', '_') || '_' || substr(md5(regexp_replace(lower(text), '^\s+|\s+$', '', 'g')), 1, 8)"


@query(f"SELECT doc_id, {NODE_ID} AS node_id FROM documents")
def node_ids(spark, sf):
    return table(spark, sf, "documents").select("doc_id", fn.node_id(F.lit("Requirement"), "source", "text").alias("node_id"))


SENTENCES = r"list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: regexp_replace(s, '^\s+|\s+$', '', 'g')), lambda s: length(s) > 20)"


@query(f"SELECT doc_id, CAST(len(s) AS INTEGER) AS sentences, coalesce(CAST(list_sum(list_transform(s, lambda x: length(x))) AS BIGINT), 0) AS characters FROM (SELECT doc_id, {SENTENCES} AS s FROM documents)")
def sentence_split(spark, sf):
    s = table(spark, sf, "documents").select("doc_id", fn.sentences("text").alias("s"))
    return s.select("doc_id", F.size("s").alias("sentences"), F.aggregate("s", F.lit(0).cast("long"), lambda a, x: a + F.length(x)).alias("characters"))


STRIPPED = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
TOKENS = r"CAST(len(list_filter(string_split_regex({}, '\s+'), lambda w: w <> '')) AS DOUBLE) * 1.3"
# the greedy packing as a fold: a sentence begins a chunk where the last one is full, with its last two pieces if it has more
CHUNKS = f"""WITH s AS (SELECT doc_id, source, coalesce(text, '') AS t, list_transform({SENTENCES.replace("(text,", "(coalesce(text, ''),")}, lambda x: {{'done': CAST([] AS VARCHAR[]), 'now': [x], 'n': CAST(length(x) AS BIGINT)}}) AS s FROM documents),
p AS (SELECT doc_id, source, t, CASE WHEN len(s) > 0 THEN list_reduce(s, lambda a, b: CASE WHEN a.n + length(b.now[1]) > 1000 THEN
    CASE WHEN len(a.now) > 2 THEN {{'done': list_append(a.done, array_to_string(a.now, ' ')), 'now': [array_to_string(a.now[-2:], ' '), b.now[1]], 'n': CAST(length(array_to_string(a.now[-2:], ' ')) + length(b.now[1]) AS BIGINT)}}
    ELSE {{'done': list_append(a.done, array_to_string(a.now, ' ')), 'now': b.now, 'n': b.n}} END
  ELSE {{'done': a.done, 'now': list_append(a.now, b.now[1]), 'n': a.n + length(b.now[1])}} END) END AS r FROM s),
c AS (SELECT doc_id, source, CASE WHEN length({STRIPPED.format("t")}) < 100 THEN [t] WHEN r IS NULL THEN [] ELSE list_append(r.done, array_to_string(r.now, ' ')) END AS c FROM p),
chunks AS (SELECT doc_id, source, unnest(c) AS raw, generate_subscripts(c, 1) - 1 AS k FROM c)
"""


@query(
    CHUNKS + f"""SELECT doc_id || '_section_1_' || k AS chunk_id, CAST(doc_id AS VARCHAR) AS doc_id, source, 'section_1' AS section_id, 'Full Document' AS section_heading, {STRIPPED.format("raw")} AS text,
  CAST(length(raw) AS INTEGER) AS char_count, {TOKENS.format("raw")} AS token_estimate, CAST(k AS INTEGER) AS chunk_index FROM chunks"""
)
def chunks(spark, sf):
    return ingest.chunks(_whole(spark, sf))


def _whole(spark, sf):
    docs = table(spark, sf, "documents")
    return docs.select(F.col("doc_id").cast("string").alias("doc_id"), "source", F.lit("section_1").alias("section_id"), F.lit("Full Document").alias("heading"), F.col("text").alias("content"))


def _heading(k: int, group: int) -> str:
    return f"regexp_extract(line, '{ingest.HEADINGS[k]}', {group})"


CASES = [f"regexp_matches(line, '{p}')" for p in ingest.HEADINGS]
CASES[4] += " AND length(line) < 100"


def _case(*values: str) -> str:
    return "CASE " + " ".join(f"WHEN {c} THEN {v}" for c, v in zip(CASES, values, strict=True)) + " END"


@query(
    f"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents),
s AS (SELECT doc_id, n, {STRIPPED.format("raw")} AS line FROM l WHERE {STRIPPED.format("raw")} <> ''),
h AS (SELECT *, {_case(*["true"] * 5)} AS is_heading, {_case(*(f"lower({_heading(k, 1)}) || '_' || {_heading(k, 2)}" for k in range(3)), f"'section_' || {_heading(3, 1)}", "NULL")} AS section_id,
  {_case(*(f"{_heading(k, 1)} || ' ' || {_heading(k, 2)} || ': ' || {_heading(k, 3)}" for k in range(3)), f"{_heading(3, 1)} || ' ' || {_heading(3, 2)}", "line")} AS heading,
  {_case(*(f"len(string_split({_heading(k, 2)}, '.'))" for k in range(3)), f"len(string_split({_heading(3, 1)}, '.'))", "1")} AS level FROM s),
o AS (SELECT *, CAST(sum(CASE WHEN is_heading THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY n) AS BIGINT) AS ord FROM h),
f AS (SELECT doc_id, ord, coalesce(max(section_id), 'section_' || ord) AS section_id, max(heading) AS heading, coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (WHERE is_heading IS NULL), '') AS content, CAST(max(level) AS INTEGER) AS level FROM o WHERE ord > 0 GROUP BY doc_id, ord)
SELECT * FROM f UNION ALL SELECT doc_id, 1, 'section_1', 'Full Document', text, 1 FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM f)"""
)
def sections(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.col("text").alias("full_text"))
    return ingest.sections(docs)


def _rounded(df, *columns):
    return df.withColumns({c: F.round(c, 6) for c in columns})


@query(CHUNKS + f"SELECT count(*) AS total_chunks, round(avg(length(raw)), 6) AS avg_chunk_size, round(avg({TOKENS.format('raw')}), 6) AS avg_tokens FROM chunks")
def chunk_stats(spark, sf):
    return _rounded(ingest.chunk_stats(ingest.chunks(_whole(spark, sf))), "avg_chunk_size", "avg_tokens")


@query(CHUNKS + "SELECT source, count(*) AS chunks FROM chunks GROUP BY source")
def chunks_by_source(spark, sf):
    return ingest.chunks_by_source(ingest.chunks(_whole(spark, sf)))


# ------------------------------------------------------------ edges by rules


@query("SELECT 'CONTAINS|' || source || '|' || doc_id AS eid, source AS src, CAST(doc_id AS VARCHAR) AS dst FROM documents")
def contains_edges(spark, sf):
    docs = table(spark, sf, "documents")
    nodes = graph.as_nodes(docs, id=F.col("doc_id").cast("string"), label="Requirement", source_doc=F.col("source")).unionByName(
        graph.as_nodes(docs.select("source").distinct(), id=F.col("source"), label="Regulation", source_doc=F.col("source"))
    )
    return build.contains_by_source(nodes).select("eid", "src", "dst")


@query("SELECT CAST(item_id AS VARCHAR) AS term_id, CAST(doc_id AS VARCHAR) AS text_id FROM benchmark b JOIN documents d ON contains(lower(d.text), lower(b.text))")
def defines_edges(spark, sf):
    terms = table(spark, sf, "benchmark").select(F.col("item_id").cast("string").alias("id"), F.col("text").alias("term"))
    return build.containing(terms, table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("id"), "text"))


@query("SELECT DISTINCT a.p_name AS term_id, CAST(b.p_partkey AS VARCHAR) AS text_id FROM part a JOIN part b ON contains(lower(b.p_brand || ' ' || b.p_name || ' ' || b.p_type), lower(a.p_name))")
def applies_to_edges(spark, sf):
    part = table(spark, sf, "part")
    texts = part.select(F.col("p_partkey").cast("string").alias("id"), F.concat_ws(" ", "p_brand", "p_name", "p_type").alias("text"))
    return build.containing(part.select(F.col("p_name").alias("id"), F.col("p_name").alias("term")).distinct(), texts)


@query(
    """SELECT a.doc_id AS src, b.doc_id AS dst FROM (SELECT doc_id, lower(text) AS t FROM documents) a JOIN (SELECT doc_id, lower(substr(text, 1, 100)) AS s FROM documents WHERE length(substr(text, 1, 100)) > 30) b
ON contains(a.t, b.s) AND a.doc_id <> b.doc_id"""
)
def requires_edges(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")
    parts = docs.select("id", F.lower(F.substring("text", 1, 100)).alias("term")).where(F.length("term") > 30)
    return build.containing(parts, docs).where("text_id <> term_id").select(F.col("text_id").alias("src"), F.col("term_id").alias("dst"))


LEXICON = ("tiontion", "ndthtion", "oningnd", "thhetion")
CANONICAL = f"SELECT min_by({NODE_ID}, doc_id) AS id, {STRIPPED.format('lower(text)')} AS t FROM documents GROUP BY 2"


@query(
    f"""SELECT DISTINCT c.id AS src, d.id AS dst FROM (SELECT unnest({list(LEXICON)}) AS w) l
JOIN (SELECT 'exemption_' || role || '_' || substr(md5({STRIPPED.format("lower(text)")}), 1, 8) AS id, lower(text) AS t FROM conversations) c ON contains(c.t, w)
JOIN ({CANONICAL}) d ON contains(d.t, w)"""
)
def exempt_edges(spark, sf):
    turns, docs = table(spark, sf, "conversations"), table(spark, sf, "documents")
    e = tables.entity_rows(turns, "Exemption", F.col("conv_id") * 1000 + F.col("turn"), F.col("text"), F.col("role"))
    e = e.unionByName(tables.entity_rows(docs, "Requirement", F.col("doc_id"), F.col("text"), F.col("source")))
    return build.exempt_from(e, LEXICON).select("src", "dst")


@query(
    f"""WITH r AS (SELECT d.doc_id, source, lang, quality = 1 AS m, {NODE_ID} AS id, list_distinct(list_filter(string_split_regex(lower(text), '\\s+'), lambda w: length(w) > 4)) AS w
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE quality IS NOT NULL)
SELECT a.id AS req1_id, b.id AS req2_id, a.source AS source1, b.source AS source2, a.lang AS category,
  a.lang || ': mandatory in ' || a.source || ' but optional in ' || b.source AS reason, 0.7::DOUBLE AS confidence
FROM r a JOIN r b ON a.lang = b.lang AND a.doc_id < b.doc_id AND a.source <> b.source AND a.m <> b.m WHERE len(list_intersect(a.w, b.w)) >= 3"""
)
def entity_conflicts(spark, sf):
    return conflict.entity_conflicts(tables.requirements(spark, sf))


PAIRS = ", ".join(f"({i}, '{p}', '{n}')" for i, (p, n) in enumerate(fn.CONTRADICTIONS))


# the place of a term with 30 characters on both sides, of which 50 are told
def _near(t: str, x: str, y: str) -> str:
    at = lambda k: rf"regexp_replace(substr({t}, greatest(1, instr({t}, {k}) - 30), instr({t}, {k}) + length({k}) + 30 - greatest(1, instr({t}, {k}) - 30)), '^\s+|\s+$', '', 'g')"
    return f"substr(CASE WHEN contains({t}, {x}) THEN {at(x)} ELSE {at(y)} END, 1, 50)"


@query(
    rf"""WITH c AS (SELECT conv_id, turn AS ord, role AS s, lower(text || CASE WHEN conv_id % 4 = 1 THEN if(role = 'user', ' must', ' may') WHEN conv_id % 4 = 2 THEN if(role = 'user', ' < 5', ' > 10') ELSE '' END) AS t,
  conv_id % 4 IN (0, 3) AS c, conv_id % 4 <> 0 OR role = 'user' AS m, CASE WHEN conv_id % 4 = 3 THEN if(role = 'user', 4, 1) END AS r FROM conversations),
w AS (SELECT *, list_distinct(list_filter(string_split_regex(t, '\s+'), lambda w: length(w) > 4 AND regexp_full_match(w, '[\p{{L}}\p{{N}}]+'))) AS w FROM c), p AS (SELECT * FROM (VALUES {PAIRS}) v(k, a, b)),
m AS (SELECT a.conv_id, a.ord AS ord1, b.ord AS ord2, a.s AS source1, b.s AS source2, a.t AS t1, b.t AS t2, a.c AND b.c AND a.s <> b.s AS same, a.m <> b.m AS differ, a.r - b.r AS far,
  (SELECT min(k) FROM p WHERE contains(a.t, p.a) AND contains(b.t, p.b) OR contains(a.t, p.b) AND contains(b.t, p.a)) AS hit,
  CASE WHEN contains(a.t, ' < 5') AND contains(b.t, ' > 10') THEN '<5 vs >10' WHEN contains(a.t, ' > 10') AND contains(b.t, ' < 5') THEN '>10 vs <5' END AS num
  FROM w a JOIN w b ON a.conv_id = b.conv_id AND a.ord < b.ord WHERE len(list_intersect(a.w, b.w)) >= 3),
f AS (SELECT *, CASE WHEN same AND differ THEN 0.75 WHEN hit IS NOT NULL THEN 0.85 WHEN num IS NOT NULL THEN 0.8 WHEN same AND abs(far) >= 2 THEN 0.6 END AS confidence FROM m LEFT JOIN p ON m.hit = p.k)
SELECT conv_id, ord1, ord2, source1, source2, CAST(confidence AS DOUBLE) AS confidence, CASE confidence
  WHEN 0.75 THEN 'Same category (c) but different mandatoriness in ' || source1 || ' vs ' || source2
  WHEN 0.85 THEN 'Contradictory terms: ''' || a || ''' vs ''' || b || ''' - ' || {_near("t1", "a", "b")} || '... vs ' || {_near("t2", "b", "a")} || '...'
  WHEN 0.8 THEN 'Conflicting numeric ranges: ' || num
  ELSE 'Different severity levels for c: ' || if(source1 = 'user', 'Critical', 'Low') || ' (' || source1 || ') vs ' || if(source2 = 'user', 'Critical', 'Low') || ' (' || source2 || ')' END AS reason
FROM f WHERE confidence IS NOT NULL"""
)
def runtime_conflicts(spark, sf):
    """Turns as contexts of their conversation; by its number they differ in being mandatory, in terms, in numbers or in severity."""
    kind, user = F.col("conv_id") % 4, F.col("role") == "user"
    told = F.when(kind == 1, F.when(user, " must").otherwise(" may")).when(kind == 2, F.when(user, " < 5").otherwise(" > 10")).otherwise("")
    c = table(spark, sf, "conversations").select(
        "conv_id", F.col("turn").alias("ord"), F.concat("text", told).alias("text"), F.col("role").alias("source_doc"), F.when(kind.isin(0, 3), "c").alias("category"),
        ((kind != 0) | user).alias("mandatory"), F.when(kind == 3, F.when(user, "Critical").otherwise("Low")).alias("severity"),
    )
    return conflict.runtime_conflicts(c, key="conv_id").select("conv_id", "ord1", "ord2", "source1", "source2", "confidence", "reason")


# ------------------------------------------------------------ regulations and directives


def _law(spark, sf):
    """Suppliers that say which directive gives way to which, regions as regulations, nations as references between them."""
    s, n, r = (table(spark, sf, t) for t in ("supplier", "nation", "region"))
    old = F.concat(F.col("s_nationkey") + 1900, F.lit("/"), "s_suppkey", F.lit("/EC"))
    new = F.concat(F.col("s_nationkey") + 2000, F.lit("/"), F.col("s_suppkey") % 10, F.lit("/EU"))
    text = F.concat(F.lit("Rule "), "s_name", F.lit(": "), old, F.lit(" is repealed by "), new)
    pairs = n.join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    rows = tables.entity_rows(s, "Requirement", F.col("s_suppkey"), text, F.concat(F.lit("Rules of asia and nation "), "s_nationkey"))
    rows = rows.unionByName(tables.entity_rows(r, "Regulation", F.col("r_regionkey"), F.col("r_name"), F.initcap("r_name"), name=F.concat(F.lit("Law of "), "r_name", F.lit(" and ASIA"))))
    kind = F.when(F.col("n_nationkey") % 3 == 0, "refers").otherwise("Supersedes")
    return rows.unionByName(tables.entity_rows(pairs, "CrossReference", F.col("n_nationkey"), F.col("n_name"), F.col("r_name"), target_doc=F.lit("ASIA"), reference_type=kind))


LAW = """WITH s AS (SELECT s_suppkey AS ord, 'Rules of asia and nation ' || s_nationkey AS source, (1900 + s_nationkey) || '/' || s_suppkey || '/EC' AS old, (2000 + s_nationkey) || '/' || (s_suppkey % 10) || '/EU' AS new, s_name FROM supplier),
g AS (SELECT r_regionkey AS ord, r_name, array_to_string(list_transform(string_split(r_name, ' '), lambda w: w[1] || lower(w[2:])), ' ') AS source, 'Law of ' || r_name || ' and ASIA' AS name FROM region),
g2 AS (SELECT 'regulation_' || replace(lower(source), ' ', '_') || '_' || substr(md5(lower(name)), 1, 8) AS id, * FROM g),
d AS (SELECT code, min(ord) AS ord, min_by(source, ord) AS source FROM (SELECT new AS code, ord, source FROM s UNION ALL SELECT old, ord, source FROM s) GROUP BY code)
"""


@query(LAW + "SELECT 'regulation_directive_' || replace(code, '/', '_') AS id, code AS name, CASE WHEN contains(code, 'EU') THEN 'European Union' ELSE 'European Commission' END AS issued_by, source AS source_doc FROM d")
def directives(spark, sf):
    found = build.supersessions(build.flat(_law(spark, sf)).where("entity_type = 'Requirement'"))
    return build.directive_nodes(found).select("id", "name", "issued_by", "source_doc")


@query(
    LAW + """SELECT src, dst, min(evidence) AS evidence FROM (
  SELECT 'regulation_directive_' || replace(new, '/', '_') AS src, 'regulation_directive_' || replace(old, '/', '_') AS dst, substr('Rule ' || s_name || ': ' || old || ' is repealed by ' || new, 1, 200) AS evidence FROM s
  UNION ALL SELECT a.id, b.id, NULL FROM nation JOIN region r ON n_regionkey = r.r_regionkey JOIN g2 a ON contains(a.name, r.r_name) JOIN g2 b ON contains(b.name, 'ASIA') WHERE n_nationkey % 3 <> 0) GROUP BY src, dst"""
)
def supersedes_edges(spark, sf):
    e = _law(spark, sf)
    found = build.supersessions(build.flat(e).where("entity_type = 'Requirement'"))
    nodes = build.entity_nodes(e, "Regulation").unionByName(build.directive_nodes(found))
    return build.supersedes(e, nodes).select("src", "dst", "props.evidence")


@query(
    LAW + """SELECT DISTINCT g2.id AS src, 'requirement_' || replace(lower(s.source), ' ', '_') || '_' || substr(md5(lower('Rule ' || s_name || ': ' || old || ' is repealed by ' || new)), 1, 8) AS dst
FROM g2 JOIN s ON contains(lower(s.source), lower(g2.source)) OR contains(lower(g2.name), lower(s.source))"""
)
def contains_by_name(spark, sf):
    return build.contains_by_name(_law(spark, sf)).select("src", "dst")


@query(LAW + "SELECT id, name, source AS source_doc FROM g2")
def regulation_nodes(spark, sf):
    return build.entity_nodes(_law(spark, sf), "Regulation").select("id", "name", "source_doc")


@query(
    """WITH x AS (SELECT *, row_number() OVER (PARTITION BY r_name ORDER BY n_nationkey DESC) AS k FROM nation JOIN region ON n_regionkey = r_regionkey)
SELECT r_name AS source_doc, 'ASIA' AS target_doc, CASE WHEN n_nationkey % 3 = 0 THEN 'refers' ELSE 'Supersedes' END AS reference_type, n_name AS text FROM x WHERE k = 1"""
)
def crossreference_nodes(spark, sf):
    return build.entity_nodes(_law(spark, sf), "CrossReference").select("source_doc", "target_doc", "reference_type", "text")


BUILT = f"""WITH r AS ({CANONICAL}), x AS (SELECT r.id, r.t FROM r), d AS (SELECT DISTINCT lower(array_to_string(string_split(text, ' ')[1:4], ' ')) AS t FROM benchmark),
s AS (SELECT source AS s FROM documents UNION SELECT 'benchmark' UNION SELECT p_brand FROM part),
q AS (SELECT DISTINCT a.id AS src, b.id AS dst FROM (SELECT DISTINCT x.id, lower(d.text) AS t FROM x JOIN documents d ON {STRIPPED.format('lower(d.text)')} = x.t) a
  JOIN (SELECT DISTINCT x.id, lower(substr(d.text, 1, 100)) AS t FROM x JOIN documents d ON {STRIPPED.format('lower(d.text)')} = x.t WHERE length(substr(d.text, 1, 100)) > 30) b ON contains(a.t, b.t) AND a.id <> b.id),
"""


@query(
    BUILT + f"""o AS (SELECT d.doc_id, source, lang, quality = 1 AS m, {NODE_ID} AS id, list_distinct(list_filter(string_split_regex(lower(text), '\\s+'), lambda w: length(w) > 4)) AS w FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE quality IS NOT NULL)
SELECT * FROM (SELECT 'Requirement' AS kind, count(*) AS count FROM x UNION ALL SELECT 'Definition', count(*) FROM (SELECT DISTINCT {STRIPPED.format("t")} FROM d) UNION ALL SELECT 'Exemption', count(DISTINCT {STRIPPED.format("lower(text)")}) FROM benchmark
UNION ALL SELECT 'Process', count(DISTINCT lower(p_name)) FROM part UNION ALL SELECT 'Regulation', count(*) FROM s
UNION ALL SELECT 'CONTAINS', count(*) FROM x UNION ALL SELECT 'DEFINES', count(*) FROM x JOIN d ON contains(x.t, d.t) UNION ALL SELECT 'APPLIES_TO', count(*) FROM x JOIN (SELECT DISTINCT lower(p_name) AS p FROM part) ON contains(x.t, p)
UNION ALL SELECT 'REQUIRES', count(*) FROM q UNION ALL SELECT 'CONFLICTS_WITH', count(*) FROM (SELECT DISTINCT a.id, b.id FROM o a JOIN o b ON a.lang = b.lang AND a.doc_id < b.doc_id AND a.source <> b.source AND a.m <> b.m
  WHERE len(list_intersect(a.w, b.w)) >= 3 AND a.id IN (SELECT id FROM x) AND b.id IN (SELECT id FROM x))) WHERE count > 0"""
)
def build_stats(spark, sf):
    g = build.build_graph(tables.entities(spark, sf))
    return graph.count_by_label(g).select(F.col("label").alias("kind"), "count").unionByName(graph.count_by_type(g).select(F.col("type").alias("kind"), "count"))


@query(ORACLES["build_stats"])
def delta_build(spark, sf):
    """The entities in two batches, of each kind the first half before the second."""
    e = tables.entities(spark, sf)
    half = e.groupBy("entity_type").agg((F.max("ord") / 2).alias("half"))
    e, path = e.join(F.broadcast(half), "entity_type"), new_path(spark)  # a row a kind
    for name, some in (("first", e.where("ord <= half")), ("second", e.where("ord > half"))):
        delta.add_entities(spark, path, some.drop("half"), name)
    g = delta.grown_graph(spark, path)
    return graph.count_by_label(g).select(F.col("label").alias("kind"), "count").unionByName(graph.count_by_type(g).select(F.col("type").alias("kind"), "count"))


# ------------------------------------------------------------ retrieval


@query(
    """WITH q AS (SELECT embedding AS q FROM embeddings WHERE vec_id = (SELECT min(vec_id) FROM embeddings)), s AS (
  SELECT vec_id AS id, label, round((1 + list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(q AS DOUBLE[]))) / 2, 6) AS score FROM embeddings, q)
SELECT id, label, score, CAST(k AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY score DESC, id) AS k FROM s) WHERE k <= 3"""
)
def vector_topk(spark, sf):
    v = table(spark, sf, "embeddings").withColumnRenamed("vec_id", "id")
    q = v.orderBy("id").select("embedding").first()[0]
    return retrieve.vector_top(v, q, 3, "label").select("id", "label", "score", "rank")


@query(ORACLES["vector_topk"])
def vector_pivots(spark, sf):
    v, path = table(spark, sf, "embeddings"), new_path(spark)
    vectors.build(v, path, key="vec_id")
    return vectors.top(vectors.load(spark, path), v.orderBy("vec_id").select("embedding").first()[0], 3)


BM25 = r"""WITH t AS (SELECT doc_id, lower(coalesce(text, '')) AS x FROM documents), w AS (SELECT doc_id, list_filter(string_split_regex(x, '\s+'), lambda s: s <> '') AS w FROM t),
s AS (SELECT count(*)::DOUBLE AS n, avg(len(w)) AS a FROM w), e AS (SELECT doc_id, len(w) AS dl, unnest(w) AS term FROM w),
tf AS (SELECT term, doc_id, dl, count(*) AS tf FROM e WHERE term IN (TERMS) GROUP BY 1, 2, 3), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1)"""


@query(
    BM25.replace("TERMS", "'license', 'reserved.', 'the', 'rights'")
    + " SELECT doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / a))), 6) AS score FROM tf JOIN df USING (term), s GROUP BY doc_id ORDER BY score DESC, CAST(doc_id AS VARCHAR) LIMIT 50"
)
def keyword_bm25(spark, sf):
    return fulltext.search(_indexed(spark, sf), "the license rights reserved.?", 50).select(F.col("id").cast("long").alias("doc_id"), "score")


@query(
    r"""WITH q AS (SELECT item_id AS query_id, unnest(list_distinct(list_filter(string_split_regex(lower(replace(text, '?', '')), '\s+'), lambda t: length(t) > 2))) AS term FROM benchmark), """
    + BM25.removeprefix("WITH ").replace("WHERE term IN (TERMS)", "WHERE term IN (SELECT term FROM q)")
    + """, r AS (SELECT query_id, doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / a))), 6) AS score FROM tf JOIN df USING (term) JOIN q USING (term), s GROUP BY 1, 2)
SELECT query_id, CAST(doc_id AS VARCHAR) AS node_id, score, CAST(k AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, CAST(doc_id AS VARCHAR)) AS k FROM r) WHERE k <= 5"""
)
def batch_retrieval(spark, sf):
    found = fulltext.search_all(_indexed(spark, sf), table(spark, sf, "benchmark"), 5, key="item_id", text="text")
    return found.select(F.col("item_id").alias("query_id"), F.col("id").alias("node_id"), "score", "rank")


_indexes: dict = {}


def _indexed(spark, sf):
    """The documents' full-text index: two segments, written once for a session and the table as it is now."""
    docs = table(spark, sf, "documents")
    key = (spark.sparkContext.applicationId, sf, docs.select(F.max("_metadata.file_modification_time")).first()[0])
    if key not in _indexes or not exists(spark, f"{_indexes[key]}/segments"):
        path, odd = new_path(spark), F.pmod("doc_id", F.lit(2)) == 1
        fulltext.add(docs.where(~odd), path, "doc_id")
        fulltext.add(docs.where(odd), path, "doc_id")
        _indexes.clear()
        _indexes[key] = path
    return fulltext.load(spark, _indexes[key])


#: DuckDB counts edits in bytes: letters beyond ASCII become capitals, which no word in lower case has.
ONE_BYTE = "translate({}, 'àâäáçéèêëîïíìñôöóòùûüúßœæ¿¡', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ#')"


# questions in words that the turns may have in another spelling
@query(
    rf"""WITH a AS (SELECT item_id, unnest(list_distinct(list_filter(string_split_regex(lower(replace(text, '?', '')), '\s+'), lambda t: length(t) > 2))) AS asked FROM benchmark),
d AS (SELECT conv_id || '-' || turn AS id, list_filter(string_split_regex(lower(text), '\s+'), lambda s: s <> '') AS w FROM conversations), e AS (SELECT id, len(w) AS dl, unnest(w) AS term FROM d), s AS (SELECT count(*)::DOUBLE AS n, avg(len(w)) AS a FROM d),
near AS (SELECT a.asked, v.term FROM (SELECT DISTINCT asked FROM a) a JOIN (SELECT DISTINCT term FROM e) v ON abs(length(a.asked) - length(v.term)) <= 1 AND levenshtein({ONE_BYTE.format('a.asked')}, {ONE_BYTE.format('v.term')}) <= 1),
q AS (SELECT DISTINCT item_id, term FROM a JOIN near USING (asked)), tf AS (SELECT term, id, dl, count(*) AS tf FROM e GROUP BY 1, 2, 3), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
r AS (SELECT item_id, id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / a))), 6) AS score FROM tf JOIN df USING (term) JOIN q USING (term), s GROUP BY 1, 2)
SELECT item_id, id, score, CAST(k AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, id) AS k FROM r) WHERE k <= 5"""
)
def fuzzy_batch(spark, sf):
    path = new_path(spark)
    fulltext.add(table(spark, sf, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("id"), "text"), path)
    return fulltext.search_all(fulltext.load(spark, path), table(spark, sf, "benchmark"), 5, 1, "item_id", "text")


@query("SELECT CAST(doc_id AS VARCHAR) AS id, source AS source_doc, 0.8::DOUBLE AS score FROM documents WHERE contains(lower(source), 'src1') OR contains(lower(source), 'src12') ORDER BY id LIMIT 100")
def citation_search(spark, sf):
    docs = table(spark, sf, "documents")
    g = graph.Graph(graph.as_nodes(docs, id=F.col("doc_id").cast("string"), label="Requirement", source_doc=F.col("source")), docs)
    return retrieve.citation_top(g, "What does src12 say?", 100, ("src1", "src12", "src3")).select("id", "source_doc", F.col("score").cast("double").alias("score"))


@query(
    SQL + """, s AS (SELECT * FROM (VALUES ('o1', 0.9), ('o2', 0.8), ('p3', 0.7)) v(src, score)), n AS (
  SELECT src, dst, score, row_number() OVER (PARTITION BY src ORDER BY dst) AS k FROM (SELECT DISTINCT src, dst, score::DOUBLE AS score FROM both_ways JOIN s USING (src)))
SELECT dst AS id, label, round(max(score) * 0.7, 6) AS score FROM n JOIN nodes ON dst = id WHERE k <= 3 GROUP BY 1, 2"""
)
def graph_expand(spark, sf):
    seeds = spark.createDataFrame([("o1", 0.9), ("o2", 0.8), ("p3", 0.7)], "node_id string, relevance_score double")
    return retrieve.expand(tables.stored_graph(spark, sf), seeds).select("id", "label", F.round("score", 6).alias("score"))


@query(
    """SELECT node_id, relevance_score, ord FROM (SELECT CAST(user_id AS VARCHAR) AS node_id, round(value / 1000, 6) AS relevance_score, event_id AS ord,
  row_number() OVER (PARTITION BY user_id ORDER BY round(value / 1000, 6) DESC, event_id) AS k FROM events) WHERE k = 1 AND relevance_score >= 0.01 ORDER BY relevance_score DESC, ord LIMIT 100"""
)
def hybrid_fuse(spark, sf):
    c = table(spark, sf, "events").select(F.col("user_id").cast("string").alias("node_id"), F.round(F.col("value") / 1000, 6).alias("relevance_score"), F.col("event_id").alias("ord"))
    return retrieve.fuse(c, 100, 0.01)


# nodes are the documents that have a vector; the question's vector is the first one
HYBRID = r"""WITH n AS (SELECT 'd' || doc_id AS id, text, embedding FROM documents JOIN embeddings ON vec_id = doc_id), q AS (SELECT embedding AS q FROM embeddings WHERE vec_id = (SELECT min(vec_id) FROM embeddings)),
v AS (SELECT *, row_number() OVER (ORDER BY score DESC, id) AS ord FROM (SELECT id, round((1 + list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(q AS DOUBLE[]))) / 2, 6) AS score FROM n, q) ORDER BY score DESC, id LIMIT 20),
w AS (SELECT id, list_filter(string_split_regex(lower(coalesce(text, '')), '\s+'), lambda s: s <> '') AS w FROM n), s AS (SELECT count(*)::DOUBLE AS n, avg(len(w)) AS a FROM w),
e AS (SELECT id, len(w) AS dl, unnest(w) AS term FROM w), tf AS (SELECT term, id, dl, count(*) AS tf FROM e WHERE term IN ('the', 'and', 'license') GROUP BY 1, 2, 3), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
b AS (SELECT id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / a))), 6) AS score FROM tf JOIN df USING (term), s GROUP BY id ORDER BY score DESC, id LIMIT 20),
k AS (SELECT id, score, 1000 + row_number() OVER (ORDER BY score DESC, id) AS ord FROM (SELECT id, least(score / 10, 1.0) AS score FROM b)),
f AS (SELECT id, score, ord, 'vector' AS m FROM v UNION ALL SELECT id, score, ord, 'keyword' FROM k), seeds AS (SELECT id AS src, score FROM f ORDER BY score DESC, ord LIMIT 3),
g AS (SELECT 'd' || doc_id AS src, 'd' || (doc_id + 1) AS dst FROM documents), ends AS (SELECT src, dst FROM g UNION ALL SELECT dst, src FROM g),
near AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY dst) AS r FROM (SELECT DISTINCT src, dst, score FROM ends JOIN seeds USING (src))),
x AS (SELECT dst AS id, max(score) * 0.7 AS score FROM near JOIN n ON n.id = dst WHERE r <= 3 GROUP BY 1),
every AS (SELECT * FROM f UNION ALL SELECT id, score, 3000 + row_number() OVER (ORDER BY score DESC, id), 'graph' FROM x)
SELECT id AS node_id, m AS retrieval_method, round(score, 6) AS relevance_score, ord FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, ord) AS r FROM every) WHERE r = 1 AND score >= 0.2 ORDER BY score DESC, ord LIMIT 20"""


@query(HYBRID)
def hybrid_retrieve(spark, sf):
    docs, vectors = table(spark, sf, "documents"), table(spark, sf, "embeddings")
    with_vectors = docs.join(vectors.select(F.col("vec_id").alias("doc_id"), "embedding"), "doc_id")
    nodes = graph.as_nodes(with_vectors, id=F.concat(F.lit("d"), "doc_id"), label="Requirement", source_doc=F.col("source"), category=F.col("lang"), citation_text=F.concat_ws(" ", "source", "doc_id"))
    nodes = written(nodes)  # each way of retrieval reads them
    following = docs.select(F.concat(F.lit("d"), "doc_id").alias("src"), F.concat(F.lit("d"), F.col("doc_id") + 1).alias("dst"))
    first = vectors.orderBy("vec_id").select("embedding").first()[0]
    found = retrieve.retrieve(graph.Graph(nodes, graph.as_edges(following, "REFERENCES")), "the and of license", 20, provider=lambda question: first)
    return found.select("node_id", "retrieval_method", F.round("relevance_score", 6).alias("relevance_score"), "ord")


@query(
    SQL + """SELECT DISTINCT e.src AS id, 0.9::DOUBLE AS score FROM edges e JOIN nodes p ON e.dst = p.id JOIN nodes r ON e.src = r.id AND r.label = 'Requirement'
WHERE e.type = 'APPLIES_TO' AND p.label = 'Process' AND contains(lower(p.name), 'ring') ORDER BY id LIMIT 200"""
)
def by_process(spark, sf):
    return retrieve.by_process(tables.stored_graph(spark, sf), "Ring", 200).select("id", F.col("score").cast("double").alias("score"))


@query(SQL + "SELECT id, term, 0.95::DOUBLE AS score FROM nodes WHERE label = 'Definition' AND contains(lower(term), '00000001') ORDER BY id LIMIT 50")
def definitions_of(spark, sf):
    return retrieve.definitions(tables.stored_graph(spark, sf), "00000001", 50).select("id", "term", F.col("score").cast("double").alias("score"))


# the three requirements of the highest price as contexts
@query(
    SQL + """, s AS (SELECT 'o' || o_orderkey AS src FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 3),
n AS (SELECT src, dst, type, row_number() OVER (PARTITION BY src ORDER BY dst, type) AS k FROM (SELECT DISTINCT src, dst, type FROM both_ways JOIN s USING (src) WHERE type IN ('APPLIES_TO', 'REQUIRES')))
SELECT id, coalesce(text, name, term) AS text, citation_text, type FROM n JOIN nodes ON dst = id WHERE k <= 3 ORDER BY id, type LIMIT 10"""
)
def related_to_contexts(spark, sf):
    w = Window.orderBy(F.desc("o_totalprice"), "o_orderkey")
    first = table(spark, sf, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(3)
    contexts = first.select(F.concat(F.lit("o"), "o_orderkey").alias("node_id"), F.lit("Requirement").alias("node_type"), F.row_number().over(w).alias("ord"))
    return answer.related(tables.stored_graph(spark, sf), contexts)


@query("SELECT string_agg(n || ' ' || event_type, ', ' ORDER BY o) AS path FROM (SELECT event_type, count(*) AS n, min(event_id) AS o FROM (SELECT * FROM events ORDER BY event_id LIMIT 500) GROUP BY 1)")
def path_summary(spark, sf):
    return answer.path_summary(table(spark, sf, "events").select(F.col("event_type").alias("node_type"), F.col("event_id").alias("ord")), 500)


@query(
    """SELECT count(*) AS models, coalesce(sum(chunks), 0)::BIGINT AS capacity FROM (
  SELECT event_type, count(*) AS chunks, avg(CAST(value > 5 AS INT)) * 100 AS s, avg(CAST(value > 2 AS INT)) * 100 AS p FROM events GROUP BY 1) WHERE s >= 20 AND p >= 50"""
)
def recommended_capacity(spark, sf):
    runs = table(spark, sf, "events").select(F.col("event_type").alias("model"), (F.col("value") > 5).alias("success"), (F.col("value") > 2).alias("parsed"), F.col("user_id").alias("entities"), F.col("value").alias("seconds"))
    return extract.capacity(extract.recommended(extract.benchmark(runs), 20, 50), "chunks").select("models", F.col("capacity").cast("long").alias("capacity"))


@query("SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderkey LIMIT 700 OFFSET 300")
def part_of_orders(spark, sf):
    return graph.part_of(table(spark, sf, "orders").select("o_orderkey", "o_custkey"), "o_orderkey", 300, 700)


# ------------------------------------------------------------ functions and sources


@query(
    r"""SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'MHRA' WHEN doc_id % 5 IN (1, 2) THEN 'EU GMP' WHEN doc_id % 5 = 3 THEN 'ICH' ELSE 'Unknown' END AS source,
  round((len(list_filter(string_split_regex(text, '\s+'), lambda w: w <> '')) * 1.3)::DOUBLE, 6) AS tokens, 'd_' || doc_id || '_html' AS document FROM documents"""
)
def source_and_tokens(spark, sf):
    path = F.concat(F.lit("/x/"), F.element_at(F.array(*map(F.lit, ("MHRA_ich", "eu_gmp", "EudraLex", "ICH", "other"))), (F.col("doc_id") % 5 + 1).cast("int")), F.lit("/d.html"))
    rows = table(spark, sf, "documents").select("doc_id", "text", path.alias("path"), F.concat(F.lit("d."), "doc_id", F.lit(".html")).alias("file"))
    return rows.select("doc_id", fn.source_of_path("path").alias("source"), F.round(fn.token_estimate("text"), 6).cast("double").alias("tokens"), files.document_id(F.col("file")).alias("document"))


# the pages' links as if they led to PDFs
@query(
    r"""WITH l AS (SELECT url, unnest(regexp_extract_all(html, 'href="([^"]+)"', 1)) || '.PDF' AS href FROM pages)
SELECT DISTINCT CASE WHEN regexp_matches(href, '^[a-zA-Z][a-zA-Z0-9+.-]*://') THEN href ELSE regexp_extract(url, '^[a-zA-Z]+://[^/?#]*') || CASE WHEN href[1] = '/' THEN '' ELSE '/' END || href END AS url,
  regexp_extract(href, '[^/]*$') AS filename FROM l"""
)
def pdf_links(spark, sf):
    pages = table(spark, sf, "pages").withColumn("html", F.regexp_replace("html", r'href="([^"]+)"', r'href="$1.PDF"'))
    return files.pdf_links(pages, "mhra")


@query(
    r"""WITH w AS (SELECT doc_id, list_distinct(list_filter(string_split_regex(lower(text), '\s+'), lambda w: length(w) > 4 AND regexp_full_match(w, '[\p{L}\p{N}]+'))) AS w FROM documents)
SELECT a.doc_id, CAST(len(list_intersect(a.w, b.w)) AS INTEGER) AS shared FROM w a JOIN w b ON b.doc_id = a.doc_id + 1"""
)
def word_overlap(spark, sf):
    w = table(spark, sf, "documents").select("doc_id", fn.significant_words("text").alias("w"))
    b = w.select((F.col("doc_id") - 1).alias("doc_id"), F.col("w").alias("v"))
    return w.join(b, "doc_id").select("doc_id", fn.shared_words("w", "v").alias("shared"))


@query(r"""SELECT page_id, coalesce(nullif(trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), ' '), ''), nullif(trim(regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1), ' '), ''), 'Unknown') AS title FROM pages""")
def html_title(spark, sf):
    return files.title(table(spark, sf, "pages")).select("page_id", "title")


def _without(html: str) -> str:
    for tag in ("script", "style", "nav", "header", "footer"):
        html = f"regexp_replace({html}, '(?is)<{tag}[ >].*?</{tag}>', '<i>', 'g')"
    return f"regexp_replace({html}, '(?s)<!--.*?-->', '<i>', 'g')"


# as HTML has it, the ; may be missing: of old names wherever they stand, of numbers before what is no digit, twice as one may begin where another ends
def _unescaped(text: str) -> str:
    for number, digits in (("#39", "0-9"), ("#x27", "0-9A-Fa-f")) * 2:
        text = f"regexp_replace({text}, '&{number}(;|([^;{digits}])|$)', '''\\2', 'g')"
    for name, c in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("copy", "©"), ("middot", "·"), ("nbsp", " "), ("amp", "&")):
        text = f"regexp_replace({text}, '&{name};?', '{c}', 'g')"
    return text


# white space beyond ASCII too
BARE = r"regexp_replace({}, '^[\s\v\x1c-\x1f\x85\p{{Z}}]+|[\s\v\x1c-\x1f\x85\p{{Z}}]+$', '', 'g')"


# behind each page's h1 a <p> stays open to the end of the article: the one sibling, with all texts of it in one
@query(
    f"""WITH b AS (SELECT page_id, html, {_without("html")} AS b FROM pages), h AS (SELECT page_id, html, regexp_extract(b, '(?is)<h1[^>]*>(.*?)</h1>', 1) AS h, regexp_extract(b, '(?is)</h1>(.*?)</article>', 1) AS rest FROM b)
SELECT page_id, {BARE.format(_unescaped("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)"))} AS title, 'section_1' AS section_id, {BARE.format(_unescaped("h"))} AS heading,
  array_to_string(list_filter(list_transform(string_split_regex(rest, '<[^>]*>'), lambda x: {BARE.format(_unescaped("x"))}), lambda x: x <> ''), '') AS content, CAST(1 AS INTEGER) AS level FROM h"""
)
def html_sections(spark, sf):
    parsed = files.parse_html(table(spark, sf, "pages"))
    return parsed.select("page_id", "title", F.explode("sections").alias("s")).select("page_id", "title", "s.section_id", "s.heading", "s.content", "s.level")


@query(f"SELECT 'Requirement' AS label, id AS value, count(*) AS count FROM (SELECT {NODE_ID} AS id FROM documents) GROUP BY id HAVING count(*) > 1")
def uniqueness_check(spark, sf):
    nodes = graph.as_nodes(table(spark, sf, "documents"), id=fn.node_id(F.lit("Requirement"), "source", "text"), label="Requirement")
    return graph.duplicates(graph.Graph(nodes, nodes))


# the rules written out again, not taken from the router, so that a slip there shows
@query(
    r"""WITH q AS (SELECT lower(text) AS t FROM conversations), k AS (SELECT CASE
  WHEN regexp_matches(t, '(^|\W)(exempt|exception)') THEN 'exemption' WHEN regexp_matches(t, '(^|\W)(difference|compare|(versus|vs)(\W|$))') THEN 'comparative'
  WHEN regexp_matches(t, '(^|\W)(mention|cross-reference|cite)') THEN 'cross_reference' WHEN regexp_matches(t, '(^|\W)((step|steps|how to)(\W|$)|procedure)') THEN 'procedural'
  WHEN regexp_matches(t, '^list(\W|$)|(^|\W)list all(\W|$)') THEN 'listing' WHEN regexp_matches(t, '^(when|where)(\W|$)|(^|\W)under what(\W|$)') THEN 'conditional'
  WHEN regexp_matches(t, '^what is(\W|$)|(^|\W)(defin|meaning(\W|$))') THEN 'definition' WHEN regexp_matches(t, '(^|\W)(require|comply|compliance)') THEN 'requirement'
  ELSE 'complex' END AS query_type FROM q)
SELECT query_type, CASE WHEN query_type = 'definition' THEN 3 WHEN query_type = 'requirement' THEN 7 WHEN query_type IN ('listing', 'complex') THEN 10 WHEN query_type IN ('comparative', 'procedural') THEN 6
  WHEN query_type = 'cross_reference' THEN 8 ELSE 5 END AS top_k, count(*) AS questions FROM k GROUP BY 1, 2"""
)
def route_questions(spark, sf):
    return router.classify(table(spark, sf, "conversations"), "text").groupBy("query_type", "top_k").agg(F.count("*").alias("questions"))


@query(
    """SELECT event_type AS model, count(*) AS chunks, round(avg(CAST(value > 5 AS INT)) * 100, 6) AS success_rate, round(avg(CAST(value > 2 AS INT)) * 100, 6) AS parse_rate,
  round(avg(user_id), 6) AS avg_entities, round(avg(value), 6) AS avg_seconds FROM events GROUP BY 1"""
)
def model_benchmark(spark, sf):
    runs = table(spark, sf, "events").select(F.col("event_type").alias("model"), (F.col("value") > 5).alias("success"), (F.col("value") > 2).alias("parsed"), F.col("user_id").alias("entities"), F.col("value").alias("seconds"))
    made = extract.benchmark(runs)
    return made.select("model", "chunks", *(F.round(c, 6).alias(c) for c in ("success_rate", "parse_rate", "avg_entities", "avg_seconds")))


ENTITIES = """SELECT 'Requirement' AS entity_type, source AS source_doc FROM documents UNION ALL SELECT 'Definition', 'benchmark' FROM benchmark
UNION ALL SELECT 'Exemption', 'benchmark' FROM benchmark UNION ALL SELECT 'Process', p_brand FROM part"""


@query(f"SELECT entity_type, count(*) AS entities FROM ({ENTITIES}) GROUP BY 1")
def entity_counts(spark, sf):
    return extract.counts(tables.entities(spark, sf), "entity_type")


@query(f"SELECT source_doc, count(*) AS entities FROM ({ENTITIES}) GROUP BY 1")
def entity_counts_by_source(spark, sf):
    return extract.counts(tables.entities(spark, sf), "source_doc")


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
