"""What is kept in folders and added to: the full-text index, merged tables, the vector index, graphs built by parts."""

import os
import random

import pytest
from pyspark.sql import functions as F

from lawmesh.functions.text import node_id
from lawmesh.operators import build, delta, fulltext, graph, merge, retrieve, vectors
from lawmesh.operators.graph import Graph, as_edges, as_nodes
from lawmesh.schema import ENTITY
from tests.test_graph import entity


def texts(r, n):
    words = ["the", "the", "the", "and", "clean", "room", "filter", "été", *(f"w{i}" for i in range(40))]
    return [(f"d{i:03}", " ".join(r.choice(words) for _ in range(r.randint(0, 30)))) for i in range(n)]


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def listed(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def test_index_is_that_of_all_texts(spark, tmp_path):
    """Added to in parts, with ids that it has already, it gives what a scan of all texts gives."""
    r, path = random.Random(3), str(tmp_path / "index")
    rows = texts(r, 90) + [("none", None), ("empty", "")]
    frame = lambda some: spark.createDataFrame(some, "id string, text string")
    for some in (rows[:40], rows[30:70], rows[60:]):
        fulltext.add(frame(some), path, buckets=4)
    index = fulltext.load(spark, path)
    assert index.n == len(rows)
    items = frame(rows)
    for question in ("the clean room?", "w1 w2 the and été", "nothing", "a b", "the"):
        want = [tuple(x) for x in retrieve.keyword_top(items, question, 7).collect()]
        assert [tuple(x) for x in fulltext.search(index, question, 7).collect()] == want
    asked = spark.createDataFrame([(i, " ".join(t.split()[:6]) + " the and") for i, (_, t) in enumerate(texts(r, 25))] + [(99, "w7"), (100, None)], "query_id int, query string")
    for k in (1, 5, 40):
        got = {tuple(x) for x in fulltext.search_all(index, asked, k).collect()}
        assert got == {(x.query_id, x.id, x.score, x.rank) for x in retrieve.keyword_all(items, asked, k).collect()}


def test_index_reads_the_words_of_the_question_only(spark, tmp_path):
    path = str(tmp_path / "index")
    fulltext.add(spark.createDataFrame(texts(random.Random(1), 60), "id string, text string"), path, buckets=16)
    index = fulltext.load(spark, path)
    one = fulltext.of_terms(index, index.postings, spark.createDataFrame([("clean",)], "term string"))
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert one.select("bucket").distinct().count() == 1
    assert "bucket" in plan.split("PartitionFilters: [")[1].split("]")[0] and "= clean)" in plan


def test_index_stores_lists_of_postings(spark, tmp_path):
    path, odd = str(tmp_path / "index"), [("x", "a\x1cb a\x1cb\x85c\u00a0d"), ("y", "\u2003É é\x0b")]
    items = spark.createDataFrame(texts(random.Random(4), 300) + odd, "id string, text string")
    fulltext.add(items.coalesce(2), path, buckets=2)
    index, want = fulltext.load(spark, path), retrieve.postings(items)
    rows = lambda df: sorted(tuple(x) for x in df.select("term", "id", "dl", "tf").collect())
    assert rows(index.postings) == rows(want)
    assert 5 * spark.read.parquet(f"{path}/postings").count() < want.count()
    assert sorted(rows(fulltext.listed(fulltext.inverted(items.repartition(1), 300).where("term is not null"), "term"))) == rows(want)


def test_lists_go_beyond_batches(spark, tmp_path):
    """One list of a word for a task with so little text, whatever comes at once; near words are met without functions on arrays."""
    path, kept = str(tmp_path / "index"), spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        fulltext.add(spark.createDataFrame([(f"d{i:02}", f" the  w{i} ") for i in range(50)], "id string, text string").coalesce(1), path, buckets=2)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", kept)
    index = fulltext.load(spark, path)
    assert [len(x.id) for x in index.lists.where("term = 'the'").collect()] == [50] and index.lists.where("term is null or term = ''").count() == 0
    assert index.n == 50 and index.avgdl == 2.0
    near = fulltext.near_words(spark.createDataFrame([("then",)], "asked string"), index.lists.select("term", "n"), 1)
    assert "lambda" not in near._jdf.queryExecution().toString() and [tuple(x) for x in near.select("asked", "term", "n").collect()] == [("then", "the", 50)]


def test_questions_are_scored_by_item(spark, tmp_path):
    """In small blocks and steps as all at once, with ties; no join makes rows for questions and items."""
    r, path = random.Random(5), str(tmp_path / "index")
    items = spark.createDataFrame([(f"{k}-{i}", t) for i, t in texts(r, 60) for k in range(3)], "id string, text string")
    fulltext.add(items, path)
    index = fulltext.load(spark, path)
    asked = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(texts(r, 7))], "query_id int, query string")
    found = fulltext.search_all(index, asked, 4)
    assert found._jdf.queryExecution().executedPlan().toString().count("Join") <= 1  # with the words
    want = [(x.query_id, y.id, y.score) for x in asked.collect() for y in retrieve.keyword_top(items, x.query, 4).collect()]
    assert sorted((x.query_id, x["rank"], x.id, x.score) for x in found.collect()) == sorted((k, n % 4 + 1, i, s) for n, (k, i, s) in enumerate(want))
    q = retrieve.with_idf(retrieve.question_terms(asked, "query_id", "query"), index.postings.groupBy("term").agg(F.count("*").alias("df")), index.n)
    few = retrieve.best_scored(index.postings.select("term", "id", "tf", "dl"), q, index.avgdl, 4, "query_id", block=2, cells=5)
    assert sorted(tuple(x) for x in few.collect()) == sorted(tuple(x) for x in found.collect())


def test_segment_that_broke_off_is_not_read(spark, tmp_path):
    path = str(tmp_path / "index")
    rows = texts(random.Random(2), 30)
    fulltext.add(spark.createDataFrame(rows[:20], "id string, text string"), path)
    before = [tuple(x) for x in fulltext.search(fulltext.load(spark, path), "the clean", 5).collect()]
    fulltext.add(spark.createDataFrame(rows[20:], "id string, text string"), path)
    last = sorted(listed(f"{path}/segments").items(), key=lambda x: x[1])[-1][0]
    os.remove(last)  # as if the second call had stopped before its last step
    assert [tuple(x) for x in fulltext.search(fulltext.load(spark, path), "the clean", 5).collect()] == before
    fulltext.add(spark.createDataFrame(rows[20:], "id string, text string"), path)
    assert fulltext.load(spark, path).n == 30


@pytest.mark.parametrize("most", [1, 2])
def test_near_words_against_all_pairs(spark, most):
    r = random.Random(most)
    some = lambda n: ["".join(r.choice("abé") for _ in range(r.randint(1, 14))) for _ in range(n)]
    asked, known = {*some(25), "abcdefghijklmnop", "a" * 40, "b"}, {*some(150), "bcdefghijklmnop", "abcdefghijxlmnop", "a" * 39, "a" * 42, "ab", "x" * 3000}
    got = fulltext.near_words(spark.createDataFrame([(w,) for w in asked], "asked string"), spark.createDataFrame([(w,) for w in known], "term string"), most)
    assert {tuple(x) for x in got.collect()} == {(a, b) for a in asked for b in known if abs(len(a) - len(b)) <= most and edits(a, b) <= most}


def test_fuzzy_questions(spark, tmp_path):
    path = str(tmp_path / "index")
    rows = [("a", "a sterile filter"), ("b", "sterlie filters"), ("c", "nothing of it"), ("d", "the filtre")]
    items = spark.createDataFrame(rows, "id string, text string")
    fulltext.add(items, path)
    index = fulltext.load(spark, path)
    for fuzzy in (0, 1, 2):
        assert [tuple(x) for x in fulltext.search(index, "Sterile filter?", 5, fuzzy).collect()] == [tuple(x) for x in retrieve.keyword_top(items, "Sterile filter?", 5, fuzzy).collect()]


def test_upsert_rewrites_the_parts_it_changes(spark, tmp_path):
    schema = "id string, text string, ord long"
    path = str(tmp_path / "t")
    frame = lambda rows: spark.createDataFrame(rows, schema)
    table = merge.stored(spark, path, frame([]).schema, parts=8, buckets=2)
    first = [(f"n{i}", f"t{i}", i) for i in range(200)]
    assert merge.upsert_stored(table, frame([*first, ("n1", "older", -1), (None, "x", 1)])) == 200
    before = listed(path)
    assert merge.upsert_stored(table, frame(first)) == 0 and listed(path) == before  # a second run changes nothing
    assert merge.upsert_stored(table, frame([("n5", "new", 900), ("n6", "t6", 6)])) == 1
    after = listed(path)
    parts = {f.split("_part=")[1].split("/")[0] for f in set(before) ^ set(after)}
    assert len(parts) == 1 and all(after[f] == before[f] for f in after if f.split("_part=")[1].split("/")[0] not in parts)
    assert merge.upsert_stored(table, frame([("n5", "no", 901), ("m1", "made", 1), ("m1", "later", 2)]), on_create=True) == 1
    want = {i: (t, o) for i, t, o in first} | {"n5": ("new", 900), "m1": ("later", 2)}
    again = merge.stored(spark, path, frame([]).schema, parts=8, buckets=2)  # opened anew
    assert {x.id: (x.text, x.ord) for x in again.rows().collect()} == want and table.rows().count() == len(want)


def test_upsert_shuffles_no_stored_row(spark, tmp_path):
    schema = spark.createDataFrame([], "id string, text string, ord long").schema
    a, b = (merge.stored(spark, str(tmp_path / n), schema, parts=4, buckets=2) for n in "ab")
    for t in (a, b):
        merge.upsert_stored(t, spark.createDataFrame([(f"n{i}", "t", i) for i in range(50)], schema))
    with merge.dynamic(spark):
        for plan in (merge.changes(spark.table(a.name), spark.table(b.name), a, False), merge.merged(spark.table(a.name), spark.table(b.name), a, True)):
            assert "Exchange" not in plan._jdf.queryExecution().executedPlan().toString()


def test_graph_is_merged(spark, tmp_path):
    nodes = lambda rows: as_nodes(spark.createDataFrame(rows, "id string, label string, text string"))
    links = lambda rows: as_edges(spark.createDataFrame(rows, "src string, dst string"), "REQUIRES")
    path, layout = str(tmp_path / "g"), {"parts": 2, "buckets": 2}
    one = Graph(nodes([("a", "Requirement", "x"), ("b", "Requirement", "y")]), links([("a", "b")]))
    two = Graph(nodes([("b", "Requirement", "z"), ("c", "Requirement", "w")]), links([("a", "b"), ("b", "c")]))
    assert merge.merge_graph(spark, path, one, **layout) == (2, 1)
    assert merge.merge_graph(spark, path, one, **layout) == (0, 0)
    assert merge.merge_graph(spark, path, two, **layout) == (2, 1)
    g = merge.merged_graph(spark, path, **layout)
    assert {x.id: x.text for x in g.nodes.collect()} == {"a": "x", "b": "z", "c": "w"} and g.edges.count() == 2
    assert graph.duplicates(g).count() == 0


def test_graph_built_by_batches_is_that_of_all(spark, tmp_path):
    """Three batches and one build of everything give the same nodes and edges; a batch run again changes nothing."""
    e = [
        entity("Requirement", "Aseptic filling of vials shall be validated every year.", "EU GMP", 1, category="v", mandatory=True),
        entity("Requirement", "2003/94/EC is repealed by 2017/1572/EU", "EU GMP", 2),
        entity("Definition", "d", "EU GMP", 3, term="vial"),
        entity("CrossReference", "first", "EU GMP", 4, target_doc="ICH"),
        entity("Requirement", "See: aseptic filling of vials shall be validated every year. And more words here", "MHRA", 10, category="v", mandatory=False),
        entity("Requirement", " aseptic filling of vials shall be validated every year.", "MHRA", 11, mandatory=True, category="v"),
        entity("Process", "p", "ICH", 12, name="aseptic filling"),
        entity("Exemption", "sterile filling is exempt", "EU GMP", 13),
        entity("CrossReference", "last", "EU GMP", 14, target_doc="ICH", reference_type="refers"),
        entity("Regulation", "r", "MHRA", 15, name="MHRA Orange Guide - Rules and Guidance for Pharmaceutical Manufacturers"),
        entity("Other", "x", "EU GMP", 16),
        entity("Requirement", "A vial for validated aseptic filling every year may be used without delay words", "ICH", 20, category="v", mandatory=False),
        entity("Definition", "again", "ICH", 21, term="Vial "),
        entity("Process", "q", "MHRA", 22, name="Validated"),
        entity("Regulation", "s", "EU", 23, name="Directive 2017/1572/EU on vials"),
        entity("CrossReference", "y", "EU GMP", 24, target_doc="MHRA", reference_type="Supersedes"),
    ]
    whole = build.build_graph(spark.createDataFrame(e, ENTITY))
    path, cuts = str(tmp_path / "g"), [0, 4, 11, len(e)]
    for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
        changed = delta.add_entities(spark, path, spark.createDataFrame(e[a:b], ENTITY), f"b{k}")
        assert changed[0] > 0 and delta.add_entities(spark, path, spark.createDataFrame(e[a:b], ENTITY), f"b{k}") == (0, 0)
    grown = delta.grown_graph(spark, path)
    told = lambda g: ({tuple(x) for x in g.nodes.select("id", "label", "name", "text", "term", "source_doc", "ord").collect()}, {(x.src, x.dst, x.type, x.props) for x in g.edges.collect()})
    assert told(grown)[0] == told(whole)[0] and told(grown)[1] == told(whole)[1]
    assert {x.type for x in grown.edges.collect()} >= {"CONTAINS", "APPLIES_TO", "DEFINES", "REQUIRES", "EXEMPT_FROM", "SUPERSEDES", "CONFLICTS_WITH"}


def test_vectors_by_pivots_are_those_of_a_scan(spark, tmp_path):
    r = random.Random(6)
    centres = [[r.gauss(0, 1) for _ in range(8)] for _ in range(6)]
    rows = [(i, r.choice(("a", "b", None)), [c + r.gauss(0, 0.1) for c in centres[i % 6]]) for i in range(400)]
    rows += [(500, "a", None), (501, "a", []), (502, "a", [0.0] * 8), (503, "b", [1.0, None] + [1.0] * 6), (504, "a", [float("nan")] * 8), (505, "a", [1.0, 2.0]), (506, "b", rows[0][2]), (507, "only", rows[1][2])]
    items = spark.createDataFrame(rows, "id long, label string, embedding array<float>")
    path = str(tmp_path / "v")
    vectors.build(items, path, n=6)
    index = vectors.load(spark, path)
    for q in (centres[0], [-x for x in centres[1]], rows[7][2], [1.0] * 8):
        for k in (1, 5, 300):
            got = {(x.id, x.label, x.score, x.rank) for x in vectors.top(index, q, k).collect()}
            assert got == {(x.id, x.label, x.score, x.rank) for x in retrieve.vector_top(items.where("id <> 505"), q, k, "label").collect()}
    read = {f.split("pivot=")[1].split("/")[0] for f in vectors.top(index, rows[6][2], 5).inputFiles()}
    near = vectors.top(index, rows[6][2], 5)._jdf.queryExecution().executedPlan().toString()
    pivots = near.split("PartitionFilters: [")[1].split("]")[0]
    assert len(read) <= 6 and "pivot" in pivots and not all(f"{p}" in pivots.split("IN")[-1] for p in range(6))  # some folders are not read
    assert vectors.top(index, [1.0, 2.0], 3).count() == 0 and vectors.top(index, [0.0] * 8, 3).count() == 0
    vectors.build(items.where("false"), str(tmp_path / "none"))
    assert vectors.top(vectors.load(spark, str(tmp_path / "none")), [1.0], 3).count() == 0


def test_conflicts_told_again_by_later_batches(spark, tmp_path):
    """Conflicts that one batch alone can make aren't merged; those told again have one edge, with the least properties, as if all came at once."""
    text, path = "alpha bravo charlie delta", str(tmp_path / "g")
    rows = [(1, text, "A_b", True), (2, f"{text} two", "C", False), (3, f"{text} three", "D", False), (11, text, "A b", True), (21, text, "A_b", True), (22, f"{text} two", "C", False), (23, f"{text} five", "F", False)]
    d = build.flat(spark.createDataFrame([entity("Requirement", t, s, i, category="c", mandatory=m) for i, t, s, m in rows], ENTITY))
    ids = d.select(node_id(F.lit("Requirement"), "source_doc", "text").alias("id")).distinct()
    told = lambda edges: {(x.src, x.dst): x.props.reason for x in edges.collect()}
    merged: dict = {}
    for k, (a, b) in enumerate(((0, 10), (10, 20), (20, 30))):
        both = d.where(F.col("ord") < b).withColumn("fresh", F.col("ord") > a)
        for _ in range(2):  # a batch that broke off is run again
            again = delta.add_conflicts(spark, path, both, ids, f"b{k}")
        for pair, reason in (told(again) if again else {}).items():
            merged[pair] = min(reason, merged.get(pair, reason))
    first, whole = told(delta.first_edges(spark, path)), build.conflicts_in(d, ids)
    assert delta.first_edges(spark, path).count() == len(first) == 1 and not first.keys() & merged.keys()
    assert first | merged == told(whole) and whole.count() == len(first | merged) and any("A b" in x for x in merged.values())
