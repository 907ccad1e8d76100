"""The composed jobs: files to chunks, chunks to entities, many questions to answers; and what tells of them."""

import json
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from lawmesh.operators import answer, build, conflict, extract, graph, ingest, paths, retrieve
from lawmesh.operators.graph import Graph, as_edges, as_nodes
from lawmesh.operators.store import small
from lawmesh.plans import templates
from lawmesh.plans.sample import sample_graph
from lawmesh.schema import ENTITY
from lawmesh.sources import files
from tests.test_graph import entity, sample  # noqa: F401

AT = "2026-01-02 03:04:05"


def test_files_to_chunks(spark, tmp_path):
    page = "<html><title>T</title><nav>menu</nav><h1>Chapter A</h1><p>" + "A sentence of more than twenty characters. " * 60 + "</p><h2>Part</h2><p>short</p></html>"
    (tmp_path / "mhra").mkdir()
    (tmp_path / "mhra" / "a.b.html").write_text(page)
    (tmp_path / "note.txt").write_text("x")
    (tmp_path / "bad.pdf").write_bytes(b"no pdf")
    out = str(tmp_path / "out")
    stats = files.ingest_documents(spark, f"{tmp_path}/[!o]*", out, AT).first()
    parsed = {r.filename: r for r in spark.read.parquet(f"{out}/parsed").collect()}
    assert parsed["note.txt"].error.endswith(".txt") and parsed["bad.pdf"].error and parsed["a.b.html"].error is None
    assert (parsed["a.b.html"].doc_id, parsed["a.b.html"].source) == ("a_b_html", "MHRA")
    made = spark.read.parquet(f"{out}/chunks")
    assert stats.total_chunks == made.count() == stats.with_embeddings > 2
    assert {r.section_id for r in made.collect()} == {"section_1", "section_2"}
    assert made.where("created_at is null").count() == 0 and {len(r.embedding) for r in made.collect()} == {384}


def test_text_without_tags_is_parted_by_headings(spark):
    rows = [("d", "MHRA", "Chapter 1: One\nbody\nChapter 2: Two\nmore", []), ("e", "ICH", "plain", None), ("f", "ICH", "", [])]
    d = spark.createDataFrame(rows, "doc_id string, source string, full_text string, sections array<struct<section_id: string, heading: string, content: string, level: int, page_num: int>>")
    assert sorted((r.doc_id, r.section_id, r.content) for r in files.all_sections(d).collect()) == [("d", "chapter_1", "body"), ("d", "chapter_2", "more"), ("e", "section_1", "plain")]


def test_rows_of_one_id_keep_their_own_sections(spark):
    d = spark.createDataFrame([("a", "Chapter 1: X\none\ntwo"), ("a", "Chapter 2: Y\nthree")], "doc_id string, full_text string")
    assert sorted((r.section_id, r.content) for r in ingest.sections(d).collect()) == [("chapter_1", "one\ntwo"), ("chapter_2", "three")]


GOOD = json.dumps({"requirements": [{"text": "must be clean", "category": "c", "mandatory": True}]})


def chunks(spark, n):
    return spark.createDataFrame([(f"c{i:02}", "t" * (300 if i % 3 else 50) + str(i), "EU GMP", "1", None) for i in range(n)], "chunk_id string, text string, source string, section_id string, section_heading string")


def test_extraction_goes_on_where_it_broke_off(spark, tmp_path):
    path, seen = str(tmp_path / "x"), str(tmp_path / "asked")

    def provider(texts):
        with open(seen, "a") as f:
            f.writelines(t[-4:] + "\n" for t in texts)
        return [GOOD if len(t) > 100 else "{}" for t in texts]

    first = extract.run_extraction(chunks(spark, 12), provider, path, batch=5, most=6)
    assert (first["total_chunks"], first["by_type"]) == (6, {"Requirement": 4})
    both = extract.run_extraction(chunks(spark, 12), provider, path, batch=5)
    assert (both["total_chunks"], both["entities"], both["failed"]) == (12, 8, 0)
    again = extract.run_extraction(chunks(spark, 12), provider, path, batch=5)
    assert again == both
    asked = open(seen).read().split()
    assert len(asked) == len(set(asked)) == 12  # nothing is asked twice, also where nothing was found
    e = extract.read_extraction(spark, path)
    assert e.select("source_chunk_id").distinct().count() == 8 and {r.source_doc for r in e.collect()} == {"EU GMP"}
    assert extract.estimated_seconds(chunks(spark, 15), 4.0, 2, spark.read.parquet(f"{path}/processed")) == 6.0


def test_extraction_statistics_are_written(spark, tmp_path):
    extract.run_extraction(chunks(spark, 5), lambda texts: [GOOD if i else None for i, _ in enumerate(texts)], str(tmp_path))
    told = spark.read.schema(extract.STATS).json(str(tmp_path / "statistics")).first()
    assert told.total_chunks == 5 and told.successful + told.failed == 5 and told.by_type == {"Requirement": told.entities}


def test_models_take_turns():
    waits, calls = [], []

    def failing(question):
        calls.append("a")
        raise RuntimeError

    def empty(question):
        calls.append("b")
        return "{}"

    def good(question):
        calls.append("c")
        return GOOD

    r = extract.Rotation(failing, empty, good, sleep=waits.append)
    assert r(["x" * 300]) == [GOOD] and calls == ["a"] * 3 + ["b", "c"] and waits == [2, 4]
    assert extract.Rotation(empty, good, sleep=waits.append)(["short"]) == ["{}"]  # little text may hold nothing
    waits.clear()
    assert extract.Rotation(failing, tries=2, sleep=waits.append)(["x" * 300]) == [None] and waits == [2, 60, 2]
    assert "must" in extract.prompt("it must", "MHRA", "1") and "requirements" in extract.prompt("it must")


def test_repair_is_quick_and_keeps_whole_values():
    items = ", ".join(json.dumps({"text": f"t{i}", "category": "c"}) for i in range(4000))
    got = json.loads(extract.repaired('{"requirements": [' + items + ', {"text": "cut o'))
    assert len(got["requirements"]) >= 4000
    assert extract.repaired("nothing") is None and extract.repaired('{"a": [1, 2') == '{"a": [1, 2]}'
    took = []
    for n in (20_000, 40_000):
        behind = '{"requirements": [{"text": bad}, ' + ", ".join(['{"text": "t"}'] * n)
        began = time.time()
        assert extract.repaired(behind) == '{"requirements": [{}]}'
        whole = '{"requirements": [' + ", ".join(['{"text": "t"}'] * n) + ', {"text": bad}, {"text": "u"'
        assert len(json.loads(extract.repaired(whole))["requirements"]) == n + 1
        took.append(time.time() - began)
    assert took[1] < 4 * took[0] + 0.5  # linear


def test_repair_closes_every_beginning_of_a_text():
    """Any cut of a text is closed as the longest of its beginnings that can be."""
    text = json.dumps({"a": [1, -2.5e3, {"b": 'x\\ "y", z: ', "c": [], "d": {}}, None, True], "é\u00e9": "\\n", "e": ["p,q", []]}) + " tail"
    for n in range(len(text) + 1):
        cut = text[:n].rstrip()
        best = None
        for at in range(len(cut) + 1):
            closing, quoted, escaped = [], False, False
            for c in cut[:at]:
                if quoted:
                    escaped, quoted = (c == "\\" and not escaped), not (c == '"' and not escaped)
                elif c == '"':
                    quoted = True
                elif c in "[{":
                    closing.append("]" if c == "[" else "}")
                elif c in "]}":
                    closing.pop()
            if quoted and at < len(cut):
                continue
            one = re.sub(r"[,:\s]+\Z", "", cut[:at]) + ('"' if quoted else "") + "".join(reversed(closing))
            if not quoted and re.search(r"[\w.+-]\Z", cut[:at]) and re.match(r"[\w.+-]", cut[at:]):
                continue  # within a number or word
            try:
                best = json.loads(one)
            except ValueError:
                continue
        got = extract.repaired(text[:n])
        assert (json.loads(got) if got else None) == best, text[:n]


def test_models_are_compared(spark):
    runs = spark.createDataFrame([("m", True, True, 2, 1.0, {"Requirement": 2}), ("m", True, False, 1, 3.0, {"Process": 1, "Requirement": 4}), ("n", False, False, 0, 1.0, None)], "model string, success boolean, parsed boolean, entities int, seconds double, by_type map<string, int>")
    by = {r.model: r for r in extract.benchmark(runs).collect()}
    assert by["m"].by_type == {"Process": 1, "Requirement": 6} and by["n"].by_type is None and by["m"].parse_rate == 50
    fit = extract.recommended(extract.benchmark(runs), parse=50).withColumn("per_day", F.lit(200))
    assert tuple(extract.capacity(fit).first()) == (1, 200)


def test_models_over_a_slice(spark, tmp_path):
    """One that answers, one that talks, one that is cut off, one that fails and one that is held back after its second call."""

    def fails(question):
        raise RuntimeError("no connection")

    calls = []

    def limited(question):
        calls.append(question)
        if len(calls) > 1:
            raise RuntimeError("HTTP 429")
        return GOOD

    models = {"good": lambda q: f"```json\n{GOOD}\n```", "talks": lambda q: "I found nothing", "cut": lambda q: GOOD[:-2] + ", ", "fails": fails, "limited": limited}
    some = chunks(spark, 12).coalesce(1)
    report = {r.model: r for r in extract.run_benchmark(some, models, str(tmp_path), start=2, count=4).collect()}
    assert {m: (r.chunks, r.success_rate, r.parse_rate, r.avg_entities, r.recommended) for m, r in report.items()} == {
        "good": (4, 100, 100, 1, True), "cut": (4, 100, 100, 1, True), "talks": (4, 0, 0, 0, False), "fails": (4, 0, 100, 0, False), "limited": (2, 50, 100, 0.5, False),
    }
    runs = spark.read.parquet(str(tmp_path / "runs"))
    assert {r.chunk_id for r in runs.where("model = 'good'").collect()} == {"c02", "c03", "c04", "c05"} and report["good"].by_type == {"Requirement": 4}
    assert {r.error for r in runs.where("model = 'fails'").collect()} == {"no connection"} and spark.read.json(str(tmp_path / "report")).count() == 5
    with pytest.raises(ValueError):
        extract.try_models(some, {}, str(tmp_path))


def test_build_is_summed_up(spark):
    e = spark.createDataFrame([entity("Requirement", "it shall be so", "MHRA", 1), entity("Process", "p", "MHRA", 2, name="so"), entity("Other", "x", "MHRA", 3)], ENTITY)
    g = build.build_graph(e, AT)
    s = build.build_summary(e, g, AT).first()
    assert (s.total_entities_processed, s.passed_over, s.nodes, s.relationships) == (3, 1, 3, 2)
    assert s.nodes_by_label == {"Process": 1, "Regulation": 1, "Requirement": 1} and s.relationships_by_type == {"APPLIES_TO": 1, "CONTAINS": 1}
    assert g.nodes.where("created_at is null or updated_at is null").count() == 0


QUESTIONS = ("What requirements apply to the process of aseptic filling?", "What is the definition of aseptic filling?", "Which MHRA rules speak of aseptic rooms?", "Are there conflicts in requirements for operators?")


def test_four_questions_end_to_end(spark, sample):  # noqa: F811
    g = Graph(retrieve.embed(sample.nodes, retrieve.embedding_text(sample.nodes)), sample.edges)
    q = spark.createDataFrame(list(enumerate(QUESTIONS)), "query_id long, query string")
    many = {r.query_id: r for r in answer.answer_batch(g, q).collect()}
    for i, question in enumerate(QUESTIONS):
        one = answer.answer(g, question)
        assert one["status"] == many[i].status == "ok"
        assert [c["node_id"] for c in one["contexts"]] == many[i].contexts
        assert (one["answer"], round(one["confidence"], 6)) == (many[i].answer, round(many[i].confidence, 6))
        assert answer.run_plan(g, question).count() >= 0
    assert answer.run_plan(g, QUESTIONS[0]).count() == 3
    assert set(templates.all_templates()) == set(templates.TEMPLATES) and "term" in templates.all_templates()["term_definitions"]


def test_batch_retrieval_is_that_of_single_questions(spark):
    r = random.Random(4)
    word = lambda: r.choice(["the"] * 6 + [f"word{i}" for i in range(40)])
    rows = [(f"n{i:03}", " ".join(word() for _ in range(r.randint(3, 30)))) for i in range(150)]
    nodes = as_nodes(spark.createDataFrame(rows, "id string, text string"), label="Requirement", source_doc=F.lit("MHRA"))
    links = spark.createDataFrame([(r.choice(rows)[0], r.choice(rows)[0]) for _ in range(200)], "src string, dst string")
    g = Graph(retrieve.embed(nodes), as_edges(links, "REQUIRES"))
    asked = [(i, " ".join(word() for _ in range(5)) + (" mhra" if i % 2 else "")) for i in range(6)]
    q = spark.createDataFrame(asked, "query_id long, query string")
    got = {}
    for x in sorted(retrieve.retrieve_all(g, q, 8).collect(), key=lambda x: x.rank):
        got.setdefault(x.query_id, []).append((x.node_id, round(x.relevance_score, 5)))
    for i, text in asked:
        assert got[i] == [(x.node_id, round(x.relevance_score, 5)) for x in retrieve.retrieve(g, text, 8).collect()]
    assert [x.query_id for x in retrieve.retrieve_all(g, q.limit(0), 8).collect()] == []
    top = {(x.query_id, x.id): x.score for x in retrieve.keyword_all(nodes, q, 150).collect()}
    for x in retrieve.keyword_all(nodes, q, 3).collect():
        assert top[x.query_id, x.id] == x.score


def test_batches_of_texts_reach_the_model(spark):
    class Model:
        def many(self, texts):
            return [[float(len(texts)), float(len(t))] for t in texts]

    got = retrieve.embed(spark.createDataFrame([(str(i),) for i in range(40)], "text string").coalesce(1), provider=Model()).collect()
    assert max(r.embedding[0] for r in got) == 32


def test_entity_conflicts_against_all_pairs(spark):
    r = random.Random(5)
    rows = [(i, r.choice("ab"), bool(i % 2), f"s{i % 3}", " ".join(r.choice([f"words{k}" for k in range(9)] + ["common"] * 9) for _ in range(6))) for i in range(60)]
    d = spark.createDataFrame(rows, "ord long, category string, mandatory boolean, source_doc string, text string")
    got = conflict.entity_conflicts(d).count()
    words = [set(x[4].split()) for x in rows]
    assert got == sum(a[1] == b[1] and a[2] != b[2] and a[3] != b[3] and len(words[i] & words[j]) >= 3 for i, a in enumerate(rows) for j, b in enumerate(rows) if i < j)


def test_entity_conflicts_by_tiles(spark):
    """Small tiles give the pairs that one gives, and nothing wide is joined to pairs."""
    r = random.Random(8)
    rows = [(i, r.choice("ab"), bool(r.random() < 0.3), r.choice(["s", "t", None]), " ".join(r.choice([f"words{k}" for k in range(20)] + ["common"]) for _ in range(8)) or None, r.random() < 0.5) for i in range(80)]
    d = spark.createDataFrame(rows, "ord long, category string, mandatory boolean, source_doc string, text string, fresh boolean")
    words = [set(x[4].split()) for x in rows]
    want = sum(a[1] == b[1] and a[2] != b[2] and None not in (a[3], b[3]) and a[3] != b[3] and (a[5] or b[5]) and len(words[i] & words[j]) >= 3 for i, a in enumerate(rows) for j, b in enumerate(rows) if i < j)
    whole, parts = conflict.entity_conflicts(d), conflict.entity_conflicts(d, tile=5)
    assert whole.count() == want > 0 and sorted(map(tuple, whole.collect())) == sorted(map(tuple, parts.collect()))
    assert "array_intersect" not in parts._jdf.queryExecution().optimizedPlan().toString()


def test_entity_conflicts_tiles_go_to_many_tasks(spark):
    """Tiles have few bytes and many pairs: they aren't put together by their bytes."""
    rows = [(i, "a", bool(i % 2), f"s{i % 3}", "alpha bravo charlie delta") for i in range(80)]
    d = spark.createDataFrame(rows, "ord long, category string, mandatory boolean, source_doc string, text string")
    tasks = conflict.entity_conflicts(d, tile=5).groupBy(F.spark_partition_id()).count().collect()
    assert len(tasks) > 8 and sum(r["count"] for r in tasks) == sum(a[2] != b[2] and a[3] != b[3] for i, a in enumerate(rows) for b in rows[:i])


def test_entity_conflicts_by_marks(spark):
    """Of each mark, one row or the other of a pair has it."""
    r = random.Random(3)
    rows = [(i, "a", r.random() < 0.5, f"s{i % 3}", "alpha bravo charlie", r.random() < 0.3, r.random() < 0.3) for i in range(60)]
    d = spark.createDataFrame(rows, "ord long, category string, mandatory boolean, source_doc string, text string, fresh boolean, more boolean")
    want = sum(a[2] != b[2] and a[3] != b[3] and (a[5] or b[5]) and (a[6] or b[6]) for i, a in enumerate(rows) for b in rows[:i])
    assert conflict.entity_conflicts(d, tile=7).count() == want > 0


def test_many_contexts_need_a_key(spark):
    c = spark.range(1200).select(F.lit("some text of words").alias("text"), F.lit("s").alias("source_doc"), F.lit("c").alias("category"), F.lit(True).alias("mandatory"), F.lit("Low").alias("severity"), F.col("id").alias("ord"))
    with pytest.raises(ValueError):
        conflict.runtime_conflicts(c)
    opinion = lambda a, b: F.struct(F.lit("a model's").alias("reason"), F.lit(0.9).alias("confidence"))
    assert {x.reason for x in conflict.runtime_conflicts(c.limit(3), shared=0, provider=opinion).collect()} == {"a model's"}


def test_parts_and_small_sides(spark):
    d = spark.range(30)
    assert [r.id for r in graph.part_of(d, "id", 5, 3).collect()] == [5, 6, 7]
    hinted = lambda df: "ResolvedHint" in df._jdf.queryExecution().analyzed().toString()
    assert hinted(small(d, 30)) and not hinted(small(d, 29))


def test_links_in_any_quotes(spark):
    page = "<a href='/x/a.pdf'>a</a><a href=\"b.pdf\">b</a><a href=c.PDF>c</a><a data-href='d.pdf'>d</a>"
    d = spark.createDataFrame([("http://h.org/p", page)], "url string, html string")
    assert {r.url for r in files.pdf_links(d, "mhra").collect()} == {"http://h.org/x/a.pdf", "http://h.org/b.pdf", "http://h.org/c.PDF"}


def test_links_of_several_sources(spark, tmp_path):
    rows = [("mhra", "http://h.org/p", "<a href='/x.pdf'>x</a>"), ("EU", "http://e.org/p", "<a href='/annex1.pdf'>x</a><a href='/other.pdf'>y</a>"), ("none", "http://n.org", "<a href='/z.pdf'>z</a>")]
    d = spark.createDataFrame(rows, "source string, url string, html string")
    got = files.links_by_source(d)
    assert {tuple(r) for r in got.collect()} == {("mhra", "http://h.org/x.pdf", "x.pdf"), ("eu", "http://e.org/annex1.pdf", "annex1.pdf")}
    assert files.links_by_source(d, ("mhra", "unknown")).count() == 1
    files.write_records(got, str(tmp_path / "records"), AT)
    assert {(r.source, r.landed_at) for r in spark.read.json(str(tmp_path / "records")).collect()} == {("mhra", AT), ("eu", AT)}


def test_sample_graph(spark, tmp_path):
    g = sample_graph(spark)
    assert templates.requirements_for_process(g, "aseptic filling").count() == 3 and templates.search_requirements(g, "aseptic").count() == 3
    assert {r.source for r in templates.related_requirements(g, "sample-req-001").collect()} == {"MHRA GMP 5.1.2", "MHRA GMP 5.1.3"}
    assert templates.citation_context(g, "MHRA GMP").count() == 6
    assert paths.shortest_path(g, "sample-req-001", "sample-req-002").first().nodes == ["sample-req-001", "sample-proc-001", "sample-req-002"]
    assert [r.length for r in paths.all_paths(g, "sample-reg-001", "sample-proc-001", 4).collect()] == [4, 4, 4]
    files.export_graph(Graph(graph.stamped(g.nodes, AT), g.edges), str(tmp_path / "x"))
    assert {r.created_at for r in spark.read.option("inferTimestamp", False).json(str(tmp_path / "x" / "nodes")).collect()} == {AT.replace(" ", "T")}
