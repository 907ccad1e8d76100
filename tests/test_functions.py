import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from lawmesh.functions import text as fn
from lawmesh.operators import conflict, extract, ingest
from lawmesh.plans import router
from lawmesh.sources import files


def one(spark, expr, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return df.select(expr).first()[0]


def test_node_id(spark):
    assert one(spark, fn.node_id(F.lit("Requirement"), "s", "t"), s="EU GMP", t="  Abc ") == "requirement_eu_gmp_90015098"
    assert one(spark, fn.node_id(F.lit("Process"), "s", "t"), s="a", t=None) == "process_a_" + hashlib.md5(b"unknown").hexdigest()[:8]
    assert len(one(spark, fn.node_id(F.lit("Process"), "s", "t", 32), s="a", t="x").split("_")[-1]) == 32


def test_strip_without_pattern(spark):
    """The characters taken off are those that the pattern takes, and no pattern is held against each place of a text."""
    every = [(f"{chr(k)}a{chr(k)} b{chr(k)}\n",) for k in range(1, 0x10000) if not 0xD800 <= k < 0xE000] + [(None,), ("",), (" \t\u3000",), ("\r\n x \r\n\n",)]
    got = spark.createDataFrame(every, "t string").select("t", fn.strip("t").alias("got"), F.regexp_replace("t", r"(?U)^\s+|\s+$", "").alias("want"))
    assert got.where("not got <=> want").count() == 0
    assert "regexp_replace" not in got.select("got")._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize(
    ("line", "want"),
    [
        ("Chapter 5: Production", ("chapter_5", 1)), ("Section 5.1 Scope", ("section_5.1", 2)), ("5.1.2 Air", ("section_5.1.2", 3)), ("10 items", ("section_10", 1)), ("Chapter 12", ("chapter_1", 1)),
        ("GENERAL PRINCIPLES", (None, 1)), ("ABCD", (None, 1)), ("Article 3", None), ("Section 5", None), ("5 items", None), ("QA", None), ("ABC", None), ("chapter 1: x", None), ("A" * 100, None),
    ],
)
def test_headings(spark, line, want):
    h = one(spark, ingest.heading(F.col("x")), x=line)
    assert (h and (h.section_id, h.level)) == want


def test_sections(spark):
    d = spark.createDataFrame([("a", "before\nChapter 1: One\n x \n\ny\nALL CAPS HERE\nz"), ("b", "no heading\nat all"), ("c", "")], "doc_id string, full_text string")
    got = {(r.doc_id, r.ord): (r.section_id, r.content, r.level) for r in ingest.sections(d).collect()}
    assert got == {("a", 1): ("chapter_1", "x\ny", 1), ("a", 2): ("section_2", "z", 1), ("b", 1): ("section_1", "no heading\nat all", 1), ("c", 1): ("section_1", "", 1)}


def plain_chunks(content, size, longer, whole):
    if len(content.strip()) < whole:
        return [content.strip()]
    out, now, length = [], [], 0
    for s in (x.strip() for x in re.split(r"(?<=[.!?])\s+", content)):
        if len(s) <= longer:
            continue
        if length + len(s) > size and now:
            out.append(" ".join(now))
            over = " ".join(now[-2:]) if len(now) > 2 else ""
            now, length = ([over, s] if over else [s]), len(over) + len(s)
        else:
            now.append(s)
            length += len(s)
    return [c.strip() for c in out + ([" ".join(now)] if now else [])]


def test_chunks(spark):
    r = random.Random(3)
    texts = ["aaaa. bbbb. cccc. dddd. eeee.", "", "short.", "a. b. c. " * 20] + [" ".join("w" * r.randint(1, 9) + r.choice(["", "", ".", "!"]) for _ in range(r.randint(1, 120))) for _ in range(40)]
    rows = [(str(i), "s", "section_1", "h", t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id string, source string, section_id string, heading string, content string")
    for size, longer, whole in ((11, 2, 10), (60, 3, 20), (1000, 20, 100)):
        got = {}
        for c in ingest.chunks(df, size, longer, whole).orderBy("doc_id", "chunk_index").collect():
            got.setdefault(c.doc_id, []).append(c.text)
            assert c.chunk_id == f"{c.doc_id}_section_1_{c.chunk_index}"
        assert [got.get(str(i), []) for i in range(len(texts))] == [plain_chunks(t, size, longer, whole) for t in texts]


CONTEXTS = "text string, source_doc string, category string, mandatory boolean, severity string, ord long"
TWO = ("temperature monitoring shall be performed continuously at all times", "temperature monitoring may be performed periodically during storage")


@pytest.mark.parametrize(
    ("a", "b", "want"),
    [
        ((TWO[0], "A", "c", True, None), (TWO[1], "B", "c", False, None), 0.75),
        ((TWO[0], "A", None, None, None), (TWO[1], "B", None, None, None), 0.85),
        (("storage temperature limit < 5", "A", None, None, None), ("storage temperature limit > 10", "A", None, None, None), 0.8),
        (("storage temperature limit < 25", "A", None, None, None), ("storage temperature limit < 30", "B", None, None, None), None),
        (("equipment cleaning process shall not", "A", None, None, None), ("equipment cleaning process shall not", "A", None, None, None), 0.85),
        (("equipment cleaning process daily", "A", "c", None, "Critical"), ("equipment cleaning process weekly", "B", "c", None, "Low"), 0.6),
        (("equipment cleaning process daily", "A", "c", None, "Critical"), ("equipment cleaning process weekly", "B", "c", None, "High"), None),
        (("one two", "A", "c", True, None), ("one two", "B", "c", False, None), None),
    ],
)
def test_runtime_conflicts(spark, a, b, want):
    df = spark.createDataFrame([(*a, 1), (*b, 2)], CONTEXTS)
    got = conflict.runtime_conflicts(df).collect()
    assert [r.confidence for r in got] == ([] if want is None else [want])
    if want == 0.8:
        assert got[0].reason == "Conflicting numeric ranges: <5 vs >10"


def test_entity_conflicts(spark):
    rows = [(1, "alpha bravo charlie words", "A", "c", True), (2, "charlie bravo alpha other", "B", "c", False), (3, "alpha bravo charlie", "A", "c", False), (4, "alpha bravo charlie", "B", "d", False), (5, "alpha bravo", "B", "c", False)]
    got = conflict.entity_conflicts(spark.createDataFrame(rows, "ord long, text string, source_doc string, category string, mandatory boolean")).collect()
    assert [(r.source1, r.source2, r.reason) for r in got] == [("A", "B", "c: mandatory in A but optional in B")]


@pytest.mark.parametrize(
    ("question", "want"),
    [
        ("What requirements apply to the process of aseptic filling?", ("requirements_for_process", {"process_name": "aseptic filling", "limit": 20})),
        ("What requirements apply to sterilization process?", None),
        ("What is the definition of critical process parameter?", ("term_definitions", {"term": "the definition of critical process parameter", "limit": 10})),
        ("What are the steps in batch release?", None),
        ("Find cross-references between MHRA and EU GMP Annex 1", ("cross_references", {"source_doc": "", "target_doc": "", "limit": 20})),
        ("Are there conflicts between EU GMP and ICH?", ("detect_conflicts", {"keyword": "", "limit": 20})),
        ("What GMP requirements apply to aseptic filling?", None),
    ],
)
def test_template_matching(question, want):
    assert router.match_template(question) == want


def test_routing(spark):
    assert router.parameters('find "cold chain" in eu gmp') == {"keyword": "cold chain", "source_doc": "eu gmp"}
    assert router.plan("anything else")[0] == "search_requirements"
    q = spark.createDataFrame([("What is aseptic filling?",), ("Are there exemptions?",), ("hm",)], "query string")
    got = {r.query: (r.query_type, r.top_k, r.node_focus) for r in router.classify(q).collect()}
    assert got["What is aseptic filling?"] == ("definition", 3, ["Definition", "Process"])
    assert got["Are there exemptions?"][0] == "exemption" and got["hm"] == ("complex", 10, ["Requirement", "Process", "Definition"])


def test_responses(spark):
    whole = '{"requirements": [{"text": "R one", "category": "c", "mandatory": true, "scope": null}], "definitions": [{"term": "t", "definition": "d"}], "regulations": [{"name": "N", "version": "2"}]}'
    rows = [("c1", whole), ("c2", f"```json\n{whole}\n```"), ("c3", f"```\n{whole}\n```"), ("c4", whole[:40]), ("c5", "no json"), ("c6", None), ("c7", '{"requirements": [{"text": "a"}, {"text": "b"'), ("c8", "{}")]
    df = spark.createDataFrame([(c, "doc", "s", "h", x, i) for i, (c, x) in enumerate(rows)], "chunk_id string, source_doc string, section_id string, section_heading string, response string, ord long")
    got = {}
    for e in extract.parse_responses(df).collect():
        got.setdefault(e.source_chunk_id, []).append((e.entity_type, e.text))
    three = [("Definition", "d"), ("Regulation", "N"), ("Requirement", "R one")]
    assert {k: sorted(v) for k, v in got.items()} == {"c1": three, "c2": three, "c3": three, "c4": [("Requirement", "R one")], "c7": [("Requirement", "a"), ("Requirement", "b")]}


def test_resume_and_merge(spark):
    chunks = spark.createDataFrame([(f"c{i}",) for i in range(5)], "chunk_id string")
    assert {r[0] for r in extract.remaining(chunks, chunks.limit(2), chunks.where("chunk_id = 'c4'")).collect()} == {"c2", "c3"}
    e = lambda *rows: spark.createDataFrame(rows, "source_chunk_id string, entity_type string, text string, ord long")
    got = extract.merge(e(("c", "R", "x" * 150, 5)), e(("c", "R", "x" * 120, 1), ("c", "D", "x", 2))).collect()
    assert sorted((r.entity_type, len(r.text)) for r in got) == [("D", 1), ("R", 150)]


def test_html_files(spark, tmp_path):
    (tmp_path / "eu_gmp").mkdir()
    (tmp_path / "eu_gmp" / "a.html").write_text("<html><head><title>Tí</title></head><body><nav>n</nav><h1>One</h1><p>x</p><p>y</p><h2>Two</h2>z</body></html>")
    (tmp_path / "eu_gmp" / "b.txt").write_text("?")
    (tmp_path / "c.pdf").write_bytes(b"%PDF-1.4")
    got = {r.filename: r for r in files.read_documents(spark, str(tmp_path)).collect()}
    assert (got["a.html"].title, got["a.html"].source, [(s.heading, s.content, s.level) for s in got["a.html"].sections]) == ("Tí", "EU GMP", [("One", "x\ny", 1), ("Two", "z", 2)])
    assert got["b.txt"].error and got["c.pdf"].error
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", 300)
    (tmp_path / "large.bin").write_bytes(b"x" * 1000)
    got = {r.filename: r for r in files.read_documents(spark, str(tmp_path)).collect()}
    spark.conf.unset("spark.sql.sources.binaryFile.maxLength")
    assert got["large.bin"].error.endswith(".bin") and got["a.html"].title == "Tí"


def test_sections_are_the_siblings_of_headings():
    def of(page):
        return [(s["heading"], s["content"], s["level"]) for s in files.parsed_html(page)["sections"]]

    assert of("<div><h1>A</h1><p>one <b>two</b> three</p></div><p>outside</p>") == [("A", "onetwothree", 1)]
    assert of("<h1>A</h1>x<!-- c -->y<p> z </p><div>u<h2>B <i>b</i></h2>v</div>w<h3>C</h3><script>s</script>") == [("A", "x\ny\nz\nuBbv\nw\nC", 1), ("Bb", "v", 2), ("C", "", 3)]
    assert of("<nav><h1>N</h1></nav><p>a<p>b<h2>T</h2>c</p>d") == [("T", "c", 2)]
    assert of("<h1>A</h1></p></div><br>x<h1>A</h1>y") == [("A", "x", 1), ("A", "y", 1)]
    assert of("a<b>c</b> d") == [("Full Document", "a\nc\nd", 1)] and of("") == [("Full Document", "", 1)] and files.parsed_html(None)["title"] == "Unknown"
    deep = files.parsed_html("<p>" * 20000 + "<h1>A</h1>b" + "</i>" * 20000)
    assert [s["content"] for s in deep["sections"]] == ["b"]


def test_links(spark):
    page = '<a href="/x/Annex1.PDF">a</a> <a href="https://o.org/q.pdf">b</a> <a href="c.html">c</a>'
    df = spark.createDataFrame([("https://a.org/p", page)], "url string, html string")
    assert {r.url for r in files.pdf_links(df, "mhra").collect()} == {"https://a.org/x/Annex1.PDF", "https://o.org/q.pdf"}
    assert {r.filename for r in files.pdf_links(df, "eu").collect()} == {"Annex1.PDF"}


def test_html_sections_and_their_sql_decode_references_without_semicolon(spark, tmp_path):
    import duckdb

    from lawmesh.plans import catalogue

    heads = ["a &amp;&amp", "b &quot", "c &quo", "d &am", "e&amp;lt", "f &lt;g&gt", "&nbsp;h &#39&#39&#39", "i&#x27s", "\n j &copy&middot "]
    page = "<html><head><title>{0}</title></head><body><article><h1>{0}</h1><p>x {0}<p>{0}</article></body></html>"
    spark.createDataFrame([(k, page.format(h)) for k, h in enumerate(heads)], "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    rows = lambda df: sorted(tuple(r) for r in df)
    got = rows(catalogue.html_sections(spark, str(tmp_path)).select("page_id", "title", "section_id", "heading", "content", "level").collect())
    assert [r[1] for r in got] == ["a &&", 'b "', "c &quo", "d &am", "e&lt", "f <g>", "h '''", "i's", "j ©·"]
    assert got == rows(con.execute(f"SELECT page_id, title, section_id, heading, content, level FROM ({catalogue.ORACLES['html_sections']})").fetchall())
