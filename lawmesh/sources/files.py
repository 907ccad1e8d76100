"""Reading documents, records and graphs from files, and writing them."""

from __future__ import annotations

from collections import Counter
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lawmesh.functions.text import source_of_path
from lawmesh.operators import ingest
from lawmesh.operators.graph import Graph, totals
from lawmesh.operators.retrieve import embed
from lawmesh.schema import CHUNK, EDGE, ENTITY, NODE, PARSED

DROPPED = ("script", "style", "nav", "header", "footer")
HEADING = ("h1", "h2", "h3", "h4", "h5", "h6")
#: Elements that have no end tag.
EMPTY = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr")
#: By source: what a link's path must have beside .pdf.
CRAWLS = {"mhra": "", "eu": "annex", "uk": "", "ich": "quality"}


class Tree(HTMLParser):
    """A page's elements with their parents, children and order, in one pass over its tags.

    An end tag closes the last open element of its name and what is open in
    that; one without such an element closes nothing. Elements lie in lists by
    number, texts in the order of the page, so that an element's whole text is
    a run of them. What is in dropped elements has no texts.
    """

    def __init__(self, page: str):
        super().__init__(convert_charrefs=True)
        self.tags, self.parents, self.children, self.dropped, self.runs = [""], [0], [[]], [False], [[0, 0]]
        self.texts, self.waiting, self.open, self.number = [], [], [0], Counter()
        self.feed(page)
        self.close()
        self.told()
        while self.open:
            self.shut()

    def told(self):
        """The data since the last tag is one text, less white space at its ends."""
        text = "".join(self.waiting).strip()
        self.waiting = []
        if text and not self.dropped[self.open[-1]]:
            self.children[self.open[-1]].append((None, len(self.texts)))
            self.texts.append(text)

    def shut(self):
        last = self.open.pop()
        self.number[self.tags[last]] -= 1
        self.runs[last][1] = len(self.texts)

    def handle_starttag(self, tag, attrs):
        self.told()
        parent, new = self.open[-1], len(self.tags)
        self.tags.append(tag)
        self.parents.append((parent, len(self.children[parent])))
        self.children[parent].append((new, None))
        self.children.append([])
        self.dropped.append(self.dropped[parent] or tag in DROPPED)
        self.runs.append([len(self.texts), len(self.texts)])
        if tag not in EMPTY:
            self.open.append(new)
            self.number[tag] += 1

    def handle_endtag(self, tag):
        self.told()
        if self.number[tag] > 0:
            while self.tags[self.open[-1]] != tag:
                self.shut()
            self.shut()

    def handle_data(self, data):
        self.waiting.append(data)

    def handle_comment(self, data):
        self.told()

    def text(self, element: int) -> str:
        return "".join(self.texts[slice(*self.runs[element])])

    def sections(self) -> list[tuple[int, str, list[str]]]:
        """(level, heading, texts): with each heading the siblings that follow it, up to the next heading if that is one of them."""
        found = [k for k, tag in enumerate(self.tags) if tag in HEADING and not self.dropped[k]]
        out = []
        for k, following in zip(found, [*found[1:], None], strict=False):
            parent, at = self.parents[k]
            texts = []
            for element, text in self.children[parent][at + 1 :]:
                if element is not None and element == following:
                    break
                texts.append(self.texts[text] if element is None else self.text(element))
            out.append((int(self.tags[k][1]), self.text(k), [t for t in texts if t]))
        return out


def parsed_html(page: str | None) -> dict:
    tree = Tree(page or "")
    sections = tree.sections()
    titles = [k for k, tag in enumerate(tree.tags) if tag == "title"]
    title = next((t for t in map(tree.text, titles) if t), "") or next((h for level, h, _ in sections if level == 1 and h), "") or "Unknown"
    of_titles = {n for k in titles for n in range(*tree.runs[k])}
    text = "\n".join(t for n, t in enumerate(tree.texts) if n not in of_titles)
    found = [{"section_id": f"section_{i}", "heading": h, "content": "\n".join(c), "level": level, "page_num": None} for i, (level, h, c) in enumerate(sections, 1)]
    whole = [{"section_id": "section_1", "heading": "Full Document", "content": text, "level": 1, "page_num": None}]
    return {"title": title, "full_text": text, "sections": found or whole, "num_pages": None, "error": None}


PARSED_ROW = "title string, full_text string, sections array<struct<section_id: string, heading: string, content: string, level: int, page_num: int>>, num_pages int, error string"


def parse_html(pages: DataFrame, html: str = "html") -> DataFrame:
    """pages with title, full_text, sections and error; a page that fails keeps its row, with the error."""
    names = pages.columns

    def run(batches):
        for pdf in batches:
            rows = []
            for page in pdf[html]:
                try:
                    rows.append(parsed_html(page))
                except Exception as e:  # becomes the row's error
                    rows.append({"title": None, "full_text": "", "sections": [], "num_pages": None, "error": f"Failed to parse document: {e}"})
            yield pd.concat([pdf[names].reset_index(drop=True), pd.DataFrame(rows)], axis=1)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.schema)
    return pages.mapInPandas(run, f"{schema}, {PARSED_ROW}")


def title(pages: DataFrame, html: str = "html") -> DataFrame:
    """The title alone, in the JVM: <title>, else <h1>, else Unknown; entities stay as they are written."""
    of = lambda tag: F.nullif(F.trim(F.regexp_extract(html, rf"(?is)<{tag}[^>]*>(.*?)</{tag}>", 1)), F.lit(""))
    return pages.withColumn("title", F.coalesce(of("title"), of("h1"), F.lit("Unknown")))


def pdf_links(pages: DataFrame, source: str, html: str = "html", url: str = "url") -> DataFrame:
    """Links to PDFs as the source's crawl takes them, whole and once."""
    links = pages.select(url, F.explode(F.regexp_extract_all(html, F.lit(r"""(?i)(?<![\w-])href\s*=\s*("[^"]+"|'[^']+'|[^\s"'>]+)"""), F.lit(1))).alias("href"))
    links = links.withColumn("href", F.regexp_replace("href", r"""^["']|["']$""", ""))
    low = F.lower("href")
    base = F.regexp_extract(url, r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)", 1)
    whole = F.when(F.col("href").rlike("^[a-zA-Z][a-zA-Z0-9+.-]*://"), F.col("href")).otherwise(F.concat(base, F.when(F.col("href").startswith("/"), F.lit("")).otherwise("/"), "href"))
    return links.where(F.contains(low, F.lit(".pdf")) & F.contains(low, F.lit(CRAWLS[source]))).select(whole.alias("url"), F.substring_index("href", "/", -1).alias("filename")).distinct()


def links_by_source(pages: DataFrame, sources=tuple(CRAWLS), source: str = "source", **columns) -> DataFrame:
    """source, url, filename: the PDF links of pages, each by the crawl of its source; pages of sources not asked for are passed over."""
    out = None
    for name in sources:
        if name.lower() in CRAWLS:
            one = pdf_links(pages.where(F.lower(source) == name.lower()), name.lower(), **columns).withColumn("source", F.lit(name.lower()))
            out = one if out is None else out.unionByName(one)
    return out.select("source", "url", "filename") if out is not None else pages.sparkSession.createDataFrame([], "source string, url string, filename string")


def write_records(links: DataFrame, path: str, at: str) -> None:
    """A record beside each landed file: source, url, filename, landed_at; one JSON line a file, by source."""
    links.withColumn("landed_at", F.lit(at)).write.mode("overwrite").partitionBy("source").json(path)


#: Kinds of files that are read, and how their names end in any case.
PARSERS = ("html", "htm")
NAMED = "*.[hH][tT][mM]{,[lL]}"


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """filepath, filename, doc_id, title, full_text, sections, num_pages, error, source of all files below a path.

    Of html and htm files the content is read; the others are listed without
    theirs, whatever its size, and have rows with an error. The text of a page
    without headings is parted by those in its lines.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    named = lambda df, *more: df.select(F.col("path").alias("filepath"), F.substring_index("path", "/", -1).alias("filename"), F.lower(F.substring_index("path", ".", -1)).alias("ext"), *more)
    others = named(files.load(path)).where(~F.col("ext").isin(*PARSERS))

    def run(batches):
        for pdf in batches:
            rows = []
            for data in pdf["content"]:
                try:
                    rows.append(parsed_html(bytes(data).decode("utf-8", "replace")))
                except Exception as e:  # becomes the row's error
                    rows.append({"title": None, "full_text": "", "sections": [], "num_pages": None, "error": f"Failed to parse document: {e}"})
            yield pd.concat([pdf[["filepath", "filename"]].reset_index(drop=True), pd.DataFrame(rows)], axis=1)

    read = named(files.option("pathGlobFilter", NAMED).load(path), "content").mapInPandas(run, f"filepath string, filename string, {PARSED_ROW}")
    error = F.concat(F.lit("Failed to parse document: no parser for ."), "ext")
    read = read.unionByName(others.select("filepath", "filename", F.lit("").alias("full_text"), error.alias("error")), allowMissingColumns=True)
    return read.withColumns({"source": source_of_path("filepath"), "doc_id": document_id("filename")})


def document_id(filename):
    """A document's id: its file's name, with _ for dots."""
    return F.replace(F.coalesce(filename, F.lit("unknown")), F.lit("."), F.lit("_"))


def all_sections(parsed: DataFrame) -> DataFrame:
    """doc_id, source, section_id, heading, content, level of parsed documents: their own sections, or those that headings in the text make."""
    own = parsed.where(F.size("sections") > 0).select("doc_id", "source", F.explode("sections").alias("s")).select("doc_id", "source", "s.section_id", "s.heading", "s.content", "s.level")
    plain = parsed.where((F.coalesce(F.size("sections"), F.lit(0)) <= 0) & (F.col("full_text") != ""))
    made = ingest.sections(plain.withColumn("of", F.struct("doc_id", "source")), "of")
    return own.unionByName(made.select("of.doc_id", "of.source", "section_id", "heading", "content", "level"))


def ingest_documents(spark: SparkSession, path: str, out: str, at: str, size: int = 1000, provider=None) -> DataFrame:
    """Files below a path -> out/chunks with embeddings, and out/chunk_stats: reading, sections, chunks, vectors, writing.

    The parsed documents are written too (out/parsed), so a run that breaks
    off behind them needn't parse again. -> the one row of statistics.
    """
    read_documents(spark, path).write.mode("overwrite").parquet(f"{out}/parsed")
    made = ingest.chunks(all_sections(spark.read.parquet(f"{out}/parsed")), size).withColumn("created_at", F.lit(at).cast("timestamp"))
    embed(made, "text", *([provider] if provider else [])).write.mode("overwrite").parquet(f"{out}/chunks")
    chunks = spark.read.parquet(f"{out}/chunks")
    write_json(ingest.chunk_stats(chunks).withColumn("timestamp", F.lit(at)), f"{out}/chunk_stats")
    return spark.read.json(f"{out}/chunk_stats")


def read_parsed(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PARSED).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*_parsed.json").json(path)


def read_entities(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(ENTITY).json(path)


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CHUNK).json(path)


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).json(path)


def save_graph(g: Graph, path: str) -> None:
    """Nodes by label and edges by type, so that scans of a label read that label only."""
    g.nodes.write.mode("overwrite").partitionBy("label").parquet(f"{path}/nodes")
    g.edges.write.mode("overwrite").partitionBy("type").parquet(f"{path}/edges")


def load_graph(spark: SparkSession, path: str) -> Graph:
    return Graph(spark.read.schema(NODE).parquet(f"{path}/nodes"), spark.read.schema(EDGE).parquet(f"{path}/edges"))


def plain(df: DataFrame) -> DataFrame:
    """df with all times as ISO text, for readers that know no others."""
    return df.withColumns({f.name: F.date_format(f.name, "yyyy-MM-dd'T'HH:mm:ss") for f in df.schema if f.dataType.typeName() in ("timestamp", "timestamp_ntz", "date")})


def export_graph(g: Graph, path: str) -> None:
    """Nodes, relationships and their numbers as JSON, times as text; a graph without edges has a zero."""
    write_json(plain(g.nodes), f"{path}/nodes")
    write_json(plain(g.edges), f"{path}/relationships")
    write_json(totals(g).withColumn("exported_at", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss")), f"{path}/metadata")
