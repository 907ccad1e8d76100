"""Documents to sections to chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lawmesh.functions.text import sentences, strip, token_estimate

#: What a heading looks like, tried in order.
HEADINGS = (
    r"^(Chapter|CHAPTER)\s+(\d+[\.\d]*):?\s*(.+)$",
    r"^(Section|SECTION)\s+(\d+[\.\d]*):?\s*(.+)$",
    r"^(Article|ARTICLE)\s+(\d+[\.\d]*):?\s*(.+)$",
    r"^(\d+[\.\d]+)\s+(.+)$",
    r"^([A-Z][A-Z\s]{3,}?)$",
)


def heading(line: Column) -> Column:
    """struct(section_id, heading, level) of a stripped line that is a heading; else null. section_id is null for capitals."""

    def told(section, text, number):
        level = F.size(F.split(number, r"\.")) if number is not None else F.lit(1)
        return F.struct(section.alias("section_id"), text.alias("heading"), level.cast("int").alias("level"))

    rules = []
    for p in HEADINGS[:3]:
        kind, number, title = (F.regexp_extract(line, p, i) for i in (1, 2, 3))
        rules.append(F.when(line.rlike(p), told(F.concat_ws("_", F.lower(kind), number), F.concat(kind, F.lit(" "), number, F.lit(": "), title), number)))
    number, title = (F.regexp_extract(line, HEADINGS[3], i) for i in (1, 2))
    rules.append(F.when(line.rlike(HEADINGS[3]), told(F.concat(F.lit("section_"), number), F.concat_ws(" ", number, title), number)))
    rules.append(F.when(line.rlike(HEADINGS[4]) & (F.length(line) < 100), told(F.lit(None).cast("string"), line, None)))
    return F.coalesce(*rules)


def sections(docs: DataFrame, key: str = "doc_id", text: str = "full_text") -> DataFrame:
    """doc_id, ord, section_id, heading, content, level; what comes before the first heading goes.

    Each row is a document of its own, also where a key repeats; nothing is
    shuffled. A document without headings is one section, `Full Document`.
    """
    lines = F.filter(F.transform(F.split(text, "\n"), strip), lambda x: x != "")
    found = F.filter(F.transform("lines", lambda x, i: F.struct(i.alias("at"), heading(x).alias("h"))), lambda x: x["h"].isNotNull())

    def told(x, k):
        after = F.when(k + 1 < F.size("heads"), F.get("heads", k + 1)["at"]).otherwise(F.size("lines"))
        content = F.array_join(F.slice("lines", x["at"] + 2, after - x["at"] - 1), "\n")
        section = F.coalesce(x["h"]["section_id"], F.concat(F.lit("section_"), k + 1))
        return F.struct((k + 1).cast("long").alias("ord"), section.alias("section_id"), x["h"]["heading"].alias("heading"), content.alias("content"), x["h"]["level"].alias("level"))

    whole = F.struct(F.lit(1).cast("long").alias("ord"), F.lit("section_1").alias("section_id"), F.lit("Full Document").alias("heading"), F.col(text).alias("content"), F.lit(1).alias("level"))
    headed = docs.withColumn("lines", lines).withColumn("heads", found)
    return headed.select(key, F.explode(F.when(F.size("heads") > 0, F.transform("heads", told)).otherwise(F.array(whole))).alias("s")).select(key, "s.*")


def packed(parts: Column, size: int) -> Column:
    """Greedy packing of sentences to about `size` characters; a full chunk of more than two pieces hands its last two on as one."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.array().cast("array<string>").alias("now"), F.lit(0).alias("length"))

    def step(acc, s):
        full = (acc["length"] + F.length(s) > size) & (F.size(acc["now"]) > 0)
        over = F.when(F.size(acc["now"]) > 2, F.array_join(F.slice(acc["now"], -2, 2), " ")).otherwise("")
        return F.when(
            full,
            F.struct(
                F.array_append(acc["done"], F.array_join(acc["now"], " ")).alias("done"),
                F.when(over != "", F.array(over, s)).otherwise(F.array(s)).alias("now"),
                (F.length(over) + F.length(s)).alias("length"),
            ),
        ).otherwise(F.struct(acc["done"].alias("done"), F.array_append(acc["now"], s).alias("now"), (acc["length"] + F.length(s)).alias("length")))

    return F.aggregate(parts, start, step, lambda a: F.when(F.size(a["now"]) > 0, F.array_append(a["done"], F.array_join(a["now"], " "))).otherwise(a["done"]))


def chunks(parts: DataFrame, size: int = 1000, longer_than: int = 20, whole_below: int = 100) -> DataFrame:
    """chunk_id, doc_id, source, section_id, section_heading, text, char_count, token_estimate, chunk_index of sections.

    A section under whole_below stripped characters is one chunk as it is;
    from others, sentences of at most longer_than characters are left out, so
    a section that has only such gives none. No shuffle: one row at a time.
    """
    content = F.coalesce("content", F.lit(""))
    texts = F.when(F.length(strip(content)) < whole_below, F.array(content)).otherwise(packed(sentences(content, longer_than), size))
    return parts.select("doc_id", "source", "section_id", F.col("heading").alias("section_heading"), F.posexplode(texts).alias("chunk_index", "raw")).select(
        F.concat_ws("_", "doc_id", "section_id", F.col("chunk_index")).alias("chunk_id"),
        "doc_id",
        "source",
        "section_id",
        "section_heading",
        strip("raw").alias("text"),
        F.length("raw").alias("char_count"),
        token_estimate("raw").alias("token_estimate"),
        "chunk_index",
    )


def chunk_stats(made: DataFrame) -> DataFrame:
    return made.agg(
        F.count("*").alias("total_chunks"),
        F.coalesce(F.avg("char_count"), F.lit(0.0)).alias("avg_chunk_size"),
        F.coalesce(F.avg("token_estimate"), F.lit(0.0)).alias("avg_tokens"),
        *([F.count_if(F.col("embedding").isNotNull()).alias("with_embeddings")] if "embedding" in made.columns else []),
    )


def chunks_by_source(made: DataFrame) -> DataFrame:
    return made.groupBy("source").agg(F.count("*").alias("chunks")).orderBy("source")
