"""Entities from a model's answers: parsing, repair, resuming, merging, comparing models."""

from __future__ import annotations

import json
import re
import time

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from lawmesh.operators.graph import keep_first, part_of
from lawmesh.operators.store import written
from lawmesh.schema import ENTITY, PROPERTIES

#: The lists of an answer, the type of their entities and the key of its text.
KINDS = {
    "requirements": ("Requirement", "text"),
    "definitions": ("Definition", "definition"),
    "exemptions": ("Exemption", "text"),
    "processes": ("Process", "description"),
    "regulations": ("Regulation", "name"),
    "cross_references": ("CrossReference", "text"),
}
ITEM = "struct<text: string, definition: string, description: string, " + ", ".join(f"{p}: {'boolean' if p == 'mandatory' else 'string'}" for p in PROPERTIES) + ">"
ANSWER = "struct<" + ", ".join(f"{k}: array<{ITEM}>" for k in KINDS) + ">"


def without_fence(c):
    """What a ``` fence holds, or the text itself."""
    inside = F.regexp_extract(c, r"(?s)```(?:json)?\s*(.*?)(?:```|\z)", 1)
    return F.when(F.contains(c, F.lit("```")), inside).otherwise(c)


BODY = r"""[^"\\\x00-\x1f]*(?:\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4})[^"\\\x00-\x1f]*)*"""
#: A string, a number or word, or a sign of a JSON text, with the white space before it.
TOKEN = re.compile(rf"""[ \t\n\r]*(?:(?P<string>"{BODY}")|(?P<word>(?:-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][-+]?[0-9]+)?|true|false|null|NaN|-?Infinity)(?![\w.+-]))|(?P<sign>[][{{}},:]))""")
CUT = re.compile(rf"""[ \t\n\r]*("{BODY})\Z""")


def repaired(text: str | None) -> str | None:
    """A JSON text that breaks off, closed behind its last whole value; null if nothing can be read.

    One pass over its tokens with a stack of what is open; it remembers the
    last place where all that could be closed. At the first token that can't
    stand where it is, or at the end, the text is cut there and closed; a
    string that the end cuts is closed too, if it is a value.
    """
    if not text:
        return None
    text = text.rstrip()
    open_, awaits, at, good = [], "value", 0, None
    while m := TOKEN.match(text, at):
        kind, at = m.lastgroup, m.end()
        sign = m[kind] if kind == "sign" else ""
        if awaits in ("value", "first value") and (kind != "sign" or sign in "[{"):
            if sign:
                open_.append("]" if sign == "[" else "}")
            awaits, good = {"[": "first value", "{": "first key"}.get(sign, "after"), at
        elif awaits in ("key", "first key") and kind == "string":
            awaits = "colon"
        elif awaits == "colon" and sign == ":":
            awaits = "value"
        elif open_ and sign == open_[-1] and awaits in ("after", "first value", "first key"):
            open_.pop()
            awaits, good = "after", at
        elif open_ and awaits == "after" and sign == ",":
            awaits = "value" if open_[-1] == "]" else "key"
        else:
            return text[:good] + "".join(reversed(open_)) if good else None
    cut = CUT.match(text, at) if awaits in ("value", "first value") else None
    if cut:
        return re.sub(r"[,:\s]+\Z", "", text) + '"' + "".join(reversed(open_))
    return text[:good] + "".join(reversed(open_)) if good else None


@F.pandas_udf(StringType())
def repair(s: pd.Series) -> pd.Series:
    return s.map(repaired)


def parse_responses(responses: DataFrame) -> DataFrame:
    """Entities of answers: columns chunk_id, source_doc, section_id, section_heading, response, ord.

    Whole JSON is read inside the JVM; only answers that it can't read go
    through repair. Confidence is 0.9, the default of an answer that tells none.
    """
    r = responses.withColumn("json", without_fence(F.col("response")))
    whole = F.try_parse_json("json").isNotNull() if hasattr(F, "try_parse_json") else F.get_json_object("json", "$").isNotNull()
    r = r.withColumn("whole", whole)
    read = r.where("whole").unionByName(r.where("not whole").withColumn("json", repair("json"))).withColumn("a", F.from_json("json", ANSWER)).where("a is not null")
    out = None
    for k, (key, (kind, text)) in enumerate(KINDS.items()):
        one = read.select("chunk_id", "source_doc", "section_id", "section_heading", "ord", F.posexplode(f"a.{key}").alias("i", "x"))
        one = one.select(
            F.lit(kind).alias("entity_type"),
            F.coalesce(f"x.{text}", "x.text", F.lit("")).alias("text"),
            F.col("chunk_id").alias("source_chunk_id"),
            "source_doc",
            "section_id",
            "section_heading",
            F.struct(*(F.col(f"x.{p}") for p in PROPERTIES)).alias("properties"),
            F.lit(0.9).alias("confidence"),
            (F.col("ord") * 1_000_000 + k * 100_000 + F.col("i")).cast("long").alias("ord"),
        )
        out = one if out is None else out.unionByName(one)
    return out.to(ENTITY)


def remaining(chunks: DataFrame, *done: DataFrame, key: str = "chunk_id") -> DataFrame:
    """Chunks that no log of processed chunks names; a chunk that gave nothing counts as processed once logged."""
    seen = None
    for d in done:
        seen = d.select(key) if seen is None else seen.unionByName(d.select(key))
    return chunks if seen is None else chunks.join(seen.distinct(), key, "left_anti")


def merge(existing: DataFrame, *more: DataFrame) -> DataFrame:
    """All entities, of those with one chunk, type and first 100 characters the first; what existed comes first."""
    out = existing.withColumn("part", F.lit(0))
    for k, m in enumerate(more, 1):
        out = out.unionByName(m.withColumn("part", F.lit(k)))
    key = F.concat_ws("\0", "source_chunk_id", "entity_type", F.substring("text", 1, 100))
    return keep_first(out, key, ["part", "ord"]).drop("part")


def prompt(text: str, source: str = "", section_id: str = "", section_heading: str = "") -> str:
    """What a model is asked: the lists of KINDS, as JSON, of one chunk."""
    where = ", ".join(x for x in (source, section_id, section_heading) if x)
    lists = "; ".join(f"{name}: each with {key} and what fits of the properties" for name, (_, key) in KINDS.items())
    return (
        f"Read this passage of a regulation ({where}) and give what it states as one JSON object, nothing else.\n"
        f"Lists: {lists}.\nProperties: {', '.join(PROPERTIES)}.\nLeave a list out if there is nothing for it.\n\nPassage:\n{text}"
    )


def relation_prompt(first: str, second: str, types) -> str:
    return f"Which of these relations holds from the first to the second passage: {', '.join(types)}, or none? Answer with one word.\n\nFirst: {first}\n\nSecond: {second}"


def conflict_prompt(first: str, second: str) -> str:
    return f'Do these two requirements conflict? Answer as JSON: {{"conflict": true or false, "reason": "...", "confidence": 0 to 1}}.\n\nFirst: {first}\n\nSecond: {second}'


def found_nothing(response: str | None) -> bool:
    """No entity can be read from an answer."""
    inside = re.search(r"```(?:json)?\s*(.*?)(?:```|\Z)", response or "", re.S)
    text = repaired(inside[1] if inside else response)
    try:
        got = json.loads(text) if text else None
    except ValueError:
        return True
    return not isinstance(got, dict) or not any(got.get(k) for k in KINDS)


class Rotation:
    """A provider made of models, each a function from a prompt to an answer, tried in turn.

    Each model gets `tries` tries with growing waits; the next one takes over
    where it fails, or finds nothing in a text of more than `substantial`
    characters. When all have failed once, the round is repeated after
    `between` seconds; then the chunk's answer is null.
    """

    def __init__(self, *models, tries: int = 3, waits: tuple[float, float] = (2, 10), cycles: int = 2, between: float = 60, substantial: int = 200, pause: float = 0, sleep=time.sleep):
        self.models, self.tries, self.waits, self.cycles, self.between = models, tries, waits, cycles, between
        self.substantial, self.pause, self.sleep = substantial, pause, sleep

    def asked(self, model, question: str) -> str:
        for k in range(self.tries):
            try:
                return model(question)
            except Exception:
                if k + 1 == self.tries:
                    raise
                self.sleep(min(self.waits[1], self.waits[0] * 2**k))

    def answer(self, text: str, **where) -> str | None:
        question = prompt(text, **where)
        for cycle in range(self.cycles):
            for model in self.models:
                try:
                    got = self.asked(model, question)
                except Exception:  # the next model takes over
                    continue
                if len(text) <= self.substantial or not found_nothing(got):
                    return got
            if cycle + 1 < self.cycles:
                self.sleep(self.between)
        return None

    def __call__(self, texts: list[str], **columns: list) -> list[str | None]:
        out = []
        for i, text in enumerate(texts):
            out.append(self.answer(text or "", **{k: v[i] or "" for k, v in columns.items()}))
            if self.pause:
                self.sleep(self.pause)
        return out


STATS = "total_chunks long, successful long, failed long, entities long, by_type map<string, long>"
WHERE = ("source", "section_id", "section_heading")


def extract(chunks: DataFrame, provider) -> DataFrame:
    """chunk_id and response of a provider, called in the tasks: a Rotation, or a function from a list of texts to a list of answers."""
    where = [c for c in WHERE if c in chunks.columns] if isinstance(provider, Rotation) else []

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame({"chunk_id": pdf["chunk_id"], "response": provider(pdf["text"].tolist(), **{c: pdf[c].tolist() for c in where})})

    return chunks.select("chunk_id", "text", *where).mapInPandas(run, "chunk_id string, response string")


def run_extraction(chunks: DataFrame, provider, path: str, batch: int = 10_000, most: int | None = None) -> dict:
    """Extracts the chunks that a run before hasn't, batch by batch, into path/entities and path/processed; -> statistics.

    A batch's responses are written first, its entities next, and its chunks
    are logged last, so a run that breaks off goes on with the batch it was
    in; entities that such a batch had already told are merged away on reading
    (read_extraction). Chunks that gave nothing are logged as well. The
    statistics of all runs so far are written to path/statistics.
    """
    spark = chunks.sparkSession
    todo = remaining(part_of(chunks, "chunk_id", 0, most) if most else chunks, *([spark.read.parquet(f"{path}/processed")] if exists(spark, f"{path}/processed") else []))
    todo = written(todo)
    n = todo.count()
    parts = -(-n // batch)
    for k in range(parts):
        some = todo if parts == 1 else todo.where(F.pmod(F.xxhash64("chunk_id"), F.lit(parts)) == k)
        answers = written(extract(some, provider))
        source = F.col("source").alias("source_doc") if "source" in some.columns else F.lit(None).cast("string").alias("source_doc")
        told = some.select("chunk_id", source, *(c if c in some.columns else F.lit(None).cast("string").alias(c) for c in ("section_id", "section_heading"))).join(answers, "chunk_id")
        ord_ = F.pmod(F.xxhash64("chunk_id"), F.lit(1 << 40))
        parse_responses(told.where("response is not null").withColumn("ord", ord_)).write.mode("append").parquet(f"{path}/entities")
        answers.select("chunk_id", F.col("response").isNotNull().alias("success")).write.mode("append").parquet(f"{path}/processed")
    stats = extraction_stats(spark, path) if exists(spark, f"{path}/processed") else {"total_chunks": 0, "successful": 0, "failed": 0, "entities": 0, "by_type": {}}
    spark.createDataFrame([(*(stats[c] for c in ("total_chunks", "successful", "failed", "entities")), stats["by_type"])], STATS).coalesce(1).write.mode("overwrite").json(f"{path}/statistics")
    return stats


def read_extraction(spark, path: str) -> DataFrame:
    return merge(spark.read.schema(ENTITY).parquet(f"{path}/entities"))


def extraction_stats(spark, path: str) -> dict:
    done = spark.read.parquet(f"{path}/processed").groupBy("chunk_id").agg(F.max("success").alias("success")).agg(F.count("*").alias("n"), F.count_if("success").alias("ok")).first()
    by_type = {r["entity_type"]: r["entities"] for r in counts(read_extraction(spark, path), "entity_type").collect()}
    return {"total_chunks": done["n"], "successful": done["ok"], "failed": done["n"] - done["ok"], "entities": sum(by_type.values()), "by_type": by_type}


def exists(spark, path: str) -> bool:
    """Whether there is something to read at a path of any store that Spark reads."""
    from pyspark.errors import AnalysisException

    try:
        spark.read.parquet(path).schema  # noqa: B018
    except AnalysisException:
        return False
    return True


def estimated_seconds(chunks: DataFrame, seconds_each: float, workers: int = 1, *done: DataFrame) -> float:
    """How long the chunks that are left would take."""
    return remaining(chunks, *done).count() * seconds_each / max(1, workers)


def counts(entities: DataFrame, by: str) -> DataFrame:
    return entities.groupBy(by).agg(F.count("*").alias("entities")).orderBy(by)


def try_models(chunks: DataFrame, models: dict, path: str, start: int = 0, count: int = 30, clock=time.monotonic) -> DataFrame:
    """Several models over one slice of the chunks, by chunk_id; -> their runs, which are written to path/runs.

    Rows: model, chunk_id, success, parsed, entities, seconds, by_type, error.
    A model is a function from a prompt to an answer and is asked once a
    chunk, in the tasks. A run whose call fails has an error and no entities;
    one whose answer isn't JSON, even when repaired, is parsed = false and no
    success. After an error that tells of a rate limit a task asks the model
    no more, and the chunks that are left have no run.
    """
    spark = chunks.sparkSession
    some = written(part_of(chunks, "chunk_id", start, count))
    runs = None
    for name, model in models.items():

        def ask(batches, model=model):
            limited = False
            for pdf in batches:
                rows = []
                for chunk, text in zip(pdf["chunk_id"], pdf["text"], strict=True):
                    if limited:
                        break
                    began, response, error = clock(), None, None
                    try:
                        response = model(prompt(text or ""))
                    except Exception as e:  # becomes the run's error
                        error = str(e)
                        limited = "rate_limit" in error.lower() or "429" in error
                    rows.append((chunk, response, error, clock() - began))
                yield pd.DataFrame(rows, columns=["chunk_id", "response", "error", "seconds"])

        one = some.select("chunk_id", "text").mapInPandas(ask, "chunk_id string, response string, error string, seconds double").withColumn("model", F.lit(name))
        runs = one if runs is None else runs.unionByName(one)
    if runs is None:
        raise ValueError("no models")
    runs = written(runs)
    none = F.lit(None).cast("string")
    told = parse_responses(runs.select(F.to_json(F.struct("model", "chunk_id")).alias("chunk_id"), none.alias("source_doc"), none.alias("section_id"), none.alias("section_heading"), "response", F.lit(0).cast("long").alias("ord")).where("response is not null"))
    each = told.groupBy(F.col("source_chunk_id").alias("of"), "entity_type").agg(F.count("*").cast("int").alias("n"))
    each = each.groupBy("of").agg(F.sum("n").cast("int").alias("entities"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("entity_type", "n")))).alias("by_type"))
    runs = runs.withColumn("parsed", F.when(F.col("error").isNull(), F.coalesce(repair(without_fence(F.col("response"))).isNotNull(), F.lit(False))).otherwise(True))
    out = runs.withColumn("of", F.to_json(F.struct("model", "chunk_id"))).join(each, "of", "left")
    out = out.select("model", "chunk_id", (F.col("error").isNull() & F.col("parsed")).alias("success"), "parsed", F.coalesce("entities", F.lit(0)).alias("entities"), "seconds", "by_type", "error")
    out.write.mode("overwrite").parquet(f"{path}/runs")
    return spark.read.parquet(f"{path}/runs")


def run_benchmark(chunks: DataFrame, models: dict, path: str, start: int = 0, count: int = 30, success: float = 80, parse: float = 90) -> DataFrame:
    """Models over a slice of chunks, compared: `benchmark` of their runs with `recommended`, best first; written to path/report."""
    by_model = benchmark(try_models(chunks, models, path, start, count))
    fit = recommended(by_model, success, parse).select("model", F.lit(True).alias("recommended"))
    report = by_model.join(fit, "model", "left").withColumn("recommended", F.coalesce("recommended", F.lit(False)))
    report.orderBy(F.desc("success_rate"), F.desc("avg_entities"), "model").coalesce(1).write.mode("overwrite").json(f"{path}/report")
    return report.orderBy(F.desc("success_rate"), F.desc("avg_entities"), "model")


def benchmark(runs: DataFrame) -> DataFrame:
    """By model: runs, success and parse rates in percent, means; columns model, success, parsed, entities, seconds.

    With a column by_type (map of entity type to number) also the sums by type.
    """
    rate = lambda c: F.avg(F.col(c).cast("int")) * 100
    out = runs.groupBy("model").agg(
        F.count("*").alias("chunks"), rate("success").alias("success_rate"), rate("parsed").alias("parse_rate"), F.avg("entities").alias("avg_entities"), F.avg("seconds").alias("avg_seconds")
    )
    if "by_type" not in runs.columns:
        return out
    each = runs.select("model", F.explode("by_type").alias("kind", "n")).groupBy("model", "kind").agg(F.sum("n").alias("n"))
    return out.join(each.groupBy("model").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("kind", "n")))).alias("by_type")), "model", "left")


def recommended(by_model: DataFrame, success: float = 80, parse: float = 90) -> DataFrame:
    """The models that pass both gates, best first."""
    return by_model.where((F.col("success_rate") >= success) & (F.col("parse_rate") >= parse)).orderBy(F.desc("success_rate"), F.desc("avg_entities"), "model")


def capacity(models: DataFrame, column: str = "per_day") -> DataFrame:
    """What the recommended models together can do."""
    return models.agg(F.count("*").alias("models"), F.coalesce(F.sum(column), F.lit(0)).alias("capacity"))
