"""From a question to an answer: contexts, reasoning, conflicts, paths, related requirements."""

from __future__ import annotations

import json
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lawmesh.operators.conflict import runtime_conflicts
from lawmesh.operators.graph import Graph
from lawmesh.operators.retrieve import keyword_all, retrieve, retrieve_all
from lawmesh.operators.store import small, written
from lawmesh.plans import router, templates


def formatted(contexts: DataFrame) -> DataFrame:
    """One text of numbered contexts."""
    line = F.format_string("[%d] %s (%s): %s", "ord", F.coalesce("citation_text", F.lit("")), "node_type", F.coalesce("text", F.lit("")))
    return contexts.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", line.alias("line")))), lambda x: x["line"]), "\n").alias("context"))


def extractive(question: str, contexts: list[dict]) -> str:
    """A provider without a model: the best context is the answer, all are cited."""
    best = contexts[0]["text"] if contexts else ""
    cited = [{"source": c["citation_text"], "excerpt": (c["text"] or "")[:200]} for c in contexts]
    return json.dumps({"answer": best, "reasoning": "extracted", "citations": cited, "confidence": contexts[0]["relevance_score"] if contexts else 0.0})


def parse_reasoning(text: str | None) -> dict:
    """JSON with a confidence, by default 0.8; other text as it is with 0.6; nothing or no answer in it: 0.0 and status failed."""
    if not text or not text.strip():
        return {"answer": "", "reasoning": "", "citations": [], "confidence": 0.0, "status": "failed"}
    inside = re.search(r"```(?:json)?\s*(.*?)```", text, re.S)
    try:
        got = json.loads(inside[1] if inside else text)
    except ValueError:
        return {"answer": text.strip(), "reasoning": "", "citations": [], "confidence": 0.6, "status": "text"}
    if not isinstance(got, dict) or not got:
        return {"answer": "", "reasoning": "", "citations": [], "confidence": 0.0, "status": "failed"}
    return {"answer": got.get("answer", ""), "reasoning": got.get("reasoning", ""), "citations": got.get("citations", []), "confidence": float(got.get("confidence", 0.8)), "status": "ok"}


def reason(question: str, contexts: list[dict], providers: tuple[Callable, ...] = (extractive,)) -> dict:
    """The first provider that answers."""
    for provider in providers:
        try:
            got = parse_reasoning(provider(question, contexts))
        except Exception:  # the next model takes over
            continue
        if got["status"] != "failed":
            return got
    return parse_reasoning(None)


def path_summary(contexts: DataFrame, first: int = 5) -> DataFrame:
    """How many contexts of each label there are, in order of arrival, as `2 Requirement, 1 Process`."""
    counts = contexts.orderBy("ord").limit(first).groupBy("node_type").agg(F.count("*").alias("n"), F.min("ord").alias("o"))
    told = F.struct("o", F.concat_ws(" ", "n", "node_type").alias("t"))
    return counts.agg(F.array_join(F.transform(F.array_sort(F.collect_list(told)), lambda x: x["t"]), ", ").alias("path"))


def related(g: Graph, contexts: DataFrame, seeds: int = 3, each: int = 3, limit: int = 10) -> DataFrame:
    """Requirements beside the first requirement contexts, by APPLIES_TO or REQUIRES."""
    first = contexts.where("node_type = 'Requirement'").orderBy("ord").limit(seeds).select(F.col("node_id").alias("src"))
    near = g.both_ways("APPLIES_TO", "REQUIRES").join(small(first), "src", "left_semi").select("src", F.col("dst").alias("id"), "type").distinct()
    w = Window.partitionBy("src").orderBy("id", "type")
    near = near.withColumn("k", F.row_number().over(w)).where(F.col("k") <= each).select("id", "type")
    return g.nodes.join(small(near), "id").select("id", F.coalesce("text", "description", "name", "term").alias("text"), "citation_text", "type").orderBy("id", "type").limit(limit)


def answer(g: Graph, question: str, top_k: int = 7, include_conflicts: bool = True, include_related: bool = True, providers=(extractive,), route: bool = False, **options) -> dict:
    """One question's answer. Retrieval is one plan and comes back once; only its few contexts are on the driver."""
    if not question or not question.strip():
        raise ValueError("an empty question")
    spark = g.nodes.sparkSession
    if route:
        kind = router.classify(spark.createDataFrame([(question,)], "query string")).first()
        top_k = kind["top_k"]
    rows = [r.asDict() for r in retrieve(g, question, top_k, **options).collect()]
    rows = [r | {"ord": i} for i, r in enumerate(rows, 1)]
    contexts = spark.createDataFrame(rows, "text string, node_id string, node_type string, source_doc string, section_id string, citation_text string, retrieval_method string, category string, severity string, mandatory boolean, relevance_score double, ord long")
    got = reason(question, rows, providers)
    return {
        "query": question,
        **got,
        "contexts": rows,
        "template": router.plan(question),
        "conflicts": [r.asDict() for r in runtime_conflicts(contexts).collect()] if include_conflicts else [],
        "graph_path": (path_summary(contexts).first() or [""])[0],
        "related": [r.asDict() for r in related(g, contexts).collect()] if include_related else [],
    }


def answer_all(g: Graph, questions: DataFrame, top_k: int = 10, key: str = "query_id", text: str = "query") -> DataFrame:
    """Keyword contexts of many questions at once: query_id, node_id, score, rank."""
    items = g.nodes.select("id", F.coalesce("text", "description", "name", "term").alias("text"))
    return keyword_all(items, questions, top_k, key, text).select(key, F.col("id").alias("node_id"), "score", "rank")


def answer_batch(g: Graph, questions: DataFrame, top_k: int = 7, providers=(extractive,), key: str = "query_id", text: str = "query", path: str | None = None, **options) -> DataFrame:
    """One row a question: its answer over all ways of retrieval, with citations, contexts, conflicts and related requirements.

    Retrieval, conflicts and neighbours are joins over all questions; the
    provider is called in the tasks, once a question, with its few contexts.
    With `path` the rows are written there. A question without contexts is
    answered from none.
    """
    found = written(retrieve_all(g, questions, top_k, key=key, text=text, **options))
    kind = questions.schema[key].dataType.simpleString()
    rows = questions.select(key, text).join(found.drop("text").withColumn("context", found["text"]) if text == "text" else found.withColumnRenamed("text", "context"), key, "left")

    def run(pdf):
        pdf = pdf.sort_values("rank")
        contexts = [r | {"text": r["context"]} for r in pdf[pdf["rank"].notna()].to_dict("records")]
        got = reason(pdf[text].iloc[0], contexts, providers)
        cited = [f"{c.get('source')}: {c.get('excerpt', '')}" for c in got["citations"]]
        return pd.DataFrame([{key: pdf[key].iloc[0], "query": pdf[text].iloc[0], "answer": got["answer"], "reasoning": got["reasoning"], "citations": cited, "confidence": got["confidence"], "status": got["status"]}])

    answers = rows.groupBy(key).applyInPandas(run, f"{key} {kind}, query string, answer string, reasoning string, citations array<string>, confidence double, status string")
    against = runtime_conflicts(found.withColumn("ord", F.col("rank").cast("long")), key=key)
    against = against.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("ord1", "ord2", "reason", "confidence"))).alias("conflicts"))  # of at most top_k contexts
    first = Window.partitionBy(key).orderBy("rank")
    seeds = found.where("node_type = 'Requirement'").withColumn("k", F.row_number().over(first)).where("k <= 3").select(key, F.col("node_id").alias("src"))
    near = g.both_ways("APPLIES_TO", "REQUIRES").select("src", "dst", "type").join(seeds.select("src").distinct(), "src", "left_semi").distinct()
    near = near.withColumn("k", F.row_number().over(Window.partitionBy("src").orderBy("dst", "type"))).where("k <= 3")
    near = seeds.join(near, "src").select(key, F.col("dst").alias("id")).distinct().withColumn("k", F.row_number().over(Window.partitionBy(key).orderBy("id"))).where("k <= 10")
    near = near.groupBy(key).agg(F.array_sort(F.collect_list("id")).alias("related"))
    used = found.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "node_id"))), lambda x: x["node_id"]).alias("contexts"))
    out = answers.join(used, key, "left").join(against, key, "left").join(near, key, "left")
    if path:
        out.write.mode("overwrite").parquet(path)
        out = g.nodes.sparkSession.read.parquet(path)
    return out


def run_plan(g: Graph, question: str, **given) -> DataFrame:
    """The rows of the template that a question's words choose."""
    name, parameters = router.plan(question, **given)
    return templates.TEMPLATES[name](g, **parameters)


def rendered(a: dict) -> str:
    lines = [f"Q: {a['query']}", "", a["answer"], "", f"Confidence: {a['confidence']:.0%}"]
    if a["citations"]:
        lines += ["", "Sources:", *(f"- {c.get('source')}: {c.get('excerpt', '')}" for c in a["citations"])]
    if a["conflicts"]:
        lines += ["", "Conflicts:", *(f"- {c['reason']} ({c['confidence']:.0%})" for c in a["conflicts"])]
    if a["related"]:
        lines += ["", "Related:", *(f"- {r['citation_text']}: {(r['text'] or '')[:100]}" for r in a["related"])]
    return "\n".join(lines)
