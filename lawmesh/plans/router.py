"""From a question to a template with its parameters, and to a way of retrieval."""

from __future__ import annotations

import re
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: How many contexts each kind of question gets, and the labels it looks at.
ROUTES = {
    "definition": (3, ("Definition", "Process")),
    "requirement": (7, ("Requirement",)),
    "listing": (10, ("Requirement", "Process")),
    "comparative": (6, ("Definition", "Requirement")),
    "cross_reference": (8, ("Requirement", "CrossReference")),
    "conditional": (5, ("Requirement", "Process")),
    "procedural": (6, ("Process", "Requirement")),
    "exemption": (5, ("Exemption", "Requirement")),
    "complex": (10, ("Requirement", "Process", "Definition")),
}
#: Our own rules for telling the kind, tried in order; a provider may replace them.
KINDS = (
    ("exemption", r"\bexempt|\bexception"),
    ("comparative", r"\bdifference|\bcompare|\bversus\b|\bvs\b"),
    ("cross_reference", r"\bmention|\bcross-reference|\bcite"),
    ("procedural", r"\bsteps?\b|\bhow to\b|\bprocedure"),
    ("listing", r"^list\b|\blist all\b"),
    ("conditional", r"^(when|where)\b|\bunder what\b"),
    ("definition", r"^what is\b|\bdefin|\bmeaning\b"),
    ("requirement", r"\brequire|\bcompl(y|iance)"),
)
class Match(NamedTuple):
    """Words that choose a template; its parameters; the pattern in which the first of these is found, and a word that must be there for it."""

    words: tuple[str, ...]
    template: str
    parameters: tuple[str, ...]
    limit: int
    pattern: str | None = None
    needs: str = ""


#: Words that choose a template, in order, with the pattern of its parameter.
MATCHES = (
    Match(("requirement", "apply", "applicable"), "requirements_for_process", ("process_name",), 20, r"process[es]*\s+(?:of\s+)?([a-z\s]+)", "process"),
    Match(("definition", "define", "what is", "what are"), "term_definitions", ("term",), 10, r"(?:what is|define|definition of)\s+([a-z\s]+)"),
    Match(("cross-reference", "reference", "cite"), "cross_references", ("source_doc", "target_doc"), 20),
    Match(("conflict", "contradict", "inconsistent"), "detect_conflicts", ("keyword",), 20),
    Match(("exemption", "exception", "exempt"), "find_exemptions", ("keyword",), 20),
)
DOCUMENTS = r"(?i)(MHRA|EU GMP|UK GMP|ICH)"


def match_template(question: str, **given) -> tuple[str, dict] | None:
    """The template that a question's words choose; the first group of words found decides, even where no parameter is."""
    low = question.lower()
    m = next((m for m in MATCHES if any(w in low for w in m.words)), None)
    if m is None:
        return None
    limit = {"limit": given.get("limit", m.limit)}
    if m.pattern is None:
        return m.template, {p: given.get(p, "") for p in m.parameters} | given | limit
    found = re.search(m.pattern, low) if m.needs in low else None
    return (m.template, given | {m.parameters[0]: found[1].strip()} | limit) if found else None


def parameters(question: str) -> dict:
    quoted, doc = re.search(r'"([^"]+)"', question), re.search(DOCUMENTS, question)
    return ({"keyword": quoted[1]} if quoted else {}) | ({"source_doc": doc[1]} if doc else {})


def plan(question: str, **given) -> tuple[str, dict]:
    """A template and its parameters; without a match the search for the whole question."""
    return match_template(question, **given) or ("search_requirements", given | {"search_term": question, "limit": given.get("limit", 20)})


def classify(questions: DataFrame, column: str = "query", provider=None) -> DataFrame:
    """query_type, top_k and node_focus for each question; a provider's answer outside the kinds is complex."""
    low = F.lower(column)
    kind = F.coalesce(*(F.when(low.rlike(p), k) for k, p in KINDS), F.lit("complex")) if provider is None else provider(F.col(column))
    kind = F.when(kind.isin(*ROUTES), kind).otherwise("complex")
    pick = lambda f: F.coalesce(*(F.when(F.col("query_type") == k, f(v)) for k, v in ROUTES.items()))
    return questions.withColumn("query_type", kind).withColumns(
        {"top_k": pick(lambda v: F.lit(v[0])), "node_focus": pick(lambda v: F.array(*(F.lit(x) for x in v[1])))}
    )
