"""The corpus pipeline: language ID, near duplicates, personal data, packing.

Each stage is called with (spark, docs, sf_dir) and works on all that the one
before has kept; its result is written as Parquet and read again.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from lawmesh.llm.common import settle, table
from lawmesh.llm.jaccard import jaccard_components
from lawmesh.llm.langid import identify
from lawmesh.llm.packing import pack_documents
from lawmesh.llm.pii import redact

#: Rejects next to nothing: at 512 dimensions unrelated profiles have cosines of about 0 +- 0.044, and the best of several languages counts.
LEAST_COSINE = 0.02
#: Ids of 8 bytes that may be broadcast.
SMALL = 2_000_000


def known_language(spark, docs, sf_dir):
    """Documents with a language: those without text or letters ("und") go.

    Texts in no learned language are not told apart: which of them go is chance.
    Learns from the labelled documents of its input; where none of them has a
    letter, a document needs letters only.
    """
    language, cosine = (next(c for k in range(len(docs.columns) + 1) if (c := f"{name}{k or ''}") not in docs.columns) for name in ("_language", "_cosine"))
    found = identify(docs, docs, keep=True, into=(language, cosine))
    letters = F.col("text").rlike(r"\p{L}")
    learned = docs.where(F.col("lang").isNotNull() & letters).limit(1).count()
    clean = (F.col(language) != "und") & (F.col(cosine) >= LEAST_COSINE) if learned else letters
    return found.where(clean).select(*docs.columns)


def one_of_each_group(spark, docs, sf_dir):
    """Of documents linked by Jaccard >= 0.75 of their shingles, the one with the smallest doc_id stays.

    Documents without words or without a doc_id stay, as does one row of a
    repeated doc_id: the first by text and then the other columns, nulls first.
    The ids that stay are broadcast up to SMALL of them.
    """
    keep = settle(jaccard_components(docs).where("component_id = doc_id").select("doc_id"))
    n_rows, n_ids = keep.agg(F.count("*"), F.count_distinct("doc_id")).first()
    ids = keep.distinct()
    kept = docs.join(F.broadcast(ids) if n_ids <= SMALL else ids, "doc_id", "left_semi").select(*docs.columns)
    if n_rows > n_ids:
        repeated = settle(keep.groupBy("doc_id").count().where("count > 1").select("doc_id"))
        order = ["text", *(c for c in docs.columns if c != "text")]
        first = kept.join(repeated, "doc_id", "left_semi").groupBy("doc_id").agg(F.min(F.struct(*order)).alias("row"))
        kept = kept.join(repeated, "doc_id", "left_anti").select(*docs.columns).unionByName(first.select("row.*"))
    return kept.unionByName(docs.where("doc_id is null"))


def without_personal_data(spark, docs, sf_dir):
    """All documents, with the kind of each span in its place."""
    return redact(docs)


def packed(spark, docs, sf_dir):
    """The pieces of all documents in sequences of at most 2048 tokens."""
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language_id", known_language),
    ("near_duplicates", one_of_each_group),
    ("personal_data", without_personal_data),
    ("packing", packed),
]

#: SQL can express none of the stages; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
