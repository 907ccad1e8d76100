import corpus_pipeline
from pyspark.sql import functions as F

from lawmesh.llm import pii
from tests.llm.helpers import docs, no_docs, odd_texts
from tests.llm.test_similarity import grouped, shingles


def test_stages_against_brute_force(spark, tmp_path):
    base = " ".join(f"word{i}" for i in range(60))
    rows = [*odd_texts(), (20, base), (21, base + " more"), (22, "mail me a.b@c.org at once " + base[::-1]), (23, "12345 678"), (24, base)]
    d = docs(spark, rows)
    d.write.parquet(str(tmp_path / "documents.parquet"))
    columns, kept = d.columns, d
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = kept
        kept = stage(spark, before, str(tmp_path))
        kept.write.parquet(str(tmp_path / name))
        kept = spark.read.parquet(str(tmp_path / name))
        assert kept.columns == columns
    has_letter = [(i, t) for i, t in rows if t and any(c.isalpha() for c in t)]
    sets = {i: shingles(t) for i, t in has_letter if i is not None}
    alike = lambda a, b: bool(a) and 100 * len(a & b) >= 75 * len(a | b)
    ids = sorted(sets)
    of = grouped(ids, [(a, b) for x, a in enumerate(ids) for b in ids[:x] if alike(sets[a], sets[b])])
    crf = pii.train(pii.labelled_table())
    want = {}
    for i, t in has_letter:
        if i is not None and of[i] == i:
            want[i] = pii.covered(t, pii.find_spans([t], crf)[1][0])
    assert {r.doc_id: r.text for r in kept.where("doc_id is not null").collect()} == want
    assert "[EMAIL]" in want[22]
    pieces = corpus_pipeline.run(spark, str(tmp_path))
    got = {(r.doc_id, r.doc_tokens) for r in pieces.where("doc_id is not null").collect()}
    assert {i for i, _ in got} == set(want)
    assert pieces.agg(F.max("length")).first()[0] <= 2048


def test_stages_on_empty_tables(spark):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, no_docs(spark), "").count() == 0


def test_language_stage_keeps_letters_where_nothing_is_learned(spark):
    d = docs(spark, [(1, "12 34"), (2, None), (3, "some words")]).withColumn("lang", F.when(F.col("doc_id") == 1, "en")).withColumn("_language", F.lit(1))
    got = corpus_pipeline.known_language(spark, d, "")
    assert [r.doc_id for r in got.collect()] == [3] and got.columns == d.columns


def test_repeated_ids_keep_their_first_text(spark):
    d = docs(spark, [(1, "b " * 20), (1, "a " * 20), (2, "c d e f g h i")])
    assert sorted((r.doc_id, r.text[:1]) for r in corpus_pipeline.one_of_each_group(spark, d.repartition(3), "").collect()) == [(1, "a"), (2, "c")]
