"""A stored full-text index: lists of postings by bucket and term, and questions that read those of their words."""

from __future__ import annotations

import itertools
import re
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lawmesh.operators.retrieve import best_scored, question_terms, with_idf
from lawmesh.operators.store import exists, small, written

#: So many question words or fewer are put into the scan's filter; more are joined.
FILTERED = 200
#: Letters at the beginning of a word by which near words are met.
PREFIX = 10
#: The bucket of lists of all ids.
ALL = -1
LISTS = "term string, n int, id array<string>, tf array<bigint>, dl array<int>, segment string, bucket int"
#: White space as functions.words has it, and what str.split() and Arrow take for such besides.
SPACE, BESIDE = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+"), "\x1c\x1d\x1e\x1f"


@dataclass(frozen=True)
class Index:
    path: str
    lists: DataFrame
    postings: DataFrame
    n: int
    avgdl: float
    buckets: int


def bucket_of(term, buckets: int):
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def gathered(batches, most: int):
    """Batches put together until their second column has about so many bytes: longer lists, fewer of them."""
    waiting, size = [], 0
    for batch in itertools.chain(batches, [None]):
        n = batch.column(1).nbytes if batch is not None else 0
        if waiting and (batch is None or size + n > most):
            yield from pa.Table.from_batches(waiting).combine_chunks().to_batches()
            waiting, size = [], 0
        if batch is not None:
            waiting.append(batch)
            size += n


def words_of(texts: pa.Array) -> pa.ListArray:
    """Each text's words, besides empty ones at its begin and end."""
    if not pc.any(pc.match_substring_regex(texts, f"[{BESIDE}]")).as_py():
        return pc.utf8_split_whitespace(texts)
    return pa.array([SPACE.split(t) if any(c in t for c in BESIDE) else t.split() for t in texts.to_pylist()], pa.list_(pa.string()))


def inverted(items: DataFrame, together: int = 16_000_000) -> DataFrame:
    """term, id, tf, dl: postings of items (id, text) as lists, one of each word for texts of about so many bytes; and lists without a word, of all ids.

    A text is read once, in its task; no word or posting goes by itself from
    task to task.
    """

    def run(batches):
        for whole in gathered(batches, together):
            ends, at = np.cumsum(np.asarray(pc.binary_length(whole.column(1)))), 0
            while at < whole.num_rows:
                size = max(1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + together, "right")) - at)
                batch = whole.slice(at, size)
                at += size
                found = words_of(batch.column(1))
                lengths, known = np.asarray(found.value_lengths()), found.flatten().dictionary_encode()
                item, of = np.repeat(np.arange(size), lengths), np.asarray(known.indices).astype("int64")
                empty = pc.index(known.dictionary, "").as_py()
                if empty >= 0:  # at a text's begin or end
                    item, of = item[of != empty], of[of != empty]
                dl = np.bincount(item, minlength=size).astype("int32")
                both, tf = np.unique(of * size + item, return_counts=True)  # by word, then by text
                of, item = both // size, both % size
                present, first = np.unique(of, return_index=True)
                lists = lambda ends, *columns: [pa.ListArray.from_arrays(pa.array(ends), c) for c in columns]
                names = ["term", "id", "tf", "dl"]
                ends_of = np.append(first, len(of)).astype("int32")
                yield pa.RecordBatch.from_arrays([known.dictionary.take(pa.array(present)), *lists(ends_of, batch.column(0).take(pa.array(item)), pa.array(tf.astype("int64")), pa.array(dl[item]))], names=names)
                ends_of = np.array([0, size], dtype="int32")
                yield pa.RecordBatch.from_arrays([pa.array([None], pa.string()), *lists(ends_of, batch.column(0), pa.array(np.zeros(size, dtype="int64")), pa.array(dl))], names=names)

    texts = items.select("id", F.lower(F.coalesce("text", F.lit(""))).alias("text"))
    return texts.mapInArrow(run, "term string, id array<string>, tf array<bigint>, dl array<int>")


def listed(lists: DataFrame, *also: str) -> DataFrame:
    """Lists of postings as postings."""
    return lists.select(*also, F.inline(F.arrays_zip("id", "tf", "dl")))


def add(items: DataFrame, path: str, key: str = "id", text: str = "text", buckets: int = 32) -> None:
    """Adds items to the index at path, making it where there is none; ids that it has already are passed over.

    Each call writes a segment: lists of postings (term, n, id, tf, dl) in
    folders by a hash of the term, sorted by term, and those of all ids in one
    of their own. The segment is named in `segments` last: one that broke off
    is never read.
    """
    spark, segment = items.sparkSession, uuid.uuid4().hex
    items = items.select(F.col(key).cast("string").alias("id"), F.col(text).alias("text")).where("id is not null")
    before = segments(spark, path)
    if before is not None:
        buckets = before.first()["buckets"]
        have = spark.read.parquet(f"{path}/ids").join(F.broadcast(before.select("segment")), "segment", "left_semi")
        items = items.join(have, "id", "left_anti")
    p = inverted(items).select("term", F.size("id").alias("n"), "id", "tf", "dl", F.when(F.col("term").isNull(), ALL).otherwise(bucket_of("term", buckets)).alias("bucket"))
    # a term's lists may lie in several files, so one hot bucket isn't one task
    p = p.repartition("bucket", F.pmod(F.xxhash64(F.col("id")[0]), F.lit(4))).sortWithinPartitions("bucket", "term")
    p.withColumn("segment", F.lit(segment)).write.mode("append").partitionBy("bucket").parquet(f"{path}/postings")
    ids = listed(spark.read.schema(LISTS).parquet(f"{path}/postings").where((F.col("bucket") == ALL) & (F.col("segment") == segment)), "segment")
    stats = ids.agg(F.count("*").alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("total")).first()
    ids.select("id", "segment").write.mode("append").parquet(f"{path}/ids")
    spark.createDataFrame([(segment, stats["n"], stats["total"], buckets)], "segment string, n long, total long, buckets int").coalesce(1).write.mode("append").parquet(f"{path}/segments")


def segments(spark: SparkSession, path: str) -> DataFrame | None:
    """The index's segments that were written whole; none where there is no index."""
    return spark.read.parquet(f"{path}/segments") if exists(spark, f"{path}/segments") else None


def load(spark: SparkSession, path: str) -> Index:
    """The index as tables of its whole segments; there is one for each call of `add`."""
    rows = segments(spark, path).collect()
    whole = F.col("segment").isin([r["segment"] for r in rows])
    n, total = sum(r["n"] for r in rows), sum(r["total"] for r in rows)
    lists = spark.read.schema(LISTS).parquet(f"{path}/postings").where(whole & (F.col("bucket") != ALL))
    return Index(path, lists, listed(lists, "bucket", "term"), n, total / n if n else 1.0, rows[0]["buckets"])


def of_terms(index: Index, rows: DataFrame, terms: DataFrame) -> DataFrame:
    """Those of an index's rows that have the terms: few terms name the folders and row groups to read, many are joined by bucket and term."""
    few = [r["term"] for r in terms.select("term").distinct().limit(FILTERED + 1).collect()]
    if len(few) > FILTERED:
        return rows.join(terms.select("term").distinct().withColumn("bucket", bucket_of("term", index.buckets)), ["bucket", "term"], "left_semi")
    buckets = [r[0] for r in terms.sparkSession.createDataFrame([(t,) for t in few], "term string").select(bucket_of("term", index.buckets)).distinct().collect()]
    return rows.where(F.col("bucket").isin(buckets) & F.col("term").isin(few))


def deletions(df: DataFrame, most: int, key: str = "key") -> DataFrame:
    """df with a row for each way of leaving out up to `most` of its key's letters, from the last to the first."""
    df = df.withColumn("_last", F.length(key))
    for _ in range(most):
        df = df.select("*", F.explode(F.sequence(F.lit(0), "_last")).alias("_at"))
        less = F.concat(F.substring(key, F.lit(1), F.col("_at") - 1), F.substring(key, F.col("_at") + 1, F.length(key)))
        df = df.withColumn(key, F.when(F.col("_at") == 0, F.col(key)).otherwise(less)).withColumn("_last", F.greatest(F.col("_at") - 1, F.lit(0))).drop("_at")
    return df.drop("_last")


def near_words(asked: DataFrame, vocabulary: DataFrame, edits: int) -> DataFrame:
    """asked and the vocabulary's columns (term and others that depend on it): its words within so many edits of the words asked for.

    Two words that near have beginnings, of PREFIX letters in the vocabulary
    and up to `edits` more or less in the question, that become equal when up
    to `edits` letters are left out of each. Those are joined on, then the
    edits between whole words are counted: a word makes at most some 60 rows.
    """
    a = asked.select("asked", F.explode(F.transform(F.sequence(F.lit(-edits), F.lit(edits)), lambda x: F.substring("asked", F.lit(1), F.lit(PREFIX) + x))).alias("begin")).distinct()
    a = deletions(a.select("asked", F.col("begin").alias("key")), edits).distinct()
    v = deletions(vocabulary.withColumn("key", F.substring("term", 1, PREFIX)), edits)
    return v.join(small(written(a), 300_000), "key").select("asked", *vocabulary.columns).distinct().where(F.levenshtein("asked", "term", edits) >= 0)


def search_all(index: Index, questions: DataFrame, top_k: int = 10, fuzzy: int = 0, key: str = "query_id", text: str = "query") -> DataFrame:
    """key, id, score, rank: each question's best items by BM25 over the index; with fuzzy also by words within so many edits.

    Only postings of the questions' words are read; an item's are brought
    together and scored for all questions at once.
    """
    q = question_terms(questions, key, text)
    if fuzzy:
        known = index.lists.groupBy("term").agg(F.sum("n").alias("df"))
        near = near_words(q.select(F.col("term").alias("asked")).distinct(), known, fuzzy)
        q = written(q.withColumnRenamed("term", "asked").join(near, "asked").select(key, "term", "df").distinct())
        df = q.select("term", "df").distinct()
    else:
        q = written(q)
        df = of_terms(index, index.lists, q).groupBy("term").agg(F.sum("n").alias("df"))
    q = q.select(key, "term")
    return best_scored(listed(of_terms(index, index.lists, q), "term"), with_idf(q, df, index.n), index.avgdl, top_k, key)


def search(index: Index, question: str, k: int = 10, fuzzy: int = 0) -> DataFrame:
    """id, score: the k best items for one question."""
    one = index.postings.sparkSession.createDataFrame([(0, question)], "query_id int, query string")
    return search_all(index, one, k, fuzzy).select("id", "score").orderBy(F.desc("score"), "id")
