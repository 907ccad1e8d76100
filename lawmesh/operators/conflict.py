"""Conflicts between requirements, at question time and while a graph is built."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lawmesh.functions.text import (
    CONTRADICTIONS, SEVERITIES, around, contradiction, node_id, numeric_conflict, numeric_constraints, severity_rank, shared_words, significant_words,
)
from lawmesh.operators.store import written


def runtime_conflicts(
    contexts: DataFrame, pairs=CONTRADICTIONS, severities=SEVERITIES, cross_source_only: bool = False, word_boundary: bool = False, shared: int = 3,
    key: str | None = None, most: int = 1000, provider=None,
) -> DataFrame:
    """source1, source2, text1, text2, reason, confidence of retrieved contexts that conflict.

    Contexts are those of one question, so few: more than `most` are refused,
    as each is held against each. With `key` they are those of many questions,
    each of which has few, joined on it; key, ord1 and ord2 come first then.
    Columns text, source_doc, category, mandatory, severity, ord. The checks come in order, and the
    first that fits gives the reason: mandatory against optional in one
    category, contradicting terms, opposed numbers, severities two or more apart.
    """
    if key is None and contexts.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} contexts: name the key that parts them")
    c = contexts.select(
        *([key] if key else []), F.coalesce(F.lower("text"), F.lit("")).alias("t"), "text", F.coalesce("source_doc", F.lit("")).alias("s"), "category", "mandatory", "severity", "ord"
    ).withColumns({"w": significant_words("t"), "x": numeric_constraints("t"), "r": severity_rank("severity", severities)})
    a, b = (c.select(*(F.col(x) if x == key else F.col(x).alias(f"{x}{i}") for x in c.columns)) for i in (1, 2))
    met = (a.join(b, key).where("ord1 < ord2") if key else a.join(b, F.col("ord1") < F.col("ord2"))).where(shared_words("w1", "w2") >= shared)
    if cross_source_only:
        met = met.where("s1 <> s2")
    same = (F.col("category1") != "") & (F.col("category1") == F.col("category2")) & (F.col("s1") != F.col("s2"))
    met = met.withColumn("hit", contradiction("t1", "t2", pairs, word_boundary)).withColumn("num", numeric_conflict(F.col("x1"), F.col("x2")))
    pos, neg = F.col("hit.pos"), F.col("hit.neg")
    near = lambda t, x, y: F.substring(F.when(F.contains(t, x), around(t, x)).otherwise(around(t, y)), 1, 50)
    told = lambda reason, confidence: F.struct(reason.alias("reason"), F.lit(confidence).alias("confidence"))
    c1, s1, s2 = F.col("category1"), F.col("s1"), F.col("s2")
    text = F.concat
    # fixed values: the wording of the four reasons
    found = F.coalesce(
        F.when(
            same & (F.col("mandatory1") != F.col("mandatory2")),
            told(text(F.lit("Same category ("), c1, F.lit(") but different mandatoriness in "), s1, F.lit(" vs "), s2), 0.75),
        ),
        F.when(
            F.col("hit").isNotNull(),
            told(
                text(F.lit("Contradictory terms: '"), pos, F.lit("' vs '"), neg, F.lit("' - "), near(F.col("t1"), pos, neg), F.lit("... vs "), near(F.col("t2"), neg, pos), F.lit("...")),
                0.85,
            ),
        ),
        F.when(F.col("num").isNotNull(), told(text(F.lit("Conflicting numeric ranges: "), F.col("num")), 0.8)),
        F.when(
            same & (F.abs(F.col("r1") - F.col("r2")) >= 2),
            told(text(F.lit("Different severity levels for "), c1, F.lit(": "), F.col("severity1"), F.lit(" ("), s1, F.lit(") vs "), F.col("severity2"), F.lit(" ("), s2, F.lit(")")), 0.6),
        ),
    )
    if provider is not None:  # a model's opinion on what the rules pass over: null or struct(reason, confidence)
        found = F.coalesce(found, provider(F.col("text1"), F.col("text2")))
    out = met.withColumn("found", found).where("found is not null")
    return (
        (out if key else out.orderBy("ord1", "ord2"))
        .select(
            *([key, "ord1", "ord2"] if key else []),
            F.col("s1").alias("source1"),
            F.col("s2").alias("source2"),
            F.substring("text1", 1, 200).alias("text1"),
            F.substring("text2", 1, 200).alias("text2"),
            "found.reason",
            "found.confidence",
        )
    )


#: Requirements a side of a tile; the pairs of a tile are counted in one task.
TILE = 2048
#: Boolean columns that requirements may have: only pairs are made of which one or the other has each.
MARKS = ("fresh", "more")


def entity_conflicts(requirements: DataFrame, shared: int = 3, tile: int = TILE) -> DataFrame:
    """Pairs of one category, other sources and other mandatoriness that share words; columns as requirements, by ord.

    Rows: req1_id, req2_id, source1, source2, category, reason, confidence.
    Pairs are made through the words they share, never by category alone: a
    category's mandatory and optional requirements are dealt in blocks, and a
    task counts the words that the pairs of two blocks share (`counted`). So
    words go once to each block of the other side, and a pair is a row only
    when it is one of the result. With a boolean column `fresh` only pairs with
    a fresh requirement are made.
    """
    return paired(coded(requirements, shared), shared, tile)


def coded(requirements: DataFrame, shared: int = 3) -> DataFrame:
    """Requirements that can be in conflict, with numbers for the words that both sides of their category have; written."""
    r = written(
        requirements.where("category <> '' and mandatory is not null").select(
            "ord", "category", "mandatory", F.col("source_doc").alias("source"), node_id(F.lit("Requirement"), "source_doc", "text").alias("rid"),
            significant_words("text", alphanumeric=False).alias("words"), F.monotonically_increasing_id().alias("row"), *(m for m in MARKS if m in requirements.columns),
        )
    )
    each = r.select("row", "category", "mandatory", F.explode("words").alias("word"))
    common = each.groupBy("category", "word").agg(F.count("*").alias("df"), F.count_if("mandatory").alias("yes")).where("yes > 0 and yes < df")
    common = written(common.select("category", "word", F.monotonically_increasing_id().alias("code")))
    codes = each.join(common, ["category", "word"]).groupBy("row").agg(F.collect_list("code").alias("codes")).where(F.size("codes") >= shared)
    return written(r.drop("words").join(codes, "row").drop("row"))


def paired(coded: DataFrame, shared: int = 3, tile: int = TILE, most: int = 10_000) -> DataFrame:
    """`entity_conflicts` of what is coded. Tiles are dealt to as many tasks, up to `most`: they have few bytes, by which Spark would put many of them into one."""
    sides = coded.groupBy("category").agg(*(F.ceil(F.count_if(c) / tile).cast("int").alias(n) for c, n in ((F.col("mandatory"), "of_y"), (~F.col("mandatory"), "of_n")))).where("of_y > 0 and of_n > 0")
    tiles = sides.agg(F.coalesce(F.sum(F.col("of_y").cast("long") * F.col("of_n")), F.lit(0))).first()[0]
    own = F.pmod(F.xxhash64("rid", "ord"), F.when(F.col("mandatory"), F.col("of_y")).otherwise(F.col("of_n"))).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.when(F.col("mandatory"), F.col("of_n")).otherwise(F.col("of_y")) - 1))
    dealt = coded.join(sides, "category").withColumn("own", own).withColumn("other", every)
    y, n = (F.when(F.col("mandatory"), F.col(a)).otherwise(F.col(b)) for a, b in (("own", "other"), ("other", "own")))
    marks = [F.col(m).cast("int") * (1 << k) for k, m in enumerate(m for m in MARKS if m in coded.columns)]
    dealt = dealt.select("category", y.alias("y"), n.alias("n"), "mandatory", sum(marks, F.lit(0)).alias("mark"), "ord", "source", "rid", "codes")
    kind = coded.schema["ord"].dataType.simpleString()
    schema = ", ".join(f"ord_{p} {kind}, source_{p} string, rid_{p} string" for p in "yn") + ", category string"
    dealt = dealt.repartition(max(1, min(tiles, most)), "category", "y", "n")
    pairs = dealt.groupBy("category", "y", "n").applyInArrow(counted(shared, (1 << len(marks)) - 1), schema).where("source_y <> source_n")
    first = lambda c: F.when(F.col("ord_y") < F.col("ord_n"), F.col(f"{c}_y")).otherwise(F.col(f"{c}_n"))
    second = lambda c: F.when(F.col("ord_y") < F.col("ord_n"), F.col(f"{c}_n")).otherwise(F.col(f"{c}_y"))
    return pairs.select(
        first("rid").alias("req1_id"), second("rid").alias("req2_id"), first("source").alias("source1"), second("source").alias("source2"), "category",
        F.concat("category", F.lit(": mandatory in "), first("source"), F.lit(" but optional in "), second("source")).alias("reason"),
        F.lit(0.7).alias("confidence"),
    )


def counted(shared: int, wanted: int = 0, rows: int = 256, most: int = 1 << 22):
    """For applyInArrow: the pairs of a tile's mandatory and optional rows with `shared` codes in common, a few mandatory rows at a time.

    Only rows whose marks together are all that are wanted are held against each other.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = pa.Table.from_batches(list(batches))
        yes = whole["mandatory"]
        sides = [{m: whole.filter(pc.and_(c, pc.equal(whole["mark"], m))).combine_chunks() for m in range(wanted + 1)} for c in (yes, pc.invert(yes))]
        for a, y in sides[0].items():
            for b, n in sides[1].items():
                if a | b == wanted and len(y) and len(n):
                    yield from met(y, n)

    def met(y: pa.Table, n: pa.Table) -> Iterator[pa.RecordBatch]:
        (of_y, at_y), (of_n, at_n) = ((np.repeat(np.arange(len(t)), pc.list_value_length(t["codes"]).to_numpy()), pc.list_flatten(t["codes"]).to_numpy()) for t in (y, n))
        category = y["category"][0]
        y, n = (t.select(["ord", "source", "rid"]) for t in (y, n))
        order = np.argsort(at_n, kind="stable")
        at_n, of_n = at_n[order], of_n[order]
        low, high = (np.searchsorted(at_n, at_y, side) for side in ("left", "right"))
        for begin in range(0, len(y), rows):
            some = slice(*np.searchsorted(of_y, (begin, begin + rows)))
            lo, many, base = low[some], (high - low)[some], (of_y[some] - begin) * len(n)
            told, found = np.cumsum(many), np.zeros(min(rows, len(y) - begin) * len(n), np.int32)
            at = 0
            while at < len(many):  # at most `most` places at once, or one code's
                to = max(at + 1, int(np.searchsorted(told, told[at] - many[at] + most, "right")))
                m = many[at:to]
                place = np.repeat(lo[at:to] - (np.cumsum(m) - m), m) + np.arange(m.sum())
                found += np.bincount(np.repeat(base[at:to], m) + of_n[place], minlength=len(found)).astype(np.int32)
                at = to
            row, col = np.divmod(np.flatnonzero(found >= shared), len(n))
            row += begin
            for k in range(0, len(row), 1 << 16):
                a, b = y.take(row[k : k + (1 << 16)]), n.take(col[k : k + (1 << 16)])
                columns = [c.combine_chunks() for t in (a, b) for c in t.columns]
                yield pa.RecordBatch.from_arrays([*columns, pa.repeat(category, len(a))], names=[f"{c}_{p}" for p in "yn" for c in ("ord", "source", "rid")] + ["category"])

    return run
