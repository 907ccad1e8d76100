"""Secret scans by a trigram inverted index: Boolean queries of trigrams from each rule's pattern, then verification."""

from __future__ import annotations

import re._constants as sre
import re._parser as regex
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lawmesh.llm.common import settle


@dataclass(frozen=True)
class Rule:
    """What a kind of secret looks like; a match counts if its whole and its group are long enough.

    Patterns are read alike by Java and Python: classes, groups, | ? + * {}.
    """

    kind: str
    pattern: str
    length: int = 0
    group: int = 0
    group_length: int = 0


#: The three kinds whose spans are counted, in this order.
BASE = (
    Rule("assign", r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", group=2, group_length=6),
    Rule("access", r"AKIA[A-Z0-9]+", length=20),
    Rule("hex", r"[0-9a-f]+", length=24),
)
#: Kinds that are told besides: tokens whose issuers give them a prefix, private keys, signed tokens, addresses with a password.
MORE = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", length=40),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", length=15),
    Rule("stripe", r"[sr]k_(live|test)_[A-Za-z0-9]+", length=24),
    Rule("google", r"AIza[0-9A-Za-z_-]+", length=39),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", length=30),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("url", r"://[A-Za-z0-9._%+-]+:[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+"),
)
RULES = BASE + MORE
GAP = None


def skeletons(parsed, most: int = 256) -> list[tuple]:
    """The ways through a pattern, each as its literal strings with a GAP for what may vary; all one GAP if there are over `most` ways."""
    ways = [()]
    for op, value in parsed:
        if op is sre.LITERAL:
            more = [(chr(value),)]
        elif op is sre.IN and value[0][0] is not sre.NEGATE and all(k is sre.LITERAL for k, _ in value):
            more = [(chr(v),) for _, v in value]
        elif op is sre.SUBPATTERN:
            more = skeletons(value[3], most)
        elif op is sre.BRANCH:
            more = [w for branch in value[1] for w in skeletons(branch, most)]
        elif op is sre.MAX_REPEAT and value[1] == 1:
            more = [(), *skeletons(value[2], most)] if value[0] == 0 else skeletons(value[2], most)
        elif op is sre.MAX_REPEAT and value[0] == value[1] <= 8:
            more = [w * value[0] for w in skeletons(value[2], most)]
        elif op is sre.MAX_REPEAT and value[0] > 0:
            more = [(*w, GAP) for w in skeletons(value[2], most)]
        else:
            more = [(GAP,)]
        ways = [a + b for a in ways for b in more] if len(ways) * len(more) <= most else [(*a, GAP) for a in ways]
    return ways


def trigram_query(pattern: str) -> list[list[str]]:
    """The pattern's Boolean query over trigrams in lower case: one of the lists must occur whole. Empty: no trigram is mandatory."""
    clauses = set()
    for way in skeletons(regex.parse(pattern)):
        runs = "".join(c if c is not GAP else "\0" for c in way).lower().split("\0")
        clauses.add(frozenset(r[i : i + 3] for r in runs for i in range(len(r) - 2)))
    if frozenset() in clauses:
        return []
    return sorted(sorted(c) for c in clauses if not any(d < c for d in clauses))


def postings(texts: DataFrame, trigrams: list[str]) -> DataFrame:
    """trigram, key: which of the texts, told by their hash, have which trigrams. Texts that share a hash share their postings, which only adds candidates."""
    low = F.lower("text")
    has = F.array_compact(F.array(*(F.when(F.contains("low", F.lit(t)), F.lit(t)) for t in trigrams)))
    return texts.select("key", low.alias("low")).select("key", F.explode(has).alias("trigram")).distinct()


def candidates(index: DataFrame, queries: dict[str, list[list[str]]]) -> DataFrame:
    """key, rules: the rules of which a text has all the trigrams of a clause; postings are counted by text and clause."""
    asked = [(kind, n, t, len(clause)) for kind, clauses in queries.items() for n, clause in enumerate(clauses) for t in clause]
    spark = index.sparkSession
    clauses = spark.createDataFrame(asked, "rule string, clause int, trigram string, needs long")
    met = index.join(F.broadcast(clauses), "trigram")  # as many rows as the rules have trigrams
    whole = met.groupBy("key", "rule", "clause", "needs").agg(F.count("*").alias("n")).where("n = needs")
    return whole.groupBy("key").agg(F.collect_set("rule").alias("rules"))


def let(value, then):
    """then(value), with the value made once."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def sums(numbers):
    return F.aggregate(numbers, F.array().cast("array<bigint>"), lambda acc, x: F.array_append(acc, F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0).cast("long")) + x))


def running(lengths, block: int = 256):
    """Sums of an array of numbers up to each of its places, in blocks, so that the work for n numbers is about n x (block + n / block^2)."""
    blocks = F.transform(F.sequence(F.lit(0), F.ceil(F.size(lengths) / block).cast("int") - 1), lambda b: sums(F.slice(lengths, b * block + 1, block)))

    def joined(blocks):
        before = F.concat(F.array(F.lit(0).cast("long")), sums(F.transform(blocks, lambda a: F.element_at(a, -1))))
        return F.flatten(F.zip_with(blocks, F.slice(before, 1, F.size(blocks)), lambda a, x: F.transform(a, lambda y: x + y)))

    return let(blocks, joined)


def spans(rule: Rule, rank: int, found):
    """The places of the rule's matches `found` in column `text`, which are some: what lies between them gives where they begin, they themselves where they end."""
    long = lambda s: F.length(s).cast("long")
    steps = F.zip_with(F.slice(F.split("text", rule.pattern, -1), 1, F.size(found)), found, lambda between, m: long(between) + long(m))
    told = lambda m: F.length(F.regexp_extract(m, rule.pattern, rule.group)) >= rule.group_length if rule.group else F.lit(True)
    rows = F.zip_with(found, let(steps, lambda s: running(s)), lambda m, end: F.struct((end - long(m)).alias("start"), F.lit(rank).alias("rank"), F.lit(rule.kind).alias("kind"), end.alias("end"), (told(m) & (long(m) >= rule.length)).alias("good")))
    return F.transform(F.filter(rows, lambda r: r["good"]), lambda r: F.struct(*(r[c].alias(c) for c in ("start", "rank", "kind", "end"))))


def as_text(found):
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES, small: int = 2_000_000) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans: the secrets in every whole text.

    An index of the rules' trigrams is built over the distinct hashes of all
    texts and written; each rule's query is answered from its postings, and
    the rule's pattern is run over its candidates only. Rules without a
    mandatory trigram are run over all texts. The candidates are broadcast up
    to `small` of them, else joined on the hash. Spans are in code points, end
    exclusive, by start and then in the order of the rules; of one rule they
    don't overlap.

    Null or empty text: no spans. Null or repeated doc_id and repeated rows:
    each row has its own result. Ties at one start: by rule. Empty table: no
    rows. Further columns are ignored. All steps are Spark's functions.
    """
    queries = {r.kind: trigram_query(r.pattern) for r in rules}
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("key", F.xxhash64("text"))
    index = settle(postings(keyed, sorted({t for q in queries.values() for c in q for t in c})))
    found = settle(candidates(index, {k: q for k, q in queries.items() if q}))
    found = F.broadcast(found) if found.count() <= small else found
    rows = keyed.join(found, "key", "left")
    none = F.array().cast("array<struct<start:bigint,rank:int,kind:string,end:bigint>>")
    for rank, r in enumerate(rules):
        asked = F.array_contains("rules", F.lit(r.kind)) if queries[r.kind] else F.col("text").rlike(f"{r.pattern[:-1]}{{{r.length},}}" if re_run(r) else r.pattern)
        rows = rows.withColumn(f"_found{rank}", F.when(asked, F.regexp_extract_all("text", F.lit(r.pattern), F.lit(0))))
    rows = rows.withColumns({f"_{k}": F.when(F.size(f"_found{k}") > 0, spans(r, k, F.col(f"_found{k}"))).otherwise(none) for k, r in enumerate(rules)})
    every = lambda n: F.array_sort(F.concat(*(F.col(f"_{k}") for k in range(n))))
    n = len(BASE)
    return rows.select(
        "doc_id", *(F.size(f"_{k}").cast("long").alias(f"n_{r.kind}") for k, r in enumerate(rules[:n])),
        F.sha2(as_text(every(n)).cast("binary"), 256).alias("base_sha256"), as_text(every(len(rules))).alias("spans"),
    )


def re_run(rule: Rule) -> bool:
    """Whether a pattern is one class repeated: then only a run of the least length can match."""
    parsed = list(regex.parse(rule.pattern))
    return len(parsed) == 1 and parsed[0][0] is sre.MAX_REPEAT and parsed[0][1][0] == 1 and not rule.group and rule.length > 0
