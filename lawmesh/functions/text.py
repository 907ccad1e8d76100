"""Column expressions over text; all stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Terms that contradict each other; the first pair that fits counts.
CONTRADICTIONS = (
    ("shall", "shall not"),
    ("must", "must not"),
    ("required", "not required"),
    ("required", "optional"),
    ("mandatory", "optional"),
    ("always", "never"),
    ("permitted", "prohibited"),
    ("allowed", "forbidden"),
    ("mandatory", "prohibited"),
    ("required", "forbidden"),
    ("shall", "may"),
    ("must", "may"),
)
#: Words that link an exemption with a requirement.
EXEMPTION_WORDS = ("aseptic", "filling", "sterile", "monitoring")
#: Severities from low to high, as compared; others are not ranked.
SEVERITIES = ("Low", "Medium", "High", "Critical")
#: Fixed value: a comparison, its number and its unit.
NUMERIC = r"([<>≤≥]=?)\s*(\d+(?:\.\d+)?)\s*([°C°FK%]*)"
#: A directive's code, and the wording by which one gives way to another, by full name and by code.
CODE = r"[0-9]{2,4}/[0-9]+/[A-Z]+"
SUPERSEDES = (
    r"(?i)([A-Z][a-z]+\s+(?:Directive|Regulation)\s+(?:\([A-Z]+\)\s+)?[0-9]{2,4}/[0-9]+/[A-Z]+)\s+(?:is\s+)?(repealed|replaced|superseded)\s+by\s+([A-Z][a-z]+\s+(?:Directive|Regulation)\s+(?:\([A-Z]+\)\s+)?[0-9]{2,4}/[0-9]+/[A-Z]+)",
    r"(?i)([0-9]{2,4}/[0-9]+/[A-Z]+)\s+(?:is\s+)?(repealed|replaced|superseded)\s+by\s+([0-9]{2,4}/[0-9]+/[A-Z]+)",
)


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


#: Fixed value: white space of any kind, the same as (?U)\s in patterns.
SPACE = "".join(map(chr, (*range(0x9, 0xE), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))


def strip(c) -> Column:
    """Without white space of any kind at both ends; by its characters, as a pattern would try every place of the text."""
    return F.trim(col(c), F.lit(SPACE))


def contains(c, needle) -> Column:
    """Case-insensitive containment; null if either side is."""
    return F.contains(F.lower(col(c)), F.lower(needle if isinstance(needle, Column) else F.lit(needle)))


def any_contains(columns, needle) -> Column:
    out = None
    for c in columns:
        out = contains(c, needle) if out is None else out | contains(c, needle)
    return out


def node_id(label, source, text, digits: int = 8) -> Column:
    """label_source_hash: the first digits of the MD5 of the stripped lower-case text; 32 for the whole hash."""
    key = F.when(F.coalesce(col(text), F.lit("")) == "", F.lit("unknown")).otherwise(strip(F.lower(col(text))))
    return F.concat_ws("_", F.lower(label), F.replace(F.lower(F.coalesce(col(source), F.lit(""))), F.lit(" "), F.lit("_")), F.substring(F.md5(key.cast("binary")), 1, digits))


def sentences(c, longer_than: int = 20) -> Column:
    """The stripped sentences of more than so many characters."""
    parts = F.transform(F.split(col(c), r"(?U)(?<=[.!?])\s+"), strip)
    return F.filter(parts, lambda s: F.length(s) > longer_than)


def words(c) -> Column:
    return F.filter(F.split(col(c), r"(?U)\s+"), lambda w: w != "")


def word_count(c) -> Column:
    return F.size(words(c))


def significant_words(c, alphanumeric: bool = True) -> Column:
    """The distinct words of more than four characters, by default of letters and digits only."""
    long = F.filter(words(F.lower(col(c))), lambda w: F.length(w) > 4)
    return F.array_distinct(F.filter(long, lambda w: w.rlike(r"(?U)^\p{Alnum}+$")) if alphanumeric else long)


def shared_words(a, b) -> Column:
    return F.size(F.array_intersect(col(a), col(b)))


def token_estimate(c) -> Column:
    return word_count(c) * F.lit(1.3)


def source_of_path(c) -> Column:
    """The source that a file's path tells of; the first that fits."""
    p = F.lower(col(c))
    has = lambda *names: F.greatest(*(F.contains(p, F.lit(n)) for n in names)) if len(names) > 1 else F.contains(p, F.lit(names[0]))
    return (
        F.when(has("mhra"), "MHRA").when(has("eu_gmp", "eudralex"), "EU GMP").when(has("uk_gmp"), "UK GMP").when(has("ich"), "ICH").otherwise("Unknown")
    )


def around(c, keyword, window: int = 30) -> Column:
    """The text beside a keyword's first place, or the first 50 characters without it."""
    c, keyword = col(c), keyword if isinstance(keyword, Column) else F.lit(keyword)
    at = F.position(keyword, c)
    start = F.greatest(F.lit(1), at - window)
    length = at + F.length(keyword) + window - start
    return F.when(at == 0, F.substring(c, 1, 50)).otherwise(strip(F.substr(c, start, length)))


def contradiction(a, b, pairs=CONTRADICTIONS, word_boundary: bool = False) -> Column:
    """struct(pos, neg) of the first pair of which one text has the one term and the other the other; else null."""
    a, b = col(a), col(b)

    def has(c, term):
        return c.rlike(rf"\b{term}\b") if word_boundary else F.contains(c, F.lit(term))

    return F.coalesce(
        *(
            F.when((has(a, p) & has(b, n)) | (has(a, n) & has(b, p)), F.struct(F.lit(p).alias("pos"), F.lit(n).alias("neg")))
            for p, n in pairs
        )
    )


def numeric_constraints(c) -> Column:
    """array<struct(op, value, unit)> in order."""
    op, value, unit = (F.regexp_extract_all(col(c), F.lit(NUMERIC), F.lit(i)) for i in (1, 2, 3))
    return F.transform(
        op, lambda o, i: F.struct(o.alias("op"), value[i].alias("value"), unit[i].alias("unit"))
    )


def opposed(x: Column, y: Column) -> Column:
    """Opposite comparisons whose ranges don't meet, in one unit."""
    v, w = x["value"].cast("double"), y["value"].cast("double")
    less, more = lambda c: F.contains(c["op"], F.lit("<")), lambda c: F.contains(c["op"], F.lit(">"))
    return (x["unit"] == y["unit"]) & ((less(x) & more(y) & (v < w)) | (more(x) & less(y) & (v > w)))


def numeric_conflict(a: Column, b: Column) -> Column:
    """The first opposed pair of two arrays of constraints as text, `<5 vs >10`; else null."""
    told = lambda c: F.concat(c["op"], c["value"], c["unit"])
    hits = F.flatten(F.transform(a, lambda x: F.transform(F.filter(b, lambda y: opposed(x, y)), lambda y: F.concat(told(x), F.lit(" vs "), told(y)))))
    return F.try_element_at(hits, F.lit(1))


def severity_rank(c, scale=SEVERITIES) -> Column:
    """1 for the lowest; null for a severity outside the scale."""
    at = F.array_position(F.array(*(F.lit(s) for s in scale)), col(c))
    return F.when(at > 0, at)


def percent(c) -> Column:
    return F.format_string("%.0f%%", col(c) * 100)
