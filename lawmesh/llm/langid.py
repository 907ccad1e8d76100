"""Language ID by hyperdimensional profiles."""

from __future__ import annotations

import sys
import unicodedata

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lawmesh.llm.common import broadcast_value, kept, map_arrow

N = 3
CACHE_LIMIT = 60_000


def hash_mod(column, n: int = 5):
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % n


class Space:
    """Random bipolar letter vectors, bound by permutation and product into n-gram vectors.

    A letter's vector comes from its code point and the seed alone, so all
    workers agree on it; the place in the n-gram is told by rotating it.
    Gram vectors are made when first met.
    """

    def __init__(self, dims: int, seed: int):
        self.dims, self.seed = dims, seed
        self.letters: dict[int, np.ndarray] = {}
        self.row_of: dict[int, int] = {}
        self.rows = np.empty((1024, dims), dtype="int8")
        self.lower = np.zeros(sys.maxunicode + 1, dtype="uint32")  # letters by lower case, all else 0
        self.known, self.alone = (np.zeros(sys.maxunicode + 1, dtype=bool) for _ in range(2))  # alone: letters that aren't marks

    def letter(self, code: int) -> np.ndarray:
        got = self.letters.get(code)
        if got is None:
            got = np.random.default_rng((self.seed, code)).integers(0, 2, self.dims, dtype="int8") * 2 - 1
            self.letters[code] = got
        return got

    def codes(self, text: str) -> np.ndarray:
        """Lower-case letters of the text with their marks; what lies between words becomes one 0, also at both ends. Marks alone are no letters."""
        raw = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
        fresh = raw[~self.known[raw]]
        for c in set(fresh.tolist()):
            ch = chr(c)
            kind = unicodedata.category(ch)[0]
            low = ch.lower() if kind in "LM" else ""
            self.lower[c], self.known[c], self.alone[c] = ord(low[0]) if low else 0, True, kind == "L"
        low = self.lower[raw]
        if not self.alone[raw].any():
            return low[:0]
        low = np.concatenate(([0], low, [0])).astype("int64")
        keep = np.ones(len(low), dtype=bool)
        keep[1:] = (low[1:] != 0) | (low[:-1] != 0)
        return low[keep]

    def profile(self, text: str) -> np.ndarray | None:
        """The bundle of a text's gram vectors, each as often as it occurs; None without letters."""
        c = self.codes(text)
        if len(c) < N:
            return None
        grams, counts = np.unique((c[:-2] << 42) | (c[1:-1] << 21) | c[2:], return_counts=True)
        if len(self.row_of) + len(grams) > CACHE_LIMIT:
            self.row_of.clear()
        get = self.row_of.get
        at = [get(g, -1) for g in grams.tolist()]
        if -1 in at:
            for i, g in enumerate(grams.tolist()):
                if at[i] < 0:
                    at[i] = self.row_of[g] = len(self.row_of)
                    if at[i] >= len(self.rows):
                        self.rows = np.concatenate((self.rows, np.empty_like(self.rows)))
                    mask = (1 << 21) - 1
                    a, b, z = (self.letter(x) for x in (g >> 42, (g >> 21) & mask, g & mask))
                    self.rows[at[i]] = np.roll(a, 2) * np.roll(b, 1) * z
        return counts.astype("float32") @ self.rows[at].astype("float32")


def space_of(dims: int, seed: int) -> Space:
    return kept(("letters", dims, seed), lambda: Space(dims, seed))


def learn_prototypes(docs: DataFrame, dims: int, seed: int, per_language: int) -> dict[str, np.ndarray]:
    """Language -> the normalised bundle of its documents' normalised profiles.

    At most about per_language documents of each language are taken, by a hash
    of doc_id: the documented bound of the sample. Tasks bundle what they have
    read, so what comes to the driver is one vector a language and task.
    """
    labelled = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    share = {r["lang"]: min(1.0, per_language / r["n"]) for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not share:
        return {}
    rates = F.create_map(*(F.lit(x) for kv in sorted(share.items()) for x in kv))
    spread = F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1 << 20)) / float(1 << 20)
    sample = labelled.where(spread < F.element_at(rates, F.col("lang"))).select("lang", "text")

    class Bundle:
        def __init__(self):
            self.space, self.sums = space_of(dims, seed), {}

        def __call__(self, batch):
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                p = self.space.profile(text)
                if p is not None and (norm := float(np.linalg.norm(p))):
                    self.sums[lang] = self.sums.get(lang, 0) + p.astype("float64") / norm
            return []

        def finish(self):
            rows = [(lang, i, x) for lang, v in self.sums.items() for i, x in enumerate(v.tolist())]
            return dict(zip(("lang", "i", "x"), zip(*rows, strict=True) if rows else ((), (), ()), strict=True))

    summed = map_arrow(sample, Bundle, "lang string, i int, x double").groupBy("lang", "i").agg(F.sum("x").alias("x"))
    out: dict[str, np.ndarray] = {}
    for r in summed.collect():  # languages x dims
        out.setdefault(r["lang"], np.zeros(dims))[r["i"]] = r["x"]
    return {lang: v / np.linalg.norm(v) for lang, v in sorted(out.items()) if np.linalg.norm(v)}


def identify(
    docs: DataFrame,
    training: DataFrame,
    dims: int = 512,
    seed: int = 11,
    per_language: int = 2000,
    keep: bool = False,
    into: tuple[str, str] = ("lang_pred", "score"),
) -> DataFrame:
    """lang_pred and score beside doc_id (keep: beside all columns) for every whole text.

    The prediction is the language prototype with the highest cosine to the
    text's profile, the score that cosine cut to 0..1; ties go to the first
    name. Null texts, texts without a letter, and all texts when nothing was
    learned: `und`, score 0. No shuffle of texts; prototypes (languages x dims
    doubles) are broadcast. Repeated rows and null ids are rows like others.
    `into` names the two columns, for documents that have such columns already.
    """
    prototypes = learn_prototypes(training, dims, seed, per_language)
    names = list(prototypes)
    shipped = broadcast_value(docs, np.array([prototypes[n] for n in names]).reshape(len(names), dims))
    rows = docs if keep else docs.select("doc_id", "text")
    columns = [c for c in rows.columns if keep or c != "text"]

    def make():
        space, table = space_of(dims, seed), shipped.value

        def step(batch):
            pred, score = [], []
            for text in batch.column(batch.schema.get_field_index("text")).to_pylist():
                p = space.profile(text) if text and names else None
                if p is None:
                    pred.append("und")
                    score.append(0.0)
                    continue
                cosine = table @ p.astype("float64") / max(float(np.linalg.norm(p)), 1e-12)
                best = int(cosine.argmax())
                pred.append(names[best])
                score.append(min(1.0, max(0.0, float(cosine[best]))))
            return {c: batch.column(batch.schema.get_field_index(c)) for c in columns} | {into[0]: pred, into[1]: score}

        return step

    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema if f.name in columns)
    return map_arrow(rows, make, schema + f"`{into[0]}` string, `{into[1]}` double")


def identify_languages(docs: DataFrame, **options) -> DataFrame:
    """doc_id, held_out, lang_pred, score; learns from documents whose crc32(doc_id) mod 5 is not 0."""
    rows = docs.select("doc_id", "text", "lang").withColumn("held_out", hash_mod("doc_id") == 0)
    out = identify(rows.select("doc_id", "held_out", "text"), rows.where("not held_out"), keep=True, **options)
    return out.select("doc_id", "held_out", "lang_pred", "score")
