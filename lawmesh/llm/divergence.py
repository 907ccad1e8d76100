"""How far the sources of a language diverge in their terms: in-mapper stripes, merged by key."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lawmesh.llm.common import map_arrow, settle

#: A term's bytes as they are, A-Z in lower case; every other byte parts terms. No byte of a letter beyond ASCII is below 128.
TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
BILLION = 1_000_000_000


def fold_stripes(most: int):
    """A step that folds whole documents into stripes and gives them out at the end, or earlier where there are over `most` counts.

    The stripes of a language are a hash of its terms to rows, the documents of
    each row, and its counts by source as triples (row, source, count) that
    are added up now and then. What a batch tells is counted in arrays.
    """

    class Fold:
        def __init__(self):
            self.clear()

        def clear(self):
            self.rows, self.sources, self.df, self.keys, self.counts, self.size = {}, {}, {}, [], [], 0

        def __call__(self, batch):
            of = dict.fromkeys(langs := batch.column("lang").to_pylist())
            sources, texts = batch.column("source").to_pylist(), batch.column("text").to_pylist()
            for lang in of:
                mine = [k for k, x in enumerate(langs) if x == lang]
                self.add(lang, np.array([self.sources.setdefault(sources[k], len(self.sources)) for k in mine]), [texts[k].translate(TERM_BYTES) for k in mine])
            if self.size > most:
                self.add_up()
                if self.size > most / 2:
                    return self.finish()
            return []

        def add(self, lang, source, texts):
            words = pa.array(b" \xff ".join([b"", *texts]).split(), pa.binary()).dictionary_encode()
            names, ids = words.dictionary.to_pylist(), words.indices.to_numpy()
            stop = names.index(b"\xff")
            doc = np.cumsum(ids == stop) - 1
            each, n = np.unique((doc * len(names) + ids)[ids != stop], return_counts=True)
            doc, term = np.divmod(each, len(names))
            rows = self.rows.setdefault(lang, {})
            row = np.array([-1 if t == b"\xff" else rows.setdefault(t, len(rows)) for t in names])
            df = self.df.get(lang, np.zeros(0, np.int64))
            self.df[lang] = np.bincount(row[term], minlength=len(rows)) + np.pad(df, (0, len(rows) - len(df)))
            key, n = summed(row[term] << 24 | source[doc], n)
            self.keys.append((lang, key))
            self.counts.append(n)
            self.size += len(key)

        def add_up(self):
            by_lang = {lang: summed(*(np.concatenate(x) for x in zip(*((k, n) for (was, k), n in zip(self.keys, self.counts, strict=True) if was == lang), strict=True))) for lang in self.rows}
            self.keys, self.counts = [(lang, k) for lang, (k, _) in by_lang.items()], [n for _, n in by_lang.values()]
            self.size = sum(map(len, self.counts))

        def finish(self):
            self.add_up()
            names, out = pa.array(list(self.sources), pa.string()), []
            for (lang, key), n in zip(self.keys, self.counts, strict=True):
                if len(key):
                    terms = [t.decode() for t in self.rows[lang]]
                    starts = np.append(np.flatnonzero(np.diff(key >> 24, prepend=-1)), len(key)).astype(np.int32)
                    stripe = pa.StructArray.from_arrays([names.take(pa.array(key & 0xFFFFFF)), pa.array(n)], ["source", "n"])
                    out.append({"lang": pa.array([lang] * len(terms)), "term": pa.array(terms), "df": self.df[lang], "stripe": pa.ListArray.from_arrays(pa.array(starts), stripe)})
            self.clear()
            return out

    return Fold


def summed(key, n):
    """Each key once, with the sum of its numbers."""
    order = np.argsort(key, kind="stable")
    key, n = key[order], n[order]
    first = np.flatnonzero(np.diff(key, prepend=-1))
    return key[first], np.add.reduceat(n, first) if len(first) else n


def merged_stripes(docs: DataFrame, most: int = 1_000_000) -> DataFrame:
    """lang, term, df, stripe: for each term of a language its documents and its count by source.

    A task gives at most one row for a term and source between spills, so the
    merge by term and source meets few rows of one key, however frequent it
    is; only then do the counts of a term come together, one for each source.
    """
    folded = map_arrow(docs.select("lang", "source", F.col("text").cast("binary").alias("text")), fold_stripes(most), "lang string, term string, df long, stripe array<struct<source:string,n:long>>", rows=4096)
    counts = folded.select("lang", "term", "df", F.posexplode("stripe").alias("k", "s")).select("lang", "term", "s.source", "s.n", F.when(F.col("k") == 0, F.col("df")).otherwise(0).alias("df"))
    counts = counts.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))
    return counts.groupBy("lang", "term").agg(F.sum("df").alias("df"), F.collect_list(F.struct("source", "n")).alias("stripe"))


def share(count, total, terms, smooth: int):
    """1 + floor(10^9 x (count + smooth) / (total + smooth x terms)) in whole numbers of up to 38 digits."""
    above = ((count + smooth) * F.lit(BILLION).cast("decimal(10,0)")).cast("decimal(38,0)")
    return F.call_function("div", above, (total + smooth * terms).cast("decimal(38,0)")) + 1


def distances(stripes, groups):
    """Sums of |p - q| over the terms at hand for every two sources of two tiles: i, j, value.

    A source that a stripe doesn't name has its p of no occurrence there.
    """
    i, p0 = groups["i"].to_numpy(), groups["p0"].to_numpy()
    order = np.argsort(i)
    i, p0 = i[order], p0[order]
    value = np.zeros((len(i), len(i)), np.int64)
    sizes = np.diff(stripes["at"].combine_chunks().offsets.to_numpy())
    row = np.repeat(np.arange(len(sizes)), sizes)
    flat = lambda c: stripes[c].combine_chunks().flatten().to_numpy()
    column, p = np.searchsorted(i, flat("at")), flat("p")
    for at in range(0, len(sizes), 512):
        mine = slice(*np.searchsorted(row, (at, at + 512)))
        dense = np.repeat(p0[None, :], min(512, len(sizes) - at), axis=0)
        dense[row[mine] - at, column[mine]] = p[mine]
        for k in range(len(i)):
            value[k] += np.abs(dense - dense[:, k : k + 1]).sum(axis=0)
    return i, value


def pair_sums(stripes: DataFrame, groups: DataFrame, tile: int, together: int) -> DataFrame:
    """lang, i, j, value: the distance of each source i to each other one j of its language.

    Sources lie in tiles of `tile` and terms in lots of about `together`; a
    lot's stripes, cut to two tiles, meet the sources of these in one call, so
    neither a language with many terms nor one with many sources is gathered.
    A language with up to `tile` sources has one tile, and nothing is repeated.
    """
    tiles = F.col("tiles").cast("int")
    last = F.sequence(F.lit(0), tiles - 1)
    pairs = F.flatten(F.transform(last, lambda a: F.transform(F.sequence(a, tiles - 1), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    within = lambda x: (F.floor(x["i"] / tile) == F.col("pair.a")) | (F.floor(x["i"] / tile) == F.col("pair.b"))
    cut = stripes.withColumn("lot", F.pmod(F.xxhash64("term"), F.col("lots"))).select("lang", "lot", "stripe", F.explode(pairs).alias("pair"))
    cut = cut.select("lang", "lot", "pair", F.filter("stripe", within).alias("stripe"))
    cut = cut.select("lang", "lot", F.col("pair.a").alias("a"), F.col("pair.b").alias("b"), F.col("stripe.i").alias("at"), F.col("stripe.p").alias("p"))
    here = groups.withColumn("own", F.floor(F.col("i") / tile).cast("int")).withColumn("pair", F.explode(pairs)).where("own = pair.a or own = pair.b")
    here = here.select("lang", F.explode(F.sequence(F.lit(0).cast("long"), F.col("lots") - 1)).alias("lot"), F.col("pair.a").alias("a"), F.col("pair.b").alias("b"), "i", "p0")

    def meet(key, left, right):
        i, value = distances(left, right)
        a, b = key[2].as_py(), key[3].as_py()
        x, y = np.nonzero(np.ones_like(value) - np.eye(len(i), dtype=np.int64))
        if a != b:  # pairs within a tile are told by that tile
            apart = i[x] // tile != i[y] // tile
            x, y = x[apart], y[apart]
        return pa.table({"lang": pa.array([key[0].as_py()] * len(x), pa.string()), "i": i[x], "j": i[y], "value": value[x, y]})

    keys = ("lang", "lot", "a", "b")
    sums = cut.groupBy(*keys).cogroup(here.groupBy(*keys)).applyInArrow(meet_empty(meet), "lang string, i long, j long, value long")
    return sums.groupBy("lang", "i", "j").agg(F.sum("value").alias("value"))


def meet_empty(meet):
    """Lots without a term tell nothing."""
    none = pa.table({"lang": pa.array([], pa.string()), **{c: pa.array([], pa.int64()) for c in ("i", "j", "value")}})

    def run(key, left, right):
        return meet(key, left, right) if left.num_rows else none

    return run


def source_divergence(docs: DataFrame, least: int = 30, smooth: int = 5, first: int = 50, tile: int = 512, together: int = 4096) -> DataFrame:
    """lang, source, part, item, value, rank: how sources of a language differ, and the terms that mark them.

    Tasks fold whole documents into stripes (a term's documents and its count
    by source), which are merged by key; a language keeps the terms of at
    least `least` of its documents. From the merged stripes come the terms
    whose share in a source exceeds that in the language (part `term`, the
    `first` best of each source) and the distance of all sources of a language
    from each other (part `pair`). All arithmetic is in whole numbers.

    Null text, lang or source: read as ''. Empty texts and sources without
    terms: they have pairs, no terms. Repeated rows: each counts as a document.
    Ties: by item in UTF-8 order. A language with one source has no pairs.
    Empty table: no rows. Further columns are ignored. A text is held whole in
    its task; nothing else grows with a document, a source or a language.
    """
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    docs = docs.select(blank("lang"), blank("source"), blank("text"))
    stripes = settle(merged_stripes(docs).where(F.col("df") >= least))
    terms = stripes.groupBy("lang").agg(F.count("*").alias("terms"), F.sum(F.aggregate("stripe", F.lit(0).cast("long"), lambda a, s: a + s["n"])).alias("lang_total"))
    totals = stripes.select("lang", F.explode("stripe").alias("s")).groupBy("lang", "s.source").agg(F.sum("s.n").alias("total"))
    by_name = Window.partitionBy("lang").orderBy("source")
    groups = docs.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(terms, "lang", "left")
    groups = groups.select(
        "lang", "source", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("terms", F.lit(0)).alias("terms"), F.coalesce("lang_total", F.lit(0)).alias("lang_total"),
        (F.row_number().over(by_name) - 1).cast("long").alias("i"), F.count("*").over(Window.partitionBy("lang")).alias("sources"),
    )
    groups = settle(
        groups.withColumns({
            "p0": F.when(F.col("terms") > 0, share(F.lit(0), F.col("total"), F.col("terms"), smooth)),
            "lots": F.ceil(F.col("terms") / together).cast("long"), "tiles": F.ceil(F.col("sources") / tile),
        })
    )

    entries = stripes.select("lang", "term", F.aggregate("stripe", F.lit(0).cast("long"), lambda a, s: a + s["n"]).alias("all"), F.explode("stripe").alias("s"))
    entries = entries.select("lang", "term", "all", "s.source", "s.n").join(groups, ["lang", "source"])
    entries = settle(
        entries.select("lang", "source", "term", "i", "lots", "tiles", share(F.col("n"), F.col("total"), F.col("terms"), smooth).alias("p"), share(F.col("all"), F.col("lang_total"), F.col("terms"), smooth).alias("q"))
    )
    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    marking = entries.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    marking = marking.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= first)

    told = entries.groupBy("lang", "term").agg(F.first("lots").alias("lots"), F.first("tiles").alias("tiles"), F.collect_list(F.struct("i", "p")).alias("stripe"))
    sums = pair_sums(told, groups.where("terms > 0"), tile, together)
    name = lambda c, n: groups.select("lang", F.col("i").alias(c), F.col("source").alias(n))
    ordered = groups.where("terms = 0").select("lang", "source")
    none = ordered.join(ordered.select("lang", F.col("source").alias("item")), "lang").where("source <> item").withColumn("value", F.lit(0).cast("long"))
    pairs = sums.join(name("i", "source"), ["lang", "i"]).join(name("j", "item"), ["lang", "j"]).select("lang", "source", "item", "value")
    pairs = pairs.unionByName(none.select("lang", "source", "item", "value")).withColumn("part", F.lit("pair")).withColumn("rank", F.row_number().over(best))
    columns = ("lang", "source", "part", "item", "value", "rank")
    return pairs.select(*columns).unionByName(marking.select(*columns))
