"""Phrase collocations: best-first growth of phrases, pruned by bounds on their scores."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lawmesh.llm.common import broadcast_value, map_arrow, settle

#: What ends a piece stands as a byte that no UTF-8 text has; a tab parts words as a space does.
END = b"\xff"
PIECES = bytes(255 if b in b".,;:!?\x0a\x0b\x0c\x0d" else 32 if b == 9 else b + 32 if 65 <= b <= 90 else b for b in range(256))


def blocks(texts: list[bytes], most: int):
    """The texts' pieces, each ended by END, in blocks of about `most` bytes, never cut within a piece."""
    data = END + END.join(texts).translate(PIECES) + END
    at = 0
    while at < len(data) - 1:
        cut = data.rfind(END, at + 1, at + most)
        cut = cut if cut > at else data.find(END, at + 1)
        yield data[at : cut + 1].replace(END, b" \xff ").split()
        at = cut


def hashes(lang: str, words) -> np.ndarray:
    seed = xxhash.xxh64_intdigest(lang)
    return np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in words), np.uint64, len(words))


def folded(columns: list[np.ndarray]) -> np.ndarray:
    """A hash for each phrase from those of its words; of one word it is the word's own."""
    return reduce(lambda h, w: h * np.uint64(0x9E3779B97F4A7C15) + w, columns)


def place(h: np.ndarray, bits: int) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return (h ^ (h >> np.uint64(29))) >> np.uint64(64 - bits)


def bitmap(phrases: DataFrame, bits: int):
    """A bitmap of 2^bits places for (lang, phrase), whatever their number: it may hold more phrases than it should, never fewer.

    It is put together by Spark in pieces of 32,768 places, which are all that
    the driver collects and sends out: 2^bits / 8 bytes.
    """

    def make():
        def step(batch):
            told = [place(folded(list(hashes(lang, p.encode().split(b" "))[:, None])), bits)[0] for lang, p in zip(*(batch.column(c).to_pylist() for c in ("lang", "phrase")), strict=True)]
            return {"place": np.array(told, np.uint64).astype(np.int64) + 1}

        return step

    places = map_arrow(phrases.select("lang", "phrase"), make, "place long", rows=8192)
    pieces = places.groupBy(F.bitmap_bucket_number("place").alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("piece"))
    out = np.zeros(1 << (bits - 3), np.uint8)
    for k, piece in pieces.collect():
        out[(k - 1) * 4096 : k * 4096] = np.frombuffer(piece, np.uint8)[: len(out)]
    return broadcast_value(phrases, out)


def holds(shared, h: np.ndarray, bits: int) -> np.ndarray:
    p = place(h, bits)
    return (shared[(p >> np.uint64(3)).astype(np.int64)] >> (p & np.uint64(7)).astype(np.uint8)) & 1 == 1


def counted(docs: DataFrame, length: int, bits: int = 0, frequent=None, edges=None, told=None, known=None, longest: int = 5, most: int = 8 << 20) -> DataFrame:
    """lang, phrase, a, after, before: counts of the phrases of `length` words that may count.

    A phrase may count if all its words are frequent, its first or last one is
    among `edges` and none of these among `told`, and if its part without the
    last word (where the first is an edge) or without the first one (where the
    last is) is `known`. All of these are bitmaps, so a phrase is counted at
    each of its places or at none. after and before: 15 bits of the hash of
    the words that follow or precede it, 0 if these differ or a piece ends.
    """

    def make():
        maps = {n: None if m is None else m.value for n, m in (("frequent", frequent), ("edges", edges), ("told", told), ("known", known))}

        def block(lang, tokens):
            words = pa.array(tokens, pa.binary()).dictionary_encode()
            names = words.dictionary
            ids = words.indices.to_numpy()
            stop = pc.index(names, pa.scalar(END, pa.binary())).as_py()
            if length == 1:
                n = np.bincount(ids, minlength=len(names))
                keep = np.flatnonzero(np.arange(len(n)) != stop)
                return {"lang": pa.array([lang] * len(keep)), "phrase": names.take(pa.array(keep)), "a": n[keep], "after": np.zeros(len(keep), np.int32), "before": np.zeros(len(keep), np.int32)}
            h = hashes(lang, names.to_pylist())
            ok = holds(maps["frequent"], h, bits)
            ok[stop] = False
            edge = holds(maps["edges"], h, bits) & ok
            sign = np.where(ok, (h >> np.uint64(49)).astype(np.int32) + 1, 0).astype(np.int32)
            n = len(ids) - length + 1
            if n < 1:
                return None
            at = lambda a, k, m=n: a[k : k + m]
            ok_at, edge_at = ok[ids], edge[ids]
            first, last = at(edge_at, 0), at(edge_at, length - 1)
            alive = reduce(np.logical_and, (at(ok_at, k) for k in range(length)), first | last)
            if maps["told"] is not None:
                old = (holds(maps["told"], h, bits) & ok)[ids]
                alive &= ~(at(old, 0) | at(old, length - 1))
            if maps["known"] is not None:
                part = holds(maps["known"], folded([at(h[ids], k, n + 1) for k in range(length - 1)]), bits)
                alive &= (part[:-1] | ~first) & (part[1:] | ~last)
            spots = np.flatnonzero(alive)
            if not len(spots):
                return None
            group = ids[spots].astype(np.int64)
            for k in range(1, length):
                group = np.unique(group * len(names) + ids[spots + k], return_inverse=True)[1].astype(np.int64)
            order = np.argsort(group, kind="stable")
            begins = np.flatnonzero(np.diff(group[order], prepend=-1))
            ends = np.append(begins[1:], len(order))
            spots = spots[order]

            def always(next_to):
                if length == longest:
                    return np.zeros(len(begins), np.int32)
                there = sign[ids[next_to]]  # a block begins and ends with END, so there is a token on both sides
                low = np.minimum.reduceat(there, begins)
                return np.where(low == np.maximum.reduceat(there, begins), low, 0)

            phrase = pc.binary_join_element_wise(*(names.take(pa.array(ids[spots[begins] + k])) for k in range(length)), pa.scalar(b" ", pa.binary()))
            return {"lang": pa.array([lang] * len(begins)), "phrase": phrase, "a": ends - begins, "after": always(spots + length), "before": always(spots - 1)}

        def step(batch):
            by_lang: dict = {}
            for lang, text in zip(*(batch.column(c).to_pylist() for c in ("lang", "text")), strict=True):
                by_lang.setdefault(lang, []).append(text)
            told = [block(lang, tokens) for lang, texts in by_lang.items() for tokens in blocks(texts, most) if tokens]
            return [{**t, "phrase": t["phrase"].cast(pa.string())} for t in told if t]

        return step

    found = map_arrow(docs, make, "lang string, phrase string, a long, after int, before int", rows=8192)
    return found.groupBy("lang", "phrase").agg(F.sum("a").alias("a"), *(F.when(F.min(c) == F.max(c), F.min(c)).otherwise(0).alias(c) for c in ("after", "before")))


def scored(phrases: DataFrame, length: int, counts: DataFrame, totals: DataFrame) -> DataFrame:
    """lang, phrase, a, l, r, n, score by the lowest-scoring cut; phrases of which a part wasn't counted go, as none of them can be among the best."""
    words = F.split("phrase", " ")
    part = lambda side, k: F.struct(F.lit(side).alias("side"), F.lit(k).alias("k"), F.array_join(F.slice(words, 1, k) if side == "l" else F.slice(words, k + 1, length), " ").alias("part"))
    cuts = phrases.select("lang", "phrase", "a", F.explode(F.array(*(part(s, k) for s in "lr" for k in range(1, length)))).alias("c")).select("lang", F.col("c.part").alias("part"), F.struct("phrase", "a", "c.side", "c.k").alias("of"))
    met = cuts.join(counts.select("lang", F.col("phrase").alias("part"), F.col("a").alias("f")), ["lang", "part"])
    f = lambda side, k: F.max(F.when((F.col("of.side") == side) & (F.col("of.k") == k), F.col("f")))
    whole = met.groupBy("lang", F.col("of.phrase").alias("phrase"), F.col("of.a").alias("a")).agg(F.count("*").alias("parts"), *(f(s, k).alias(f"{s}{k}") for s in "lr" for k in range(1, length)))
    whole = whole.where(F.col("parts") == 2 * (length - 1)).join(totals, "lang")
    above = (1000 * F.col("a")).cast("decimal(19,0)") * F.col("n").cast("decimal(19,0)")
    score = lambda k: F.call_function("div", above.cast("decimal(38,0)"), (F.col(f"l{k}").cast("decimal(19,0)") * F.col(f"r{k}").cast("decimal(19,0)")).cast("decimal(38,0)"))
    best = F.array_min(F.array(*(F.struct(score(k).alias("score"), F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r")) for k in range(1, length))))
    return whole.withColumn("best", best).select("lang", "phrase", "a", "best.l", "best.r", "n", "best.score")


def without_longer(phrases: DataFrame, made: DataFrame, length: int) -> DataFrame:
    """Those of the phrases that no phrase of `length` words, one more than theirs, has within at all their places."""
    words = F.split("phrase", " ")
    parts = F.array(F.array_join(F.slice(words, 1, length - 1), " "), F.array_join(F.slice(words, 2, length - 1), " "))
    return phrases.join(made.select("lang", "a", F.explode(parts).alias("phrase")), ["lang", "phrase", "a"], "left_anti").select(*phrases.columns)


def ranked(found: DataFrame, first: int) -> DataFrame:
    w = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return found.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= first)


def collocations(docs: DataFrame, least: int = 100, first: int = 2000, longest: int = 5, bits: int = 26, share: float = 0.25) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's `first` best phrases of 2 to `longest` words.

    A phrase that begins or ends with a word of count f scores at most
    1000 n / f, however it grows. So words are taken up by rising f: those
    with the least counts, up to `share` of a language's words, are paired
    first; the score of the `first`-th surviving pair then tells which further
    words can still matter, and these are paired next. Pairs grow a word at a
    time at both ends while the bound of their outer words reaches the score
    that is now the `first`-th; a phrase is counted only where its known part
    is frequent. Nothing that could reach that score, ties included, is left
    out. A phrase survives if the words after it and those before it have
    different hashes; if not it waits for the phrases of one word more, and
    goes if one of them that has it within is as frequent.

    Tasks count in arrays for about 8 MB of text at a time and Spark adds up
    what they tell. Which words and phrases matter goes to the tasks in
    bitmaps of 2^bits places, whose collisions only add phrases to count; at
    far more than 10^7 frequent phrases give more bits.

    Null text: empty. Null lang: `und`. Repeated rows and null doc_ids: each row
    counts. Ties: by count, then phrase in UTF-8 order. Empty table or no
    frequent phrase: no rows. Further columns are ignored. A text is held
    whole in its task.
    """
    docs = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("binary").alias("text")).where("text is not null")
    every = settle(counted(docs, 1).select("lang", "phrase", "a"))
    totals = settle(every.groupBy("lang").agg(F.sum("a").alias("n")))
    words = settle(every.where(F.col("a") >= least))
    frequent = bitmap(words, bits)

    size = F.floor(F.log2("a"))
    mass = words.groupBy("lang", size.alias("size")).agg(F.sum("a").alias("mass"))  # a row for each power of two
    mass = mass.withColumn("mass", F.sum("mass").over(Window.partitionBy("lang").orderBy("size"))).join(totals, "lang")
    cut = mass.where(F.col("mass") <= share * F.col("n")).groupBy("lang").agg(F.max("size").alias("cut"))
    edges = settle(words.join(cut, "lang").where(size <= F.col("cut")).select("lang", "phrase"))
    counts, best, waiting, told, known, length = words.select("lang", "phrase", "a"), None, None, None, None, 2
    while length <= longest:
        shared = bitmap(edges, bits)
        made = counted(docs, length, bits, frequent, shared, told, known, longest).where(F.col("a") >= least)
        made = settle(made.withColumn("sure", (F.col("after") == 0) & (F.col("before") == 0)).drop("after", "before"))
        ahead = settle(scored(made, length, counts, totals))
        sure = ahead.join(made.where("sure").select("lang", "phrase"), ["lang", "phrase"], "left_semi")
        unsure = ahead.join(made.where("not sure").select("lang", "phrase"), ["lang", "phrase"], "left_semi")
        if length > 2:
            sure, waiting = sure.unionByName(without_longer(waiting, made, length)), unsure
        else:
            waiting = unsure if waiting is None else waiting.unionByName(unsure)
        best = settle(ranked(sure if best is None else best.drop("rank").unionByName(sure), first))
        counts = counts.unionByName(made.select("lang", "phrase", "a"))
        reached = best.where(F.col("rank") == first).select("lang", F.col("score").alias("reached"))
        edges = words.join(totals, "lang").join(reached, "lang", "left").where(F.call_function("div", 1000 * F.col("n"), F.col("a")) >= F.coalesce("reached", F.lit(0)))
        edges = settle(edges.select("lang", "phrase"))
        if length == 2 and told is None:  # pairs of words that could not be ruled out before
            told, pairs = shared, made
            continue
        last = made.unionByName(pairs) if length == 2 else made
        if not last.limit(1).count():
            break
        known, told, length = bitmap(last, bits), None, length + 1
    return best.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
