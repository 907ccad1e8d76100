"""N-gram Jaccard join: size-banded tiles, hashed bitmap signatures, exact intersection."""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lawmesh.llm.common import components, give_back, kept, map_arrow, settle
from lawmesh.llm.lm import words_of

SHINGLE = 5
ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63)]
BLOCK_ROWS = 400_000
#: Tokens below it, 35 % of all, are looked at for telling which documents can have a partner.
ZONE = np.uint64(int(0.35 * 2**64))


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingle_set(text: str | None) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's five-word shingles; one of all words, if fewer."""
    words = words_of(text)
    if not words:
        return np.zeros(0, dtype="uint64")
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype="uint64", count=len(words))
    n = max(1, len(h) - SHINGLE + 1)
    if len(h) < SHINGLE:
        return mixed(np.array([(h * np.array(ODD[: len(h)])).sum() + np.uint64(len(h))], dtype="uint64"))
    made = h[:n] * ODD[0]
    for k in range(1, SHINGLE):
        made += h[k : k + n] * ODD[k]
        made ^= made >> np.uint64(29)
    return np.unique(mixed(made))


def class_id(s: np.ndarray) -> int:
    """Equal for equal sets; 64 bits, used together with the set's size."""
    return int((mixed(s + ODD[1]).sum(dtype="uint64") ^ np.uint64(len(s) * 0x9E3779B1)).astype("int64"))


def alike(a: np.ndarray, b: np.ndarray) -> bool:
    """100 * |intersection| >= 75 * |union| of two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    both = int((b[np.minimum(at, len(b) - 1)] == a).sum())
    return 100 * both >= 75 * (len(a) + len(b) - both)


def bitmap(s: np.ndarray) -> bytes:
    """A bit for each hash place, the parity of who is there; 4 places a member, 16 in small sets, to the next power of 2.

    The width never falls with the size, so that of two bitmaps the smaller
    set's is the one to fold the other to.
    """
    width = max(64, 1 << (max(4 * len(s), min(16 * len(s), 4096)) - 1).bit_length())
    bits = np.bincount((s & np.uint64(width - 1)).astype("int64"), minlength=width) & 1
    return np.packbits(bits.astype("uint8"), bitorder="little").tobytes()


def folded(bits: bytes, size: int) -> np.ndarray:
    """A bitmap at a smaller width: parities of joined places are the XOR of theirs."""
    b = np.frombuffer(bits, dtype="<u8")
    while len(b) > size:
        b = b[: len(b) // 2] ^ b[len(b) // 2 :]
    return b


def may_be_alike(n_a, n_b, different) -> np.ndarray:
    """Differing bits are at most the members in one set only, so overlap <= (n_a + n_b - different) / 2."""
    total = n_a + n_b
    return 7 * (total - different) >= 6 * total


def set_sizes(docs: DataFrame) -> DataFrame:
    """doc_id, n, z, cid: the size of each document's set, how many of it are in the zone, and its class; cid is null without a set."""

    def make():
        kept("shingles", dict)  # what earlier operators kept goes

        def step(batch):
            sets = [shingle_set(t) for t in batch.column(1).to_pylist()]
            return {
                "doc_id": batch.column(0),
                "n": [len(s) for s in sets],
                "z": [int(np.searchsorted(s, ZONE)) for s in sets],
                "cid": [class_id(s) if len(s) else None for s in sets],
            }

        return step

    return map_arrow(docs, make, "doc_id long, n long, z long, cid long")


def by_bucket(bucket: np.ndarray, columns: dict[str, np.ndarray], out: dict[str, list], **same) -> None:
    """Adds a row of packed arrays to out for each bucket."""
    order = np.argsort(bucket, kind="stable")
    for part in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1):
        if len(part):
            out["bucket"].append(int(bucket[part[0]]))
            for name, a in columns.items():
                out[name].append(a[part].tobytes())
            for name, x in same.items():
                out[name].append(x)


def zone_postings(docs: DataFrame, buckets: int) -> DataFrame:
    """bucket, tokens, cids, met, times: who has which token of the zone, as packed arrays dealt out by token.

    A block of documents tells each token once: with its class, or 0 where
    several of the block have it; those are told in met, with how many of
    their tokens that are (times). Tokens are cut to 32 bits within a bucket.
    """

    class Step:
        def __init__(self):
            self.held, self.rows = {}, 0

        def __call__(self, batch):
            for text in batch.column(0).to_pylist():
                s = shingle_set(text)
                if len(s) and (cid := class_id(s)) not in self.held:
                    self.held[cid] = s[: int(np.searchsorted(s, ZONE))].copy()
                    self.rows += len(self.held[cid])
            return self.finish() if self.rows >= BLOCK_ROWS else []

        def finish(self):
            out = {"bucket": [], "tokens": [], "cids": [], "met": [], "times": []}
            if self.rows:
                tokens = np.concatenate(list(self.held.values()))
                cids = np.repeat(np.array(list(self.held), dtype="int64"), [len(t) for t in self.held.values()])
                tokens, first, of, n = np.unique(tokens, return_index=True, return_inverse=True, return_counts=True)
                several = n > 1
                met, times = np.unique(cids[several[of]], return_counts=True)
                told, none = mixed(tokens), np.zeros(0)
                empty = {c: none.tobytes() for c in ("tokens", "cids", "met", "times")}
                by_bucket(
                    (told % np.uint64(buckets)).astype("int64"),
                    {"tokens": (told // np.uint64(buckets)).astype("uint32"), "cids": np.where(several, 0, cids[first])},
                    out, met=empty["met"], times=empty["times"],
                )
                by_bucket(
                    (mixed(met.view("uint64")) % np.uint64(buckets)).astype("int64"),
                    {"met": met, "times": times.astype("uint32")},
                    out, tokens=empty["tokens"], cids=empty["cids"],
                )
            self.held, self.rows = {}, 0
            return out

    return map_arrow(docs, Step, "bucket long, tokens binary, cids binary, met binary, times binary")


def packed(pdf: pd.DataFrame, column: str, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(pdf[column]), dtype=kind)


def shared_tokens(pdf: pd.DataFrame) -> pd.DataFrame:
    """cid, k: of each class how many of one bucket's tokens another class has too."""
    tokens, cids = packed(pdf, "tokens", "<u4"), packed(pdf, "cids", "<i8")
    order = np.argsort(tokens, kind="stable")
    tokens, cids = tokens[order], cids[order]
    same = tokens[1:] == tokens[:-1]
    several = np.concatenate(([False], same)) | np.concatenate((same, [False])) if len(tokens) else same
    found = cids[several & (cids != 0)]
    cids = np.concatenate((found, packed(pdf, "met", "<i8")))
    k = np.concatenate((np.ones(len(found), dtype="int64"), packed(pdf, "times", "<u4")))
    cids, at = np.unique(cids, return_inverse=True)
    made = pd.DataFrame({"cid": cids, "k": np.bincount(at, k, len(cids)).astype("int64")})
    give_back()
    return made


def only(df: DataFrame, ids: DataFrame, key: str, small: int) -> DataFrame:
    """df's rows with a key in ids, which are 8 bytes each and broadcast only up to `small` of them."""
    ids = settle(ids)
    return df.join(F.broadcast(ids) if ids.count() <= small else ids, key, "left_semi")


def sets_of(texts: DataFrame) -> DataFrame:
    """block, cid, n, data: the sorted sets of texts, one row a class; a block has about BLOCK_ROWS / 4 tokens of one task."""

    class Step:
        def __init__(self):
            self.met, self.block, self.rows = set(), TaskContext.get().partitionId() << 32, 0

        def __call__(self, batch):
            out = {"block": [], "cid": [], "n": [], "data": []}
            for text in batch.column(0).to_pylist():
                s = shingle_set(text)
                if not len(s) or (cid := class_id(s)) in self.met:
                    continue
                self.met.add(cid)
                if self.rows > BLOCK_ROWS // 4:
                    self.block, self.rows = self.block + 1, 0
                self.rows += len(s)
                for name, x in (("block", self.block), ("cid", cid), ("n", len(s)), ("data", s.tobytes())):
                    out[name].append(x)
            return out

    made = settle(map_arrow(texts, Step, "block long, cid long, n long, data binary", 256))
    if made.count() > made.select("cid").distinct().count():  # rows that repeat a doc_id, met by several tasks
        made = settle(made.dropDuplicates(["cid"]))
    return made


def block_tokens(sets: DataFrame, buckets: int) -> DataFrame:
    """bucket, block, tokens, counts: the tokens of each block, each of them once with its count."""

    def make():
        def step(batch):
            out = {"bucket": [], "block": [], "tokens": [], "counts": []}
            blocks, data = batch.column(0).to_numpy(), batch.column(1).to_pylist()
            for block in np.unique(blocks).tolist():
                tokens = np.frombuffer(b"".join(data[i] for i in np.flatnonzero(blocks == block)), dtype="<u8")
                tokens, counts = np.unique(tokens, return_counts=True)
                bucket = (mixed(tokens) % np.uint64(buckets)).astype("int64")
                by_bucket(bucket, {"tokens": tokens, "counts": counts.astype("uint32")}, out, block=block)
            return out

        return step

    return map_arrow(sets.select("block", "data"), make, "bucket long, block long, tokens binary, counts binary", 1024)


def document_counts(pdf: pd.DataFrame) -> pd.DataFrame:
    """block, tokens, counts: to each block those of one bucket's tokens that several sets have, with how many."""
    tokens, counts = packed(pdf, "tokens", "<u8"), packed(pdf, "counts", "<u4")
    blocks = np.repeat(pdf["block"].to_numpy(), [len(x) // 8 for x in pdf["tokens"]])
    order = np.argsort(tokens, kind="stable")
    tokens, counts, blocks = tokens[order], counts[order], blocks[order]
    starts = np.flatnonzero(np.concatenate(([True], tokens[1:] != tokens[:-1]))) if len(tokens) else np.zeros(0, dtype="int64")
    total = np.repeat(np.add.reduceat(counts.astype("int64"), starts) if len(starts) else starts, np.diff(np.append(starts, len(tokens))))
    several = total > 1
    out = {"bucket": [], "tokens": [], "counts": []}
    by_bucket(blocks[several], {"tokens": tokens[several], "counts": total[several].astype("<u4")}, out)
    give_back()
    return pd.DataFrame({"block": np.array(out["bucket"], dtype="int64"), "tokens": out["tokens"], "counts": out["counts"]})


def prefixes(pdf: pd.DataFrame) -> pd.DataFrame:
    """token, cid, n, short, df of one block's sets: the prefixes that are left when tokens come by how many sets have them.

    Tokens that no other set has come first; they fill places of the prefix
    but can't be met. Two sets as alike as asked for share a token of the
    smaller one's first n - ceil(6n/7) + 1 (short) and the larger one's first
    n - ceil(3n/4) + 1.
    """
    given, told = pdf[pdf["data"].notna()], pdf[pdf["data"].isna()]
    known, df = packed(told, "tokens", "<u8"), packed(told, "counts", "<u4")
    known, first = np.unique(known, return_index=True)
    df = df[first].astype("int64")
    made = []
    for cid, data in zip(given["cid"].tolist(), given["data"], strict=True):
        s = np.frombuffer(data, dtype="<u8")
        n = len(s)
        long, short = n - (3 * n + 3) // 4 + 1, n - (6 * n + 6) // 7 + 1
        at = np.searchsorted(known, s)
        met = np.flatnonzero(known[np.minimum(at, len(known) - 1)] == s) if len(known) else at[:0]
        alone = n - len(met)
        if alone >= long or not len(met):
            continue
        tokens, counts = s[met], df[at[met]]
        order = np.lexsort((tokens, counts))[: long - alone]
        made.append((tokens[order], np.full(len(order), cid), np.full(len(order), n), alone + np.arange(len(order)) < short, counts[order]))
    token, cid, n, short, df = (np.concatenate(x) for x in zip(*made, strict=True)) if made else (np.zeros(0, dtype="int64"),) * 5
    made = pd.DataFrame({"token": token.view("int64"), "cid": cid, "n": n, "short": short.astype(bool), "df": df})
    give_back()
    return made


def neighbours(pdf: pd.DataFrame) -> pd.DataFrame:
    """a, b: pairs of neighbours by size in each of a bucket's lists, and in some also by chance."""
    pdf = pdf.sort_values(["token", "piece", "n", "cid"], kind="stable")
    tokens, pieces, cids, n, short = (pdf[c].to_numpy() for c in ("token", "piece", "cid", "n", "short"))
    short = short.astype(bool)
    new = np.concatenate(([True], (tokens[1:] != tokens[:-1]) | (pieces[1:] != pieces[:-1])))
    number = np.cumsum(new)
    length = np.bincount(number)[number]
    i = np.flatnonzero(~new[1:])
    i = i[(4 * n[i] >= 3 * n[i + 1]) & short[i]]
    # in a fourth of the longer lists also neighbours in an order by chance, another one in each list
    chance = np.flatnonzero((length >= 8) & (mixed(tokens.view("uint64") ^ ODD[3]) % np.uint64(4) == 0))
    chance = chance[np.lexsort((mixed(cids[chance].view("uint64") ^ tokens[chance].view("uint64")), number[chance]))]
    x, y = np.minimum(chance[:-1], chance[1:]), np.maximum(chance[:-1], chance[1:])  # by size within a list
    fine = (number[x] == number[y]) & (4 * n[x] >= 3 * n[y]) & short[x]
    x, y = np.concatenate((i, x[fine])), np.concatenate((i + 1, y[fine]))
    pairs = np.unique(np.stack((np.minimum(cids[x], cids[y]), np.maximum(cids[x], cids[y])), 1), axis=0)
    return pd.DataFrame(pairs.astype("int64"), columns=["a", "b"])


def verified(pairs: DataFrame, sets: DataFrame, small: int) -> DataFrame:
    """The (a, b) pairs of classes whose sorted sets intersect as much as asked for."""

    def make():
        def step(batch):
            x, y = (batch.column(i).to_pylist() for i in (2, 3))
            at = np.flatnonzero([alike(np.frombuffer(s, dtype="<u8"), np.frombuffer(t, dtype="<u8")) for s, t in zip(x, y, strict=True)])
            return {"a": batch.column(0).to_numpy()[at], "b": batch.column(1).to_numpy()[at]}

        return step

    wanted = pairs.select(F.col("a").alias("cid")).unionAll(pairs.select("b")).distinct()
    sets = settle(only(sets.select("cid", "data"), wanted, "cid", small))
    for side in "ab":
        pairs = pairs.join(sets.select(F.col("cid").alias(side), F.col("data").alias(f"data_{side}")), side)
    return settle(map_arrow(pairs.select("a", "b", "data_a", "data_b"), make, "a long, b long"))


class Roots:
    """Which of a pack's classes are in one component by now."""

    def __init__(self, comps: np.ndarray):
        _, self.root = np.unique(comps, return_inverse=True)

    def join(self, x: int, y: int) -> None:
        self.root[self.root == self.root[y]] = self.root[x]


def tile_links(pdf: pd.DataFrame) -> pd.DataFrame:
    """Links that join components within the tiles of one pack, at most one for each of its classes but one.

    Each class comes with its set once. The bit counts of a tile's pairs of
    different components bound their overlaps from above; those let through
    are intersected one after the other, unless a link found meanwhile has
    put both into one component.
    """
    given, rows = pdf[pdf["data"].notna()], pdf[pdf["data"].isna()]
    cids, first = np.unique(given["cid"].to_numpy(), return_index=True)
    sets = [np.frombuffer(d, dtype="<u8") for d in given["data"].to_numpy()[first]]
    place = np.searchsorted(cids, rows["cid"].to_numpy())
    comp_of = np.zeros(len(cids), dtype="int64")
    comp_of[place] = rows["comp"].to_numpy()
    roots, bits, out = Roots(comp_of), {}, []

    def matrix(at: np.ndarray, size: int) -> np.ndarray:
        for k in at.tolist():
            if k not in bits:
                bits[k] = bitmap(sets[k])
        return np.stack([folded(bits[k], size) for k in at.tolist()])

    rows = rows.assign(place=place).sort_values(["list", "tile", "n", "cid"], kind="stable")
    numbers = rows.groupby(["list", "tile"], sort=False).ngroup().to_numpy()
    columns = [rows[c].to_numpy() for c in ("place", "n", "short", "left", "right")]
    for part in np.split(np.arange(len(rows)), np.flatnonzero(np.diff(numbers)) + 1):
        at, n, short, left, right = (c[part] for c in columns)
        short, left, right = short.astype(bool), left.astype(bool), right.astype(bool)
        if not len(at) or (roots.root[at] == roots.root[at[0]]).all():
            continue
        i, held = 0, (0, 0, 0, None)
        while i < len(at):
            some = slice(i, min(len(at), i + 64))
            end = int(np.searchsorted(n, n[some][-1] * 4 // 3, "right"))  # partners are from here on, and not too large
            mine = roots.root[at[i:end]]
            wanted = (
                (4 * n[some][:, None] >= 3 * n[None, i:end])
                & short[some][:, None]
                & (mine[: some.stop - i][:, None] != mine[None, :])
                & (np.arange(i, some.stop)[:, None] < np.arange(i, end)[None, :])
                & (left[some][:, None] & right[None, i:end] | right[some][:, None] & left[None, i:end])
            )
            x, y = np.nonzero(wanted)
            if len(x):
                if at[i] not in bits:
                    bits[int(at[i])] = bitmap(sets[at[i]])
                size = len(bits[int(at[i])]) // 8
                if held[0] != size or held[2] < end:
                    held = (size, i, end, matrix(at[i:end], size))
                m = held[3][i - held[1] :]
                for k in range(0, len(x), 4096):
                    p, q = x[k : k + 4096], y[k : k + 4096]
                    different = np.bitwise_count(m[p] ^ m[q]).sum(1, dtype="int64")
                    fine = may_be_alike(n[i + p], n[i + q], different)
                    for a, b in zip(at[i + p[fine]].tolist(), at[i + q[fine]].tolist(), strict=True):
                        if roots.root[a] != roots.root[b] and alike(sets[a], sets[b]):
                            roots.join(a, b)
                            out.append((min(cids[a], cids[b]), max(cids[a], cids[b])))
            i = some.stop
    made = pd.DataFrame(np.array(out, dtype="int64").reshape(-1, 2), columns=["a", "b"])
    del sets, given, rows, bits
    give_back()
    return made


def tiles(members: DataFrame, tile_rows: int, tile_tokens: int) -> DataFrame:
    """Members of lists (m: how many the list has, weight: their tokens) -> rows of tiles: list, tile, left, right beside what they have.

    A list of at most tile_rows members and tile_tokens tokens is one tile. A longer one is cut into
    bands of sizes, each reaching from s to 4s/3, so that partners are in the
    same or the next band; a band is dealt into slices of half of that,
    and each two slices of a band and its next meet in a tile, with the one's
    members on the left and the other's on the right.
    """
    band = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(4.0 / 3.0))).cast("int")
    fits = (F.col("m") <= tile_rows) & (F.col("weight") <= tile_tokens)
    banded = members.withColumn("band", F.when(fits, 0).otherwise(band))
    short = banded.where(fits).select(
        *members.columns, F.lit(0).cast("long").alias("tile"), F.lit(True).alias("left"), F.lit(True).alias("right")
    )
    long = banded.where(~fits)
    needed = F.greatest(F.count("*") / F.lit(tile_rows // 2), F.sum("n") / F.lit(tile_tokens // 2))
    slices = long.groupBy("list", "band").agg(F.ceil(needed).cast("int").alias("k"))
    near = slices.select("list", (F.col("band") - 1).alias("band"), F.col("k").alias("above")).unionByName(
        slices.select("list", (F.col("band") + 1).alias("band"), F.lit(None).cast("int").alias("above"), F.col("k").alias("below")),
        allowMissingColumns=True,
    )
    near = near.groupBy("list", "band").agg(F.max("above").alias("above"), F.max("below").alias("below"))
    slices = slices.join(near, ["list", "band"], "left")
    long = long.join(slices, ["list", "band"]).withColumn("own", F.pmod(F.xxhash64("cid"), F.col("k")).cast("int"))
    name = "xxhash64({}, {}, {}, {})"
    goes = [
        # slices of the own band: with each later one on the left, with each earlier one on the right
        f"transform(sequence(0, k - 1), s -> named_struct('tile', {name.format('band', 'least(s, own)', 'band', 'greatest(s, own)')}, 'left', own <= s, 'right', own >= s))",
        f"if(above is null, array(), transform(sequence(0, above - 1), s -> named_struct('tile', {name.format('band', 'own', 'band + 1', 's')}, 'left', true, 'right', false)))",
        f"if(below is null, array(), transform(sequence(0, below - 1), s -> named_struct('tile', {name.format('band - 1', 's', 'band', 'own')}, 'left', false, 'right', true)))",
    ]
    long = long.select(*members.columns, F.explode(F.expr(f"concat({', '.join(goes)})")).alias("t"))
    return short.unionByName(long.select(*members.columns, "t.tile", "t.left", "t.right"))


def jaccard_components(
    docs: DataFrame, bucket_rows: int = 500_000, tile_rows: int = 16_384, tile_tokens: int = 4_000_000, piece_rows: int = 4096, small: int = 2_000_000
) -> DataFrame:
    """doc_id, n_shingles, component_id: documents linked by Jaccard >= 0.75 of their five-word shingle sets.

    1. Equal sets are one class (by 64 bits and the size); only classes go on.
    2. A set can't have a partner if more than a fourth of its tokens is in no
       other set. That is told from the tokens of a zone, 35 % of all: whoever
       has enough of them alone is done.
    3. The sets of the others are kept, in blocks. Their tokens are counted,
       and the counts go back to the blocks, where each set's tokens come in
       order of their counts; the prefixes in this order make lists of who
       shares a token. Few sets are in a list for common passages only.
    4. Neighbours in a list are verified: a large group of near copies becomes
       one component here, with comparisons in proportion to its lists.
    5. Lists whose members are in different components are compared wholly, in
       size-banded tiles: bit counts of the sets' bitmaps bound the overlap
       from above, then the sorted sets are intersected. A tile tells links
       that join components, never its pairs.
    Pairs within a component are not compared again: no component depends on
    them. Nothing is dropped: each pair that is alike shares a list.

    No token's documents are gathered: blocks tell each token once, long lists
    are dealt in pieces (4) and slices (5).

    Null or empty text: no set, n_shingles 0, its own component. Null doc_id:
    the component of the documents with its set, null if there are none.
    Repeated rows: one row each. Empty input: no rows. Sets of hashes differ
    from sets of shingles only where two 64-bit hashes collide.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sized = settle(set_sizes(rows))
    classes = settle(sized.where("n > 0").groupBy("cid", "n", "z").agg(F.min("doc_id").alias("rep")))
    total = classes.agg(F.coalesce(F.sum("z"), F.lit(0))).first()[0]
    buckets = max(64, -(-total // bucket_rows))
    shared = zone_postings(rows.select("text"), buckets).groupBy("bucket").applyInPandas(shared_tokens, "cid long, k long").groupBy("cid").agg(F.sum("k").alias("k"))
    left = classes.where("rep is not null").join(shared, "cid", "left").where(4 * (F.col("z") - F.coalesce("k", F.lit(0))) <= F.col("n"))
    sets = sets_of(only(rows, left.select(F.col("rep").alias("doc_id")), "doc_id", small).select("text"))
    total = sets.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    buckets = max(64, -(-total // bucket_rows))
    told = block_tokens(sets, buckets).groupBy("bucket").applyInPandas(document_counts, "block long, tokens binary, counts binary")
    none = F.lit(0).cast("long")  # no null longs: pandas makes them doubles
    postings = settle(
        sets.select("block", "cid", "data")
        .unionByName(told.withColumn("cid", none), allowMissingColumns=True)
        .groupBy("block")
        .applyInPandas(prefixes, "token long, cid long, n long, short boolean, df long")
    )
    count = postings.count()
    piece = F.pmod(F.xxhash64("cid"), F.ceil(F.col("df") / piece_rows))
    dealt = postings.withColumn("piece", piece).withColumn("bucket", F.pmod(F.xxhash64("token", "piece"), F.lit(max(64, 4 * count // bucket_rows))))
    pairs = settle(dealt.groupBy("bucket").applyInPandas(neighbours, "a long, b long").distinct())
    links = verified(pairs, sets, small)
    comps = components(links).withColumnRenamed("node", "cid").withColumnRenamed("component", "comp")
    placed = settle(postings.drop("df").join(comps, "cid", "left").withColumn("comp", F.coalesce("comp", "cid")).withColumnRenamed("token", "list"))
    lists = placed.groupBy("list").agg(
        F.count("*").alias("m"), F.min("comp").alias("low"), F.max("comp").alias("high"), F.min("cid").alias("first"), F.sum("n").alias("weight"),
        F.bit_xor(F.xxhash64("cid", "short")).alias("mark"),
    )
    chosen = lists.where("m >= 3 and low <> high").groupBy("mark", "m", "first", "weight").agg(F.min("list").alias("list"))  # the same members: once
    chosen = settle(chosen.drop("mark"))
    # lists with the same first member have most members in common: they go together, with one set for each member, in parts if they have many rows
    parts = chosen.groupBy("first").agg(F.ceil(F.sum("m") / tile_rows).alias("parts"))
    chosen = chosen.join(parts, "first").withColumn("part", F.pmod(F.xxhash64("list"), F.col("parts"))).drop("parts")
    tiled = tiles(placed.join(chosen, "list"), tile_rows, tile_tokens)
    key = F.when(F.col("tile") == 0, F.xxhash64("first", "part")).otherwise(F.xxhash64("list", "tile"))
    light = settle(tiled.withColumn("key", key).drop("first", "part", "m", "weight"))
    total = light.select("key", "cid", "n").distinct().agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    packs = max(64, light.count() // 20_000, 4 * total // tile_tokens)
    light = light.withColumn("pack", F.pmod("key", F.lit(packs))).drop("key")
    given = light.select("pack", "cid").distinct().join(only(sets.select("cid", "data"), light.select("cid").distinct(), "cid", small), "cid")
    for c in ("list", "n", "comp", "tile"):
        given = given.withColumn(c, none)
    more = settle(light.unionByName(given, allowMissingColumns=True).groupBy("pack").applyInPandas(tile_links, "a long, b long"))
    links = links.unionAll(more)
    of = classes.select("cid", "n", "rep")
    by_doc = links.join(of.select(F.col("cid").alias("a"), F.col("rep").alias("rep_a")), "a").join(
        of.select(F.col("cid").alias("b"), F.col("rep").alias("rep_b")), "b"
    )
    comps = components(by_doc.select(F.col("rep_a").alias("a"), F.col("rep_b").alias("b")))
    homes = of.join(comps.withColumnRenamed("node", "rep"), "rep", "left").select(
        "cid", "n", F.coalesce("component", "rep").alias("component_id")
    )
    return sized.join(homes, ["cid", "n"], "left").select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
    )
