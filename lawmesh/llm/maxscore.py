"""Exact top-k inner-product search by MaxScore over quantised vectors."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lawmesh.llm.common import broadcast_value, map_arrow, settle

EXACT = float(1 << 53)


def quantised(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """key, q: floor(256 * x) of each component, x as double; null or non-finite vectors go."""
    v = F.transform(F.col(vector), lambda x: x.cast("double"))
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vectors.where(F.col(vector).isNotNull() & F.col(key).isNotNull() & fine).select(
        F.col(key).cast("long").alias("vec_id"), F.transform(v, lambda x: F.floor(x * 256).cast("long")).alias("q")
    )


class Shard:
    """The postings of one block of candidates: for each dimension its weight in every row, and its bounds.

    A dimension's bound is the most that any of its postings adds to a query.
    The dimensions with the smallest bounds, as many as together stay below
    the query's k-th best score, are not essential: the others are traversed
    for all rows, these are probed step by step and only for the rows that can
    still reach that score.
    """

    def __init__(self, ids: np.ndarray, rows: np.ndarray, steps: int = 4):
        self.ids, self.postings, self.steps = ids, np.ascontiguousarray(rows.T), steps
        self.high, self.low = rows.max(0), rows.min(0)

    def top(self, query_id: int, query: np.ndarray, k: int, least: float):
        """(vec_id, score) of the rows that can be among the query's k best."""
        bounds = np.maximum(query * self.high, query * self.low)
        order = np.argsort(-bounds, kind="stable")
        after = np.concatenate((np.cumsum(bounds[order][::-1])[::-1], [0]))  # what dimensions from here on add at most
        n_essential = max(1, int(np.argmax(after < least))) if (after < least).any() else len(order)
        done, alive = order[:n_essential], None
        score = query[done] @ self.postings[done]
        at = n_essential
        for some in [None, *np.array_split(order[n_essential:], self.steps)]:
            if some is not None and len(some):
                score = score + query[some] @ self.postings[np.ix_(some, alive)]
                at += len(some)
            keep = np.flatnonzero(score + after[at] >= least)
            alive, score = keep if alive is None else alive[keep], score[keep]
            if not len(alive):
                break
        own = self.ids[alive] != query_id
        ids, score = self.ids[alive][own], score[own]
        best = np.lexsort((ids, -score))[:k]
        return ids[best].tolist(), score[best].tolist()


def top_k(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = 5,
    vector: str = "embedding",
    key: str = "vec_id",
    query_block: int = 65_536,
    shard_rows: int = 4096,
) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k best other rows, ties to the smaller vec_id.

    Both sides are quantised first. Queries go round in blocks of about
    query_block (the bound on what is broadcast: 33 MB at 64 components); for
    each block the candidates are read once, every task searches its shards,
    carrying each query's k-th best score from shard to shard, and a window by
    query merges what the tasks found. With several blocks each one's result
    is written before the next begins, so plans stay as small as one block's. Only vectors of the query's length are compared. Null
    ids, null vectors and those with null or non-finite components take no
    part; a repeated vec_id other than the query's own is as many candidates.
    No queries or no candidates: no rows.
    """
    spark = vectors.sparkSession
    base = quantised(vectors, key, vector)
    asked = settle(quantised(queries, key, vector))
    blocks = max(1, -(-asked.count() // query_block))
    found = None
    for b in range(blocks):
        part = asked if blocks == 1 else asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b)
        got = part.distinct().toArrow()  # a block
        ids, values = got["vec_id"].to_numpy(), got["q"].combine_chunks()
        sizes = np.diff(values.offsets.to_numpy())
        flat, starts = values.flatten().to_numpy(zero_copy_only=False), values.offsets.to_numpy()[:-1] - values.offsets[0].as_py()
        held = {}
        for n in np.unique(sizes[sizes > 0]).tolist():
            pick = np.flatnonzero(sizes == n)
            held[n] = ids[pick], flat[starts[pick][:, None] + np.arange(n)].astype("float64")
        shipped = broadcast_value(vectors, held)

        def make(shipped=shipped):
            held = shipped.value
            largest = {n: np.abs(q).max() for n, (_, q) in held.items()}
            best = {n: np.full((len(ids), k), -np.inf) for n, (ids, _) in held.items()}

            def step(batch):
                out = []
                ids, values = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)
                sizes = np.diff(values.offsets.to_numpy())
                flat = values.flatten().to_numpy(zero_copy_only=False)
                starts = np.concatenate(([0], np.cumsum(sizes)))[:-1]
                for n in set(sizes.tolist()) & held.keys():
                    pick = np.flatnonzero(sizes == n)
                    data = flat[starts[pick][:, None] + np.arange(n)]
                    query_ids, queries = held[n]
                    if np.abs(data).max() * largest[n] * n < EXACT:  # doubles hold every sum
                        data, q = data.astype("float64"), queries
                    else:
                        q = queries.astype("int64")
                    shard = Shard(ids[pick], data)
                    for i, query_id in enumerate(query_ids.tolist()):
                        found_ids, scores = shard.top(query_id, q[i], k, best[n][i, -1])
                        if scores:
                            best[n][i] = -np.sort(-np.concatenate((best[n][i], scores)))[:k]
                            out += [(query_id, v, int(x)) for v, x in zip(found_ids, scores, strict=True)]
                columns = list(zip(*out, strict=True)) if out else [[], [], []]
                return dict(zip(("query_id", "vec_id", "score"), columns, strict=True))

            return step

        one = map_arrow(base, make, "query_id long, vec_id long, score long", shard_rows)
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        best = (
            one.withColumn("rank", F.row_number().over(order).cast("int"))
            .where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score")
        )
        if blocks == 1:
            return best
        best = settle(best)
        shipped.unpersist()
        found = best if found is None else found.unionAll(best)
    return found
