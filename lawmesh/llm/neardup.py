"""Near-duplicate embeddings by an inverted multi-index."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lawmesh.llm.common import broadcast_value, components, map_arrow, settle


def rows_of(column) -> np.ndarray:
    """An Arrow column of equally long lists as a matrix of doubles."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype("float64")
    return flat.reshape(len(column), -1)


def unit(v: np.ndarray) -> np.ndarray:
    """Rows at length 1; scaled first so that very large and very small ones keep their precision."""
    v = v / np.abs(v).max(1, keepdims=True)
    return v / np.sqrt((v * v).sum(1, keepdims=True))


def kmeans(points: np.ndarray, k: int, seed: int, rounds: int = 12) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centres = points[rng.choice(len(points), min(k, len(points)), replace=False)]
    for _ in range(rounds):
        near = (-2 * points @ centres.T + (centres * centres).sum(1)).argmin(1)
        counts = np.bincount(near, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, near, points)
        centres = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centres)
    return centres


class MultiIndex:
    """Independent codebooks on the two halves of unit vectors; a cell is a pair of codewords."""

    def __init__(self, first: np.ndarray, second: np.ndarray):
        self.first, self.second = first, second

    def distances(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Squared distances to both codebooks, summed in the same order whatever the batch."""
        half = v.shape[1] // 2
        out = []
        for part, book in ((v[:, :half], self.first), (v[:, half:], self.second)):
            d = np.empty((len(v), len(book)))
            for j, c in enumerate(book):
                d[:, j] = ((part - c) ** 2).sum(1)
            out.append(d)
        return out[0], out[1]

    def nearest(self, d1: np.ndarray, d2: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Multi-sequence traversal: the n cells with the smallest distances, nearest first, and these.

        A cell at places i and j of the two sorted sequences comes after
        (i + 1)(j + 1) - 1 others, so only those with (i + 1)(j + 1) <= n matter.
        """
        o1, o2 = np.argsort(d1, 1, kind="stable"), np.argsort(d2, 1, kind="stable")
        places = [(i, j) for i in range(min(n, o1.shape[1])) for j in range(min(n // (i + 1), o2.shape[1]))]
        i, j = np.array(places).T
        c1, c2 = o1[:, i], o2[:, j]
        rows = np.arange(len(d1))[:, None]
        sums, cells = d1[rows, c1] + d2[rows, c2], c1 * len(self.second) + c2
        order = np.lexsort((cells, sums), axis=1)[:, :n]
        return np.take_along_axis(cells, order, 1), np.take_along_axis(sums, order, 1)


def build_index(classes: DataFrame, per_cell: int, sample: int, seed: int) -> MultiIndex:
    """Codebooks with cells for about per_cell vectors of a label, up to 2048 words each.

    They are fitted on at most about `sample` vectors, 48 for each word if that is more.
    """
    n, labels = classes.agg(F.count("*"), F.count_distinct("label")).first()
    k = int(np.clip(np.sqrt(n / max(1, labels) / per_cell), 2, 2048))
    sample = max(sample, 48 * k)
    picked = classes.where(F.pmod(F.xxhash64(F.lit(seed), "rep"), F.lit(n)) < sample).select("vec").collect()
    v = unit(np.array([r["vec"] for r in picked], dtype="float64"))
    half = v.shape[1] // 2
    return MultiIndex(kmeans(v[:, :half], k, seed), kmeans(v[:, half:], k, seed + 1))


def cells_needed(index: MultiIndex, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """For each pair, how many cells the better of its two sides visits up to the other's own cell."""
    dx, dy = index.distances(x), index.distances(y)

    def before(d, of):
        at = np.arange(len(x))
        own = d[0][at, of[0].argmin(1)] + d[1][at, of[1].argmin(1)]
        second = np.sort(d[1], 1)
        return np.array([np.searchsorted(s, o - f, "left").sum() for s, o, f in zip(second, own, d[0], strict=True)])

    return np.minimum(before(dx, dy), before(dy, dx)) + 1 if len(x) else np.zeros(0, dtype="int64")


def cells_for_recall(classes: DataFrame, index: MultiIndex, least: float, recall: float, queries: int, seed: int) -> int:
    """How many cells a vector must visit for the wanted share of the links.

    At most about `queries` vectors are held against all others by brute force,
    and the tasks tell how many cells their links need, as a histogram. As
    links may be rare, the same number is also taken for made-up partners of
    these vectors, in random directions with the least cosine that counts; the
    larger one holds.
    """
    n = classes.count()
    picked = classes.where(F.pmod(F.xxhash64(F.lit(seed + 7), "rep"), F.lit(n)) < queries).collect()
    if not picked:
        return 1
    q = unit(np.array([r["vec"] for r in picked], dtype="float64"))
    shipped = broadcast_value(classes, (q, np.array([r["rep"] for r in picked]), np.array([r["label"] for r in picked]), index))

    def make():
        q, reps, labels, index = shipped.value

        def step(batch):
            v = unit(rows_of(batch.column(2)))
            near = (v @ q.T >= least) & (batch.column(1).to_numpy()[:, None] == labels) & (batch.column(0).to_numpy()[:, None] != reps)
            a, b = np.nonzero(near)
            some = slice(None, None, 1 + len(a) // 2000)
            r, n = np.unique(cells_needed(index, v[a[some]], q[b[some]]), return_counts=True)
            return {"need": r, "n": n}

        return step

    made = map_arrow(classes.select("rep", "label", "vec"), make, "need long, n long").groupBy("need").agg(F.sum("n").alias("n"))
    counts = sorted((r["need"], r["n"]) for r in made.collect())
    total, seen, need = sum(n for _, n in counts), 0, 1
    for cells, n in counts:
        seen += n
        if seen >= recall * total:
            need = cells
            break
    aside = np.random.default_rng(seed).standard_normal(q.shape)
    aside -= (aside * q).sum(1, keepdims=True) * q
    aside /= np.maximum(np.sqrt((aside * aside).sum(1, keepdims=True)), 1e-300)
    made_up = np.sort(cells_needed(index, q, least * q + np.sqrt(1 - least * least) * aside))
    return int(max(need, made_up[min(len(made_up) - 1, int(recall * len(made_up)))]))


def packed(v: np.ndarray) -> list[bytes]:
    """Each row as single floats if that loses nothing, else as doubles."""
    with np.errstate(over="ignore"):
        single = v.astype("<f4")
    exact = (single == v).all(1).tolist()
    return [(single[k] if fine else v[k]).tobytes() for k, fine in enumerate(exact)]


def unpacked(rows, dims: int) -> np.ndarray:
    kind = lambda x: "<f4" if len(x) == 4 * dims else "<f8"
    return np.stack([np.frombuffer(x, dtype=kind(x)).astype("float64") for x in rows])


def compare(least: float, index: MultiIndex):
    """One cell (and slice of its members): who of its visitors links with whom of its members."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        members, visitors = pdf[pdf.role == 0], pdf[pdf.role == 1]
        out = {"node": [], "links": [], "to": []}
        if len(members) and len(visitors):
            m, v = (unit(unpacked(part.vec, index.first.shape[1] + index.second.shape[1])) for part in (members, visitors))
            m_rep, v_rep = members.rep.to_numpy(), visitors.rep.to_numpy()
            m_n, v_n = members.n.to_numpy(), visitors.n.to_numpy()
            m1, m2 = index.distances(m)
            width = len(index.second)
            v_cell, m_edge, m_last = visitors.own.to_numpy(), members.edge.to_numpy(), members.final.to_numpy()
            reps, places = np.unique(np.concatenate((m_rep, v_rep)), return_inverse=True)
            links, root = np.zeros(len(reps), dtype="int64"), np.arange(len(reps))
            m_at, v_at = places[: len(m)], places[len(m) :]
            for at in range(0, len(v), 1024):
                some = slice(at, at + 1024)
                a, b = np.nonzero((v[some] @ m.T >= least) & (v_rep[some][:, None] != m_rep))
                if not len(a):
                    continue
                a = a + at
                np.add.at(links, v_at[a], m_n[b])
                # the member's own visit counts the link for it, if it comes to the visitor's cell
                sums = m1[b, v_cell[a] // width] + m2[b, v_cell[a] % width]
                alone = (sums > m_edge[b]) | ((sums == m_edge[b]) & (v_cell[a] > m_last[b]))
                np.add.at(links, m_at[b[alone]], v_n[a[alone]])
                while True:  # smallest place reachable through these links
                    low = np.minimum(root[v_at[a]], root[m_at[b]])
                    was = root.copy()
                    np.minimum.at(root, v_at[a], low)
                    np.minimum.at(root, m_at[b], low)
                    np.minimum.at(root, was[v_at[a]], low)
                    np.minimum.at(root, was[m_at[b]], low)
                    root = root[root]
                    if (root == was).all():
                        break
            some = np.flatnonzero((links > 0) | (root != np.arange(len(reps))))
            out = {"node": reps[some], "links": links[some], "to": reps[root[some]]}
        return pd.DataFrame(out).astype("int64")

    return run


def near_duplicates(
    vectors: DataFrame,
    least: float = 0.93,
    recall: float = 0.97,
    vector: str = "embedding",
    key: str = "vec_id",
    label: str = "label",
    per_cell: int = 16,
    sample: int = 20_000,
    queries: int = 500,
    slice_rows: int = 2048,
    seed: int = 3,
) -> DataFrame:
    """vec_id, n_links, component_id, kept: links are pairs of equal labels with cosine >= least.

    Equal vectors of a label form one class with a count, before anything
    else, so copies are never compared. Each class goes into one cell of the
    product grid and visits the cells nearest to it by multi-sequence
    traversal, as many as give the wanted recall on a bounded sample of
    queries held against all rows. What meets in a cell is verified in double
    precision. A cell tells one row for each of its vectors, the number of its
    links and one link towards its component, not the pairs; a cell with
    more than slice_rows members, or four times as many visitors, is sliced by
    both, and each slice of members meets each slice of visitors.

    Vectors that are null, zero, or hold null or non-finite components, and
    those without a label: no links, their own component. A null vec_id: no
    links, component null, kept false. A repeated vec_id counts as one more vector.
    Vectors of different lengths never link. Empty input: no rows.
    """
    v = F.transform(F.col(vector), lambda x: x.cast("double") + F.lit(0.0))
    fine = (
        F.col(vector).isNotNull()
        & F.col(label).isNotNull()
        & F.col(key).isNotNull()
        & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
        & F.exists(v, lambda x: x != 0)
    )
    rows = vectors.select(
        F.col(key).cast("long").alias("vec_id"),
        F.when(fine, F.xxhash64(F.lit(label), label, v)).alias("h1"),
        F.when(fine, F.xxhash64(F.lit(seed), v, label)).alias("h2"),
        F.xxhash64(label).alias("label"),
        v.alias("vec"),
    )
    classes = settle(
        rows.where("h1 is not null")
        .groupBy("h1", "h2")
        .agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"), F.first("label").alias("label"), F.first("vec").alias("vec"))
    )
    told = None
    for size in sorted(r[0] for r in classes.select(F.size("vec")).distinct().collect()):
        part = classes.where(F.size("vec") == size)
        one = told_by_cells(part, least, recall, per_cell, sample, queries, slice_rows, seed)
        told = one if told is None else told.unionAll(one)
    if told is None:
        told = vectors.sparkSession.createDataFrame([], "node long, links long, to long")
    told = settle(told)
    links = told.groupBy("node").agg(F.sum("links").alias("links"))
    comps = components(told.select(F.col("node").alias("a"), F.col("to").alias("b")))
    known = (
        classes.select("h1", "h2", "rep", "n")
        .join(links.withColumnRenamed("node", "rep"), "rep", "left")
        .join(comps.withColumnRenamed("node", "rep"), "rep", "left")
        .select("h1", "h2", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    )
    return (
        rows.select("vec_id", "h1", "h2")
        .join(known, ["h1", "h2"], "left")
        .select(
            "vec_id",
            F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
            F.coalesce("component_id", "vec_id").alias("component_id"),
        )
        .withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
    )


def told_by_cells(classes, least, recall, per_cell, sample, queries, slice_rows, seed) -> DataFrame:
    index = build_index(classes, per_cell, sample, seed)
    visits = cells_for_recall(classes, index, least, recall, queries, seed)
    shipped = broadcast_value(classes, index)

    def make():
        index = shipped.value

        def step(batch):
            rep, n, label = (batch.column(i).to_numpy() for i in range(3))
            v = rows_of(batch.column(3))
            d1, d2 = index.distances(unit(v))
            cells, sums = index.nearest(d1, d2, visits)
            return {"rep": rep, "n": n, "label": label, "cells": list(cells), "edge": sums[:, -1], "vec": packed(v)}

        return step

    coded = settle(map_arrow(classes.select("rep", "n", "label", "vec"), make, "rep long, n long, label long, cells array<long>, edge double, vec binary"))
    goes = F.expr("explode(concat(array(named_struct('cell', cells[0], 'role', 0)), transform(cells, c -> named_struct('cell', c, 'role', 1)))) as goes")
    role = F.col("role")
    met = coded.select("rep", "n", "label", F.expr("cells[0]").alias("own"), "edge", F.element_at("cells", -1).alias("final"), "vec", goes).select("*", "goes.*").drop("goes")
    crowded = coded.select("label", goes).groupBy("label", "goes.cell").agg(F.sum(1 - F.col("goes.role")).alias("members"), F.sum("goes.role").alias("visitors"))
    slices = lambda c, rows: F.greatest(F.lit(1), F.ceil(F.col(c) / rows)).cast("int").alias(c)
    crowded = settle(
        crowded.where((F.col("members") > slice_rows) | (F.col("visitors") > 4 * slice_rows)).select(
            "label", "cell", slices("members", slice_rows), slices("visitors", 4 * slice_rows)
        )
    )
    met = met.join(crowded, ["label", "cell"], "left").fillna(1, ["members", "visitors"])
    one = lambda c, salt: F.array(F.pmod(F.xxhash64(F.lit(salt), "rep"), F.col(c)).cast("int"))
    each = lambda c: F.sequence(F.lit(0), F.col(c) - 1)
    met = met.withColumn("slice", F.explode(F.when(role == 0, one("members", 1)).otherwise(each("members"))))
    met = met.withColumn("visit", F.explode(F.when(role == 1, one("visitors", 2)).otherwise(each("visitors"))))
    at = shipped

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return compare(least, at.value)(pdf)

    return met.groupBy("label", "cell", "slice", "visit").applyInPandas(run, "node long, links long, to long")
