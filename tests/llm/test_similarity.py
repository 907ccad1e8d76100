import random

import numpy as np

from lawmesh.llm import jaccard, neardup
from lawmesh.llm.common import components
from lawmesh.llm.maxscore import top_k
from tests.llm.helpers import docs, no_docs, odd_texts


def grouped(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components(spark):
    r = random.Random(4)
    links = [(r.randint(0, 300), r.randint(0, 300)) for _ in range(150)] + [(i, i + 1) for i in range(1000, 1200)] + [(2000, x) for x in range(2001, 2300)]
    nodes = {n for ab in links if ab[0] != ab[1] for n in ab}
    got = {x.node: x.component for x in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == grouped(nodes, [x for x in links if x[0] != x[1]])
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def shingles(text):
    w = (text or "").encode().lower().split()
    return frozenset([tuple(w)] if 0 < len(w) < 5 else [tuple(w[k : k + 5]) for k in range(len(w) - 4)])


def test_jaccard_against_all_pairs(spark):
    r = random.Random(9)
    word = lambda: "".join(r.choice("abcdef") for _ in range(r.randint(1, 4)))
    rows, passage = [*odd_texts()], [word() for _ in range(60)]
    for k in range(12):
        base = [word() for _ in range(r.randint(3, 90))]
        for j in range(9):
            w = list(base)
            for _ in range(r.randint(0, 3)):
                w[r.randrange(len(w))] = word()
            rows.append((100 + 10 * k + j, " ".join(w + passage * (j % 4 == 0))))
    rows += [(400 + i, " ".join(passage[: 20 + i])) for i in range(40)]  # a chain
    got = jaccard.jaccard_components(docs(spark, rows), tile_rows=6).collect()
    assert len(got) == len(rows)
    sets = {i: shingles(t) for i, t in rows if i is not None}
    alike = lambda a, b: bool(a) and 100 * len(a & b) >= 75 * len(a | b)
    ids = sorted(sets)
    want = grouped(ids, [(a, b) for x, a in enumerate(ids) for b in ids[:x] if alike(sets[a], sets[b])])
    assert {x.doc_id: x.component_id for x in got if x.doc_id is not None} == want
    assert all(x.n_shingles == len(sets[x.doc_id]) for x in got if x.doc_id is not None)
    assert {x.component_id for x in got if x.doc_id is None} == {want[5], None}
    assert jaccard.jaccard_components(no_docs(spark)).count() == 0


def test_bit_counts_never_hide_a_pair():
    rng = np.random.default_rng(1)
    for _ in range(200):
        n = int(rng.integers(1, 400))
        a = np.unique(rng.integers(0, 2**63, n).astype("uint64"))
        b = np.unique(np.concatenate((a[rng.random(len(a)) < 0.9], rng.integers(0, 2**63, int(rng.integers(0, n // 6 + 1))).astype("uint64"))))
        if len(b) and jaccard.alike(a, b):
            x, y = jaccard.bitmap(a), jaccard.bitmap(b)
            size = min(len(x), len(y)) // 8
            assert jaccard.may_be_alike(len(a), len(b), int(np.bitwise_count(jaccard.folded(x, size) ^ jaccard.folded(y, size)).sum()))


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, lab, 1, 2) for i, v, lab in rows], "vec_id long, embedding array<float>, label int, n long, rep long")


def some_vectors():
    rng = np.random.default_rng(5)
    rows = []
    for k in range(60):
        centre = rng.standard_normal(16)
        for j in range(6):
            v = centre + rng.standard_normal(16) * (0.1 + 0.1 * (j % 3))
            rows.append((10 * k + j, [float(x) for x in v.astype("float32")], k % 3))
    one = rows[0][1]
    rows += [(2000 + i, one, 0) for i in range(30)] + [(2100, [2 * x for x in one], 0), (2101, one, 1), (2102, one, None), (2103, None, 0), (2104, [0.0] * 16, 0)]
    rows += [(2105, [float("nan")] + one[1:], 0), (2106, [None] + one[1:], 0), (None, one, 0), (2107, one[:5], 0), (2108, one[:5], 0), (2108, one[:5], 0), (2109, [float("inf")] + one[1:], 0), (2110, [], 0)]
    return rows


def fine(v):
    return v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v)


def test_near_duplicate_vectors(spark):
    rows = some_vectors()
    got = neardup.near_duplicates(vectors(spark, rows), recall=1.0).collect()
    assert len(got) == len(rows)
    ok = [(i, np.array(v, "float64"), lab) for i, v, lab in rows if fine(v) and any(v) and lab is not None and i is not None]
    cos = lambda a, b: len(a) == len(b) and a @ b / np.sqrt((a @ a) * (b @ b)) >= 0.93
    links, counts = [], {}
    for x, (i, v, lab) in enumerate(ok):
        for y, (j, w, other) in enumerate(ok):
            if x != y and lab == other and cos(v, w):
                links.append((i, j))
                counts[x] = counts.get(x, 0) + 1
    want = grouped({r[0] for r in rows if r[0] is not None}, links)
    told = sorted((i, counts.get(x, 0)) for x, (i, _, _) in enumerate(ok))
    ids = {i for i, _, _ in ok}
    mine = sorted((r.vec_id, r.n_links) for r in got if r.vec_id in ids)
    found = sum(n for _, n in mine)
    assert found >= 0.9 * sum(n for _, n in told)
    assert all(a[1] <= b[1] for a, b in zip(mine, told, strict=True))
    if mine == told:
        assert all(r.component_id == want[r.vec_id] for r in got if r.vec_id is not None)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got if r.vec_id is not None)
    assert [(r.n_links, r.component_id, r.kept) for r in got if r.vec_id is None] == [(0, None, False)]
    assert neardup.near_duplicates(vectors(spark, [])).count() == 0


def test_recall_at_the_default_setting(spark):
    rng = np.random.default_rng(11)
    rows = []
    for k in range(1500):
        v = rng.standard_normal(32)
        rows.append((10 * k, v, k % 3))
        for j in range(1, 1 + k % 3):  # partners at and above the least cosine
            aside = rng.standard_normal(32)
            aside -= aside @ v / (v @ v) * v
            cosine = rng.uniform(0.931, 0.98)
            aside *= np.sqrt(1 - cosine**2) / cosine * np.linalg.norm(v) / np.linalg.norm(aside)
            rows.append((10 * k + j, v + aside, k % 3))
    d = spark.createDataFrame([(i, [float(x) for x in v], lab) for i, v, lab in rows], "vec_id long, embedding array<float>, label int")
    got = {r.vec_id: r.n_links for r in neardup.near_duplicates(d).collect()}
    v = np.array([np.asarray(v, "float32") for _, v, _ in rows], "float64")
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    labels = np.array([lab for _, _, lab in rows])
    near = (v @ v.T >= 0.93) & (labels[:, None] == labels)
    want = dict(zip((i for i, _, _ in rows), near.sum(1) - 1, strict=True))
    assert all(got[i] <= n for i, n in want.items())
    assert sum(want.values()) > 2000 and sum(got.values()) >= 0.9 * sum(want.values())


def test_traversal_visits_nearest_cells_first():
    rng = np.random.default_rng(2)
    index = neardup.MultiIndex(rng.standard_normal((7, 4)), rng.standard_normal((5, 4)))
    v = rng.standard_normal((20, 8))
    d1, d2 = index.distances(v)
    cells, sums = index.nearest(d1, d2, 9)
    every = (d1[:, :, None] + d2[:, None, :]).reshape(20, -1)
    assert (cells == np.argsort(every, 1, kind="stable")[:, :9]).all()
    assert (np.diff(sums, axis=1) >= 0).all()


def test_top_k_against_all_pairs(spark):
    rows = some_vectors() + [(3000, [1e6] * 16, 1), (3001, [-1e6] * 16, 1)]
    df = vectors(spark, rows).repartition(3)
    got = top_k(df, df.where("vec_id % 10 = 0"), 5, shard_rows=32).collect()
    ok = [(i, np.floor(256 * np.array(v, "float64")).astype("int64")) for i, v, _ in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    want = []
    for i, q in ok:
        if i % 10 == 0 and len(q):
            best = sorted((-int(q @ w), j) for j, w in ok if j != i and len(w) == len(q))[:5]
            want += [(i, k, j, -s) for k, (s, j) in enumerate(best, 1)]
    assert sorted(map(tuple, got)) == sorted(want)
    assert top_k(vectors(spark, []), vectors(spark, [])).count() == 0
    blocks = top_k(df, df.where("vec_id % 10 = 0"), 5, query_block=7, shard_rows=32)
    assert sorted(map(tuple, blocks.collect())) == sorted(want)
