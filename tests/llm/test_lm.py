import math
import zlib
from collections import Counter

from lawmesh.llm import lm
from tests.llm.helpers import docs


def held(i):
    return zlib.crc32(str(i).encode()) % 5 == 1


def test_end_counts_beyond_the_head(spark):
    rows = [(i, " ".join(f"w{k}" for k in range(40)) + " w0") for i in range(8)]
    got = {r.doc_id: r for r in lm.score_documents(docs(spark, rows), head=1, vocabulary=1, steps=5, batch=64, noise=8).collect()}
    counts = Counter(w for i, t in rows if not held(i) for w in [*t.split(), None])
    n, v = sum(counts.values()), len(counts)
    for i, t in rows:
        want = sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in [*t.split(), None])
        assert abs(got[i].base_score - want) < 1e-6 and got[i].n_known == got[i].n_tokens == 42


def test_the_model_grows_with_the_texts(spark):
    """Words beyond the first thousand are told by the word before them."""
    rows = [(i, " ".join(f"a{(i * 7 + k) % 1500} b{(i * 7 + k) % 1500}" for k in range(400))) for i in range(1000)]
    got = lm.score_documents(docs(spark, rows), batch=512).collect()
    tested = [r for r in got if r.held_out]
    assert sum(r.score for r in tested) > 0.8 * sum(r.base_score for r in tested)


def test_scores_are_those_of_the_model_in_plain_numpy(spark, monkeypatch):
    import random

    import numpy as np

    r = random.Random(3)
    words = [f"w{k}" for k in range(60)]
    rows = [(i, " ".join(r.choices(words, [1 / (1 + k) for k in range(60)], k=r.randint(0, 50)))) for i in range(80)] + [(90, "never seen before"), (91, None)]
    seen = {}
    totals, pairs = lm.log_totals, lm.count_pairs
    monkeypatch.setattr(lm, "log_totals", lambda d, m: seen.update(model=m) or totals(d, m))
    monkeypatch.setattr(lm, "count_pairs", lambda d, own: seen.update(own=own) or pairs(d, own))
    got = lm.score_documents(docs(spark, rows), head=30, vocabulary=12, steps=40, batch=64, noise=8).collect()
    table = seen["model"].log10_table().astype("float64")
    assert np.allclose((10**table).sum(1), 1, atol=1e-3)
    own = {w: k for k, w in enumerate(seen["own"])}
    end, other = len(own), len(own) + 1
    counts = Counter(w for i, t in rows if not held(i) for w in [*(t or "").encode().split(), None])
    rest = sum(n for w, n in counts.items() if w is not None and w not in own)
    share = rest + 0.5 * (len(counts) - len(own) - 1) + 0.5
    for x in got:
        text = dict(rows)[x.doc_id] or ""
        before, want = end, 0.0
        for w in [*text.encode().split(), None]:
            at = end if w is None else own.get(w, other)
            want += table[before, at] + (math.log10((counts[w] + 0.5) / share) if at == other else 0)
            before = at
        assert abs(want - x.score) < 1e-3 * max(1, abs(want))
