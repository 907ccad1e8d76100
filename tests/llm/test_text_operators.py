import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from lawmesh.llm import bpe, packing, pii
from tests.llm.helpers import docs, no_docs, odd_texts

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
WORDS = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def reference():
    import tiktoken

    with open(RANKS, "rb") as f:
        ranks = bpe.read_ranks(f.read())
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_as_the_library(spark, reference):
    got = bpe.encode_documents(docs(spark), RANKS, public_tokenizers.PATTERN, with_ids=True).collect()
    assert len(got) == len(odd_texts())
    want = []
    for _, text in odd_texts():
        ids = reference.encode_ordinary(text or "")
        want.append((len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest(), ids))
    assert sorted((r.n_tokens, r.ids_sha256, r.decoded_sha256, r.ids) for r in got) == sorted(want)
    assert bpe.encode_documents(no_docs(spark), RANKS, public_tokenizers.PATTERN).count() == 0


def test_bpe_joins_are_those_of_whole_pieces(reference):
    with open(RANKS, "rb") as f:
        tree = bpe.TreeBpe(bpe.read_ranks(f.read()))
    r = random.Random(3)
    for alphabet in ("ab", "aeinrst", "the ", "éß中🙂"):
        for _ in range(150):
            data = "".join(r.choice(alphabet) for _ in range(r.randint(1, 300))).encode()
            assert tree.encode(data) == tree.merge(data)
            assert tree.decode(tree.encode(data)) == data
    a, b, c = (tree.encode(x) for x in (b"inter", b"nation", b"ality"))
    assert tree.join(tree.join(a, b), c) == tree.join(a, tree.join(b, c)) == tree.encode(b"internationality")


def test_packing_has_every_id_once(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(WORDS)
    texts = [*odd_texts(), (20, "hello<|endoftext|>world"), (21, "a <|STARTOFTEXT|> b <|endoftext|>"), (22, "<|endoftext|><|endoftext|>  x")]
    assert t.encode("hello<|endoftext|>world", add_special_tokens=False).ids == [3306, 49407, 1002]
    got = [r.asDict() for r in packing.pack_documents(docs(spark, texts).coalesce(1), WORDS, block_tokens=4096).collect()]
    pieces, sequences = {}, {}
    for r in got:
        pieces.setdefault((r["doc_id"], r["doc_tokens"]), []).append(r)
        sequences.setdefault(r["sequence_id"], []).append(r)
    told = []
    for rows in sequences.values():
        rows.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in rows] == np.cumsum([0, *(r["length"] for r in rows)])[:-1].tolist()
        assert sum(r["length"] for r in rows) <= 2048
    for doc_id, text in texts:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 1]
        for start in range(0, len(ids), 512):
            part = ids[start : start + 512]
            told.append((doc_id, start, len(part), zlib.crc32(np.array(part, "<u4").tobytes()), len(ids)))
    key = lambda x: tuple(-1 if v is None else v for v in x)
    assert sorted(told, key=key) == sorted(((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in got), key=key)
    assert packing.pack_documents(no_docs(spark), WORDS).count() == 0


def test_packing_looks_up_pieces_not_words(monkeypatch):
    """Words that differ in capitals and punctuation bring no strings of their own; ids are the tokenizer's, for any letters."""
    from tokenizers import Tokenizer

    with open(WORDS, encoding="utf-8") as f:
        spec = f.read()
    t, seen = Tokenizer.from_str(spec), []
    words, learn = packing.Words(t, spec), packing.Words.learn
    monkeypatch.setattr(packing.Words, "learn", lambda self, some: seen.extend(some) or learn(self, some))
    texts = [f"{w}{e} {b}{w}" for w in ("filter", "Filter", "FILTER", "fIlTeR") for b in "([{\"" for e in ".,;:!?"]
    more = ["It's we'LL i''ll 'Re don't'S", "\u0130stanbul \u0130x-\u0130", "\u023ab-\u2c65 \u023a", "", None, *(f"a{chr(c)}B'{chr(c)} {chr(c)}" for c in range(0x21, 0x250))]
    for some in (texts, more):
        ids, bounds = words.encode(pa.array(some, pa.string()))
        assert [ids[i:j].tolist() for i, j in zip(bounds, bounds[1:])] == [t.encode(x or "", add_special_tokens=False).ids for x in some]
        assert some is more or len(seen) <= 12


def test_differencing_is_even_and_complete():
    r = random.Random(1)
    for n, k in ((0, 3), (1, 1), (5, 3), (40, 7), (600, 100)):
        sizes = [r.randint(1, 512) for _ in range(n)]
        windows = packing.difference(sizes, k)
        assert sorted(i for w in windows for i in w) == list(range(n))
        assert len(windows) <= k
        if n >= 4 * k:
            sums = [sum(sizes[i] for i in w) for w in windows]
            assert max(sums) - min(sums) <= 60
    windows = packing.windows_of([2048, 2000, 100, 48], 2048)
    assert max(sum([2048, 2000, 100, 48][i] for i in w) for w in windows) <= 2048
    assert len(windows) == 3  # 2048, 2000 + 48, 100: one more than the total asks for


PATTERNS = (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")


def plain_spans(text):
    out = []
    for kind, p in enumerate(PATTERNS):
        for m in re.finditer(p, text):
            s = m[0]
            d = re.sub("[^0-9]", "", s)
            luhn = sum(int(c) if i % 2 == 0 else sum(map(int, str(2 * int(c)))) for i, c in enumerate(reversed(d))) % 10 == 0
            fine = (True, all(int(x) <= 255 for x in s.split(".")) if kind == 1 else True, 14 <= len(d) <= 19 and luhn, 10 <= len(d) <= 15)[kind]
            if fine:
                out.append((m.start(), kind, m.end()))
    return sorted(out)


def test_base_spans_are_those_of_the_patterns():
    r = random.Random(2)
    for _ in range(3000):
        text = "".join(r.choice("a1.@+- ()9.b0") for _ in range(r.randint(0, 60)))
        assert pii.base_spans(text) == plain_spans(text)


def test_personal_data(spark):
    card = "4111 1111 1111 1111"
    rows = [*odd_texts(), (30, f"mail a.b@c.org or (415) 555-2671, card {card} at 10.0.0.1"), (31, "clean text of 2024-01-05 at 12:30, version 3.11.4, order #12345"), (32, f"+1 (269) 555-3296 {card}")]
    got = {r.doc_id: r for r in pii.find_personal_data(docs(spark, rows)).collect() if r.doc_id}
    assert pii.find_personal_data(docs(spark, rows)).count() == len(rows)
    for doc_id, text in rows:
        if doc_id:
            base = plain_spans(text or "")
            joined = ",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in base)
            r = got[doc_id]
            assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == i for _, k, _ in base) for i in range(4))
            assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
            assert not base or set(joined.split(",")) <= set(r.spans.split(","))
    assert "phone:18:32" in got[30].spans  # only the model finds this one
    assert got[31].spans == ""
    assert "phone:0:17" in got[32].spans and "card:18:37" in got[32].spans  # the patterns see one number of 27 digits
    assert pii.find_personal_data(no_docs(spark)).count() == 0


def test_crf_on_rows_it_has_not_seen():
    crf = pii.train(pii.labelled_table())
    table = pii.labelled_table(300, seed=77)
    missed = extra = found = 0
    for (_, spans), got in zip(table, pii.crf_spans([t for t, _ in table], crf), strict=True):
        want = {(s, k, e) for s, e, k in spans}
        found, missed, extra = found + len(want & set(got)), missed + len(want - set(got)), extra + len(set(got) - want)
    assert found > 0.95 * (found + missed) and extra < 0.05 * found


def test_viterbi_against_all_sequences():
    from itertools import product

    rng = np.random.default_rng(0)
    crf = pii.Crf(np.zeros((1, 3)), rng.standard_normal((3, 3)))
    scores = rng.standard_normal((4, 5, 3))
    for got, s in zip(crf.viterbi(scores), scores, strict=True):
        total = lambda y: crf.move[0, y[0]] + sum(s[t, y[t]] for t in range(5)) + sum(crf.move[a, b] for a, b in zip(y, y[1:], strict=False)) + crf.move[y[-1], 0]  # noqa: B023, E731
        assert tuple(got) == max(product(range(3), repeat=5), key=total)


def test_redacting_keeps_rows_and_columns(spark):
    d = docs(spark, [(1, "to x@y.org now"), (2, None), (3, "plain")])
    got = {r.doc_id: r for r in pii.redact(d).collect()}
    assert got[1].text == "to [EMAIL] now" and got[1].n_chars == 14 and got[2].text is None and got[3].text == "plain"
    assert pii.redact(d).columns == d.columns


def test_what_the_crf_adds_to_the_base_patterns():
    """Written by hand, apart from the generated table that the CRF learns from."""
    crf = pii.train(pii.labelled_table())
    wanted = [
        ("call 415-555-2671 now", "phone", "415-555-2671"), ("ring (415) 555-2671 today", "phone", "(415) 555-2671"), ("office: 212.555.0187, ask for Ann", "phone", "212.555.0187"),
        ("pay 4111.1111.1111.1111 ok", "card", "4111.1111.1111.1111"), ("mail jane.doe (at) mail.com today", "email", "jane.doe (at) mail.com"),
        ("write john dot smith at example dot com please", "email", "john dot smith at example dot com"), ("reach me: sue [at] uni [dot] edu", "email", "sue [at] uni [dot] edu"),
        ('the token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" is live', "secret", "04dbebab91ab85687d33eeaaf9ac699e1188f962"),
    ]
    texts = [t for t, _, _ in wanted]
    base, every = pii.find_spans(texts, crf)
    assert not any(base)
    got = [[(pii.KINDS[k], t[s:e]) for s, k, e in spans] for t, spans in zip(texts, every, strict=True)]
    assert got == [[(kind, s)] for _, kind, s in wanted]
    clean = [
        "in 1999-2001 and on 2020-01-02 at 10:30", "the dot on the i at home is small", "see https://a.b.org/x12345 and chapter 4.2.1", "it cost $12,345.67 or 15 % less", "order 12345678, lot 99-1234",
        "scored 3-2 at 90 minutes, 10-4 overall", "version 10.15.7 of build 20231105", "room 415, floor 5, block 2671", "a dot com bubble at the end", "ISBN 978-3-16-148410-0 in print",
    ]
    assert pii.find_spans(clean, crf)[1] == [[]] * len(clean)


def test_planted_and_clean_documents(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    got = pii.find_personal_data(rows).join(rows, "doc_id").collect()
    planted = [r for r in got if r.n_email + r.n_ip + r.n_card + r.n_phone or 'token = "' in (r.text or "")]
    clean = [r for r in got if r not in planted]
    assert all(r.n_spans for r in planted) and sum(not r.n_spans for r in clean) >= 0.98 * len(clean)
    assert all(r.n_spans == len([x for x in r.spans.split(",") if x]) for r in got)
