"""The registered queries of the operators, over whole tables, and their SQL."""

from __future__ import annotations

from lawmesh.llm.common import table


def op1_html(spark, sf_dir):
    from lawmesh.llm.html import extract_main_text

    return extract_main_text(table(spark, sf_dir, "pages"))


def op2_bpe(spark, sf_dir):
    import public_tokenizers

    from lawmesh.llm.bpe import encode_documents

    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return encode_documents(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)


def op3_pii(spark, sf_dir):
    from lawmesh.llm.pii import find_personal_data

    return find_personal_data(table(spark, sf_dir, "documents"))


def op5_maxscore(spark, sf_dir):
    from lawmesh.llm.maxscore import top_k

    vectors = table(spark, sf_dir, "embeddings")
    return top_k(vectors, vectors.where("vec_id % 50 = 0"))


def op4_jaccard(spark, sf_dir):
    from lawmesh.llm.jaccard import jaccard_components

    return jaccard_components(table(spark, sf_dir, "documents"))


OP4_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s
  FROM w
), e AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s), pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.g = b.g AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM s UNION SELECT r.a, p.b FROM reach r JOIN pairs p ON r.b = p.a
)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, c.component_id FROM s JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY a) c ON s.doc_id = c.a
"""

OP5_SQL = """
WITH q AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings
  WHERE len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)
), s AS (
  SELECT a.vec_id AS query_id, b.vec_id,
         CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM q a JOIN q b ON a.vec_id <> b.vec_id AND len(a.q) = len(b.q)
  WHERE a.vec_id % 50 = 0
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""


def op6_lm_scoring(spark, sf_dir):
    from lawmesh.llm.lm import score_documents

    return score_documents(table(spark, sf_dir, "documents"))


def op7_packing(spark, sf_dir):
    import public_tokenizers

    from lawmesh.llm.packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), rows=1536)


def op8_neardup(spark, sf_dir):
    from lawmesh.llm.neardup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "embeddings"))


OP8_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding) AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), pairs AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE list_cosine_similarity(a.v, b.v) >= 0.93
), reach AS (
  SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, p.b FROM reach r JOIN pairs p ON r.b = p.a
), n AS (SELECT a, count(*) AS n_links FROM pairs GROUP BY a)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY a) c ON vec_id = c.a LEFT JOIN n ON vec_id = n.a
"""


def op9_language_id(spark, sf_dir):
    from lawmesh.llm.langid import identify_languages

    return identify_languages(table(spark, sf_dir, "documents"))


def op10_sharding(spark, sf_dir):
    from lawmesh.llm.sharding import shard_documents

    return shard_documents(table(spark, sf_dir, "documents"))


def op11_phrases(spark, sf_dir):
    from lawmesh.llm.phrases import collocations

    return collocations(table(spark, sf_dir, "documents"))


OP11_SQL = r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents
), w AS (SELECT lang, list_filter(string_split_regex(p, '[\x20\x09]+'), lambda x: x <> '') AS w FROM p),
n AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY lang),
g AS (SELECT lang, m, unnest(list_transform(range(1, len(w) - m + 2), lambda i: w[i:i + m - 1])) AS g FROM w, (SELECT unnest([1, 2, 3, 4, 5]) AS m)),
f AS (SELECT lang, m, g, count(*) AS f FROM g GROUP BY lang, m, g HAVING count(*) >= 100),
c AS (SELECT * FROM f WHERE m > 1),
gone AS (SELECT DISTINCT c.lang, c.g FROM c JOIN (SELECT lang, f, g[1:m - 1] AS h FROM c WHERE m > 2 UNION ALL SELECT lang, f, g[2:] FROM c WHERE m > 2) d ON c.lang = d.lang AND c.g = d.h AND 100 * d.f >= 100 * c.f),
cuts AS (SELECT lang, g, f AS a, m, unnest(range(1, m)) AS k FROM c ANTI JOIN gone USING (lang, g)),
s AS (SELECT u.lang, u.g, u.a, u.k, l.f AS l, r.f AS r, n.n, CAST(1000 * u.a::HUGEINT * n.n // (l.f::HUGEINT * r.f) AS BIGINT) AS score
  FROM cuts u JOIN f l ON l.lang = u.lang AND l.g = u.g[1:k] JOIN f r ON r.lang = u.lang AND r.g = u.g[k + 1:] JOIN n ON n.lang = u.lang),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1)
SELECT lang, CAST(rank AS BIGINT) AS rank, phrase, a, l, r, n, score FROM (
  SELECT *, array_to_string(g, ' ') AS phrase, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(g, ' ')) AS rank FROM b) WHERE rank <= 2000
"""


def op12_secrets(spark, sf_dir):
    from lawmesh.llm.secrets import scan_secrets

    return scan_secrets(table(spark, sf_dir, "documents"))


#: The rules written out again: kind, pattern, least length, group and its least length.
OP12_RULES = (
    ("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 0, 2, 6),
    ("access", "AKIA[A-Z0-9]+", 20, 0, 0),
    ("hex", "[0-9a-f]+", 24, 0, 0),
    ("github", "gh[pousr]_[A-Za-z0-9]+", 40, 0, 0),
    ("slack", "xox[abprs]-[A-Za-z0-9-]+", 15, 0, 0),
    ("stripe", "[sr]k_(live|test)_[A-Za-z0-9]+", 24, 0, 0),
    ("google", "AIza[0-9A-Za-z_-]+", 39, 0, 0),
    ("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 30, 0, 0),
    ("pem", "-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 0, 0),
    ("url", "://[A-Za-z0-9._%+-]+:[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+", 0, 0, 0),
)


def _found(rank: int, rule: tuple) -> str:
    kind, pattern, length, group, least = (x.replace("'", "''") if isinstance(x, str) else x for x in rule)
    return f"""SELECT id, {rank} AS rank, '{kind}' AS kind, e - length(m) AS s, e FROM (SELECT id, m, e FROM (
  SELECT id, unnest(m) AS m, unnest(list_transform(range(1, len(m) + 1), lambda i: CAST(list_sum(list_transform(p[1:i], lambda x: length(x))) + list_sum(list_transform(m[1:i], lambda x: length(x))) AS BIGINT))) AS e
  FROM (SELECT id, regexp_extract_all(text, '{pattern}') AS m, string_split_regex(text, '{pattern}') AS p FROM d WHERE regexp_matches(text, '{"[0-9a-f]{24}" if kind == "hex" else pattern}')))) WHERE length(m) >= {length} AND length(regexp_extract(m, '{pattern}', {group})) >= {least}"""


OP12_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS id, doc_id, coalesce(text, '') AS text FROM documents),
s AS ({" UNION ALL ".join(_found(k, rule) for k, rule in enumerate(OP12_RULES))}),
t AS (SELECT id, CAST(sum(CAST(rank = 0 AS INT)) AS BIGINT) AS n_assign, CAST(sum(CAST(rank = 1 AS INT)) AS BIGINT) AS n_access, CAST(sum(CAST(rank = 2 AS INT)) AS BIGINT) AS n_hex,
  string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank) FILTER (WHERE rank < 3) AS base, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank) AS spans FROM s GROUP BY id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN t USING (id)
"""


def op13_divergence(spark, sf_dir):
    from lawmesh.llm.divergence import source_divergence

    return source_divergence(table(spark, sf_dir, "documents"))


OP13_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents
), t AS (SELECT lang, source, id, unnest(w) AS term FROM d),
kept AS (SELECT lang, term FROM t GROUP BY lang, term HAVING count(DISTINCT id) >= 30),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
c AS (SELECT lang, source, term, count(*) AS c FROM t SEMI JOIN kept USING (lang, term) GROUP BY ALL),
g AS (SELECT DISTINCT lang, source FROM d),
x AS (SELECT g.lang, g.source, kept.term, coalesce(c.c, 0) AS c FROM g JOIN kept ON g.lang = kept.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = kept.term),
p AS (SELECT x.lang, source, term, c, CAST(1 + 1000000000::HUGEINT * (c + 5) // (sum(c) OVER (PARTITION BY x.lang, source) + 5 * v) AS BIGINT) AS p FROM x JOIN v ON x.lang = v.lang),
q AS (SELECT k.lang, term, CAST(1 + 1000000000::HUGEINT * (k.c + 5) // (sum(k.c) OVER (PARTITION BY k.lang) + 5 * v) AS BIGINT) AS q FROM (SELECT lang, term, sum(c) AS c FROM c GROUP BY lang, term) k JOIN v ON k.lang = v.lang),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(f, 0) AS BIGINT) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (SELECT a.lang, a.source, b.source AS other, sum(abs(a.p - b.p)) AS f FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL) s ON s.lang = a.lang AND s.source = a.source AND s.other = b.source),
terms AS (SELECT p.lang, source, 'term' AS part, p.term AS item, p - q AS value FROM p JOIN q ON p.lang = q.lang AND p.term = q.term WHERE c > 0 AND p > q)
SELECT lang, source, part, item, value, CAST(rank AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms)) WHERE part = 'pair' OR rank <= 50
"""


def pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    return {f.__name__: f for f in (op1_html, op2_bpe, op3_pii, op4_jaccard, op5_maxscore, op6_lm_scoring, op7_packing, op8_neardup, op9_language_id, op10_sharding, op11_phrases, op12_secrets, op13_divergence, pipeline)}


def oracle_sql() -> dict:
    return {"op4_jaccard": OP4_SQL, "op5_maxscore": OP5_SQL, "op8_neardup": OP8_SQL, "op11_phrases": OP11_SQL, "op12_secrets": OP12_SQL, "op13_divergence": OP13_SQL}
