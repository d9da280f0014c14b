"""The registered queries of this subpackage, with the parameters used in production, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import common

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _query(f):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        common.tune(spark)
        return f(spark, sf_dir)

    QUERIES[f.__name__] = run
    return f


@_query
def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .exact_dedup import exact_dedup

    return exact_dedup(spark, common.table(spark, sf_dir, "documents"))


SQL["op1_exact_dedup"] = r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id IS NOT DISTINCT FROM min(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)
"""


@_query
def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as vocabularies

    from .bpe import digests

    return digests(spark, common.table(spark, sf_dir, "documents"), vocabularies.path("byte_bpe_50k.tiktoken"), vocabularies.PATTERN)


@_query
def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as vocabularies

    from .packing import best_fit_packing

    return best_fit_packing(spark, common.table(spark, sf_dir, "documents"), vocabularies.path("byte_bpe_50k.json"), vocabularies.PATTERN, 2048, 0)


@_query
def op7_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as vocabularies

    from .token_store import token_store

    return token_store(spark, common.table(spark, sf_dir, "documents"), vocabularies.path("byte_bpe_50k.json"), vocabularies.PATTERN, 2)


@_query
def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import quality

    return quality(spark, common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))


@_query
def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import toxicity

    return toxicity(spark, common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))


@_query
def op10_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_extract import extract

    return extract(spark, common.table(spark, sf_dir, "pages"))


@_query
def op2_ball_tree_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .topk import top_k

    return top_k(spark, common.table(spark, sf_dir, "embeddings"))


SQL["op2_ball_tree_topk"] = """
WITH e AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
  FROM e q JOIN e c ON c.vec_id <> q.vec_id AND len(c.v) = len(q.v) WHERE q.vec_id % 20 = 0
), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""


@_query
def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ngram_join import ngram_join

    return ngram_join(spark, common.table(spark, sf_dir, "documents"))


SQL["op5_ngram_join"] = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, list_distinct(list_transform(range(1, greatest(len(w) - 3, 2)), lambda i: array_to_string(w[i:i+4], ' '))) AS g FROM w WHERE len(w) > 0),
s AS (SELECT doc_id, unnest(g) AS s FROM g),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN g x ON x.doc_id = a JOIN g y ON y.doc_id = b WHERE 5 * n >= 4 * (len(x.g) + len(y.g) - n)),
r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
c AS (SELECT a, min(b) AS m FROM r GROUP BY a),
k AS (SELECT a, count(*) AS n FROM e GROUP BY a)
SELECT doc_id, least(doc_id, coalesce(m, doc_id)) AS class_id, coalesce(k.n, 0) AS n_links, least(doc_id, coalesce(m, doc_id)) = doc_id AS kept
FROM documents LEFT JOIN c ON c.a = doc_id LEFT JOIN k ON k.a = doc_id
"""


@_query
def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring_dedup import substring_dedup

    return substring_dedup(spark, common.table(spark, sf_dir, "documents"))


@_query
def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .divergence import divergence

    return divergence(spark, common.table(spark, sf_dir, "documents"))


SQL["op11_source_divergence"] = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
t AS (SELECT r, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS (SELECT lang, term, count(*) AS n FROM t GROUP BY ALL HAVING count(DISTINCT r) >= 10),
l AS (SELECT lang, count(*)::HUGEINT AS v, sum(n)::HUGEINT AS total FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM t SEMI JOIN k USING (lang, term) GROUP BY ALL),
s AS (SELECT lang, source, sum(n)::HUGEINT AS total FROM c GROUP BY ALL),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
    1 + 1000000000::HUGEINT * (coalesce(c.n, 0) + 2) // (coalesce(s.total, 0) + 2 * l.v) AS p,
    1 + 1000000000::HUGEINT * (k.n + 2) // (l.total + 2 * l.v) AS q
  FROM g JOIN k USING (lang) JOIN l USING (lang) LEFT JOIN s USING (lang, source) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
f AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
e AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0)::BIGINT AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
  UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q) // (p + q))::BIGINT FROM p WHERE n > 0 AND p > q),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM e)
SELECT lang, source, part, item, value, rank FROM r WHERE part = 'pair' OR rank <= 10
"""


@_query
def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .prefix_trie import prefix_trie

    return prefix_trie(spark, common.table(spark, sf_dir, "conversations"))


SQL["op13_prefix_trie"] = r"""
WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS i, {'r': coalesce(role, ''), 't': coalesce(text, '')} AS x FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT conv_id, list(x ORDER BY i) AS own FROM t GROUP BY conv_id),
h AS (SELECT conv_id, own, xor(4294967295::BIGINT, list_reduce(list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT)),
    lambda a, b: list_reduce([0, 1, 2, 3, 4, 5, 6, 7], lambda s, k: xor(s // 2, (s % 2) * 3988292384::BIGINT), xor(a, b)), 4294967295::BIGINT)) % 4 AS h FROM o),
c AS (SELECT h.conv_id, list_concat(coalesce(b.own, [])[1:h.h], h.own[h.h + 1:]) AS w FROM h LEFT JOIN o b ON b.conv_id = h.conv_id - h.conv_id % 20),
p AS (SELECT conv_id, len(w) AS length, unnest(range(0, len(w) + 1)) AS depth, w FROM c),
n AS (SELECT depth, w[1:depth] AS k, min(conv_id) AS conv_id, count(*) AS n_convs, string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE length = depth) AS ends FROM p GROUP BY ALL),
v AS (SELECT n.*, CASE WHEN depth = 0 THEN 0 ELSE (n_convs - 1) * len(regexp_extract_all(k[depth].t, '[^\x20\x09-\x0D]+')) END AS saved,
    (SELECT count(*) FROM n y WHERE y.depth = n.depth + 1 AND y.k[1:n.depth] = n.k) AS n_children FROM n),
u AS (SELECT v.*, unnest(range(0, depth + 1)) AS up FROM v),
s AS (SELECT up AS depth, k[1:up] AS k, count(*) FILTER (WHERE n_children = 0) AS n_leaves, sum(saved) AS saved_tokens FROM u GROUP BY ALL)
SELECT v.conv_id, v.depth, q.conv_id AS parent_conv_id, v.n_convs, v.n_children, s.n_leaves, CAST(s.saved_tokens AS BIGINT) AS saved_tokens, sha256(coalesce(v.ends, '')) AS ends_sha256
FROM v JOIN s ON s.depth = v.depth AND s.k = v.k LEFT JOIN n q ON q.depth = v.depth - 1 AND q.k = v.k[1:v.depth - 1] AND v.depth > 0
"""


@_query
def op12_prefix_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .prefix_forest import neighbours

    return neighbours(spark, common.table(spark, sf_dir, "embeddings"))
