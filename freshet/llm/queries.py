"""Registered queries of the corpus operators, and their SQL where DuckDB can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from freshet.llm.common import table


def op1_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from freshet.llm.minhash_dedup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), words=3, threshold=0.85)


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from freshet.llm.embedding_dedup import embedding_near_duplicates

    return embedding_near_duplicates(table(spark, sf_dir, "embeddings"))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_candidates, n_secrets, first secret's place and the kinds found, for every document."""
    from freshet.llm.secret_scan import summary

    return summary(table(spark, sf_dir, "documents"))


def op4_sentencepiece_fst(spark: SparkSession, sf_dir: str) -> DataFrame:
    from freshet.llm.sentencepiece_fst import digests

    return digests(table(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from freshet.llm.toxicity import toxicity

    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from freshet.llm.quality_classifier import quality_classifier

    return quality_classifier(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from freshet.llm.license_scan import license_scan

    return license_scan(table(spark, sf_dir, "documents")).drop("spans", "allowed")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from freshet.llm.quality_rules import quality_rules

    return quality_rules(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from freshet.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from freshet.llm.suffix_dedup import suffix_dedup

    return suffix_dedup(table(spark, sf_dir, "documents"))


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from freshet.llm.lexical_search import lexical_search

    return lexical_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_spot_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    from freshet.llm.spot_signatures import spot_signatures

    return spot_signatures(table(spark, sf_dir, "documents"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from freshet.llm.prefix_trie import conversation_trie

    return conversation_trie(table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_minhash_dedup, op2_embedding_dedup, op3_secret_scan, op4_sentencepiece_fst, op5_toxicity, op6_quality_classifier, op7_license_scan, op8_quality_rules, op9_best_fit_packing, op10_suffix_dedup, op11_lexical_search, op12_spot_signatures, op13_prefix_trie)}

_OP8 = r"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT k, doc_id, t, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
g AS (SELECT k, i, array_to_string(ws[i:i+4], ' ') AS g FROM (SELECT k, ws, unnest(range(1, len(ws) - 3)) AS i FROM w)),
r AS (SELECT k, i, count(*) OVER (PARTITION BY k, g) AS c FROM g),
v AS (SELECT k, count(DISTINCT p) AS n FROM (SELECT k, unnest(range(i, i + 5)) AS p FROM r WHERE c > 1) GROUP BY k),
b AS (SELECT w.k, doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
             length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
             (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, len(ls) AS n_lines,
             coalesce(v.n, 0)::BIGINT AS n_repeat_words,
             len(list_filter(ws, lambda x: x IN ({stop}))) AS n_stop
      FROM w LEFT JOIN v USING (k)),
f AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM b)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND n_words <= 10000000 AND word_chars / n_words BETWEEN 1.5 AND 40
       AND n_symbols / word_chars <= 0.25 AND n_dup_lines / n_lines <= 0.5
       AND (n_stop / n_words >= 0.004 OR n_words < 50) AS kept
FROM f
"""


def _op8_sql() -> str:
    from freshet.llm.quality_rules import STOP_WORDS

    return _OP8.replace("{stop}", ", ".join(f"'{w}'" for x in STOP_WORDS for w in (x, x.capitalize())))


_OP2 = """
WITH RECURSIVE e AS (
    SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
p AS MATERIALIZED (
    SELECT a.vec_id AS u, b.vec_id AS v FROM e a JOIN e b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
    WHERE list_cosine_similarity(a.v, b.v) >= 0.93),
r(u, v) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.u, p.v FROM r JOIN p ON r.v = p.u)
SELECT vec_id, (SELECT count(*) FROM p WHERE p.u = vec_id) AS n_links, (SELECT min(r.v) FROM r WHERE r.u = vec_id) AS component_id,
       vec_id = (SELECT min(r.v) FROM r WHERE r.u = vec_id) AS kept
FROM embeddings
"""

_OP11 = r"""
WITH t AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
d AS (SELECT row_number() OVER () AS k, doc_id, ts, len(ts) AS n FROM t WHERE len(ts) > 0),
z AS (SELECT count(*)::BIGINT AS n_docs, sum(n)::BIGINT AS n_terms FROM d),
p AS (SELECT k, term, count(*) AS tf FROM (SELECT k, unnest(ts) AS term FROM d) GROUP BY k, term),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
w AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w FROM (SELECT term, count(*) AS df FROM p GROUP BY term), z),
m AS (SELECT k, doc_id, (50 + (50 * n * n_docs) // n_terms)::BIGINT AS m FROM d, z),
s AS (SELECT item_id, m.k, m.doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m)))::BIGINT AS score
      FROM q JOIN w USING (term) JOIN p USING (term) JOIN m USING (k) GROUP BY item_id, m.k, m.doc_id),
r AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 50
"""

_SPOTS = r"""list_sort(list_distinct(list_concat(
    CASE WHEN len(ws) > 0 THEN [left(md5(array_to_string(list_concat(['^'], content[1:{chain}]), ' ')), 8)] ELSE [] END,
    list_filter(list_transform(marks, lambda a, k: CASE WHEN a.i - k < len(content)
        THEN left(md5(array_to_string(list_concat([a.w], content[a.i - k + 1:a.i - k + {chain}]), ' ')), 8) END), lambda h: h IS NOT NULL))))"""
_PARTED = r"""list_filter(ws, lambda w: w NOT IN ({stop})) AS content,
    list_filter(list_transform(ws, lambda w, i: {'w': w, 'i': i}), lambda a: a.w IN ({stop})) AS marks"""
_WORDS = r"list_filter(regexp_split_to_array({text}, '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: x <> '')"
_LIKE = """CASE WHEN {a} = {b} THEN 1.0 WHEN len({a}) = 0 OR len({b}) = 0 THEN 0.0
    WHEN len(list_intersect({a}, {b}))::DOUBLE / (len({a}) + len({b}) - len(list_intersect({a}, {b}))) >= 0.1
    THEN len(list_intersect({a}, {b}))::DOUBLE / (len({a}) + len({b}) - len(list_intersect({a}, {b}))) ELSE 0.0 END::DOUBLE"""
_OP12 = f"""
WITH d AS (SELECT row_number() OVER (ORDER BY doc_id DESC NULLS LAST) AS k, doc_id, coalesce(text, '') AS t FROM documents),
n AS (SELECT k, doc_id, t, coalesce(lead(t) OVER (ORDER BY k), first_value(t) OVER (ORDER BY k)) AS u, length(t)::BIGINT AS n FROM d),
e AS (SELECT *, left(t, (n - n // 2)) || left(u, n // 2) AS e FROM n),
a AS (SELECT 'own' AS kind, k, {_WORDS.format(text="t")} AS ws FROM e UNION ALL SELECT 'edited', k, {_WORDS.format(text="e")} FROM e),
p AS (SELECT kind, k, ws, {_PARTED} FROM a),
s AS (SELECT kind, k, {_SPOTS} AS s FROM p),
x AS (SELECT e.k, doc_id, n, e, o.s AS s, c.s AS c FROM e JOIN s o ON o.k = e.k AND o.kind = 'own' JOIN s c ON c.k = e.k AND c.kind = 'edited'),
y AS (SELECT *, coalesce(lead(s) OVER (ORDER BY k), first_value(s) OVER (ORDER BY k)) AS f FROM x)
SELECT doc_id, n AS n_chars, sha256(e) AS edited_sha256, array_to_string(s, ' ') AS fingerprint, array_to_string(c, ' ') AS edited_fingerprint,
       {_LIKE.format(a="s", b="c")} AS near_edited, {_LIKE.format(a="s", b="f")} AS near_next
FROM y
"""


def _op12_sql() -> str:
    from freshet.llm.quality_rules import STOP_WORDS
    from freshet.llm.spot_signatures import CHAIN

    return _OP12.replace("{stop}", ", ".join(f"'{w}'" for x in STOP_WORDS for w in (x, x.capitalize()))).replace("{chain}", str(CHAIN))


# crc32 of a decimal number: eight steps of the reflected polynomial for each digit's byte.
_OP13 = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
p AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(strlen(role)::VARCHAR || ':' || role || text)) - 1 AS pos FROM t),
c AS (SELECT conv_id, conv_id - conv_id % 20 AS head,
             xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda d: ascii(d)::BIGINT)),
                 lambda a, b: list_reduce(list_prepend(xor(a, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295) % 4 AS h
      FROM (SELECT DISTINCT conv_id FROM t)),
r AS (SELECT c.conv_id, pos, role, text FROM c JOIN p ON p.conv_id = c.conv_id WHERE pos >= h
      UNION ALL SELECT c.conv_id, pos, role, text FROM c JOIN p ON p.conv_id = c.head WHERE pos < h),
s AS (SELECT c.conv_id, coalesce(q.s, []) AS s FROM c LEFT JOIN (SELECT conv_id, list(md5(strlen(role)::VARCHAR || ':' || role || text) ORDER BY pos) AS s FROM r GROUP BY conv_id) q USING (conv_id)),
w AS (SELECT DISTINCT md5(strlen(role)::VARCHAR || ':' || role || text) AS item, len(list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> ''))::BIGINT AS n_words FROM r),
m AS (SELECT conv_id, s, unnest(range(0, len(s) + 1)) AS depth FROM s),
n AS (SELECT s[1:depth] AS pre, depth, min(conv_id) AS conv_id, count(*) AS n_convs,
             sha256(coalesce(string_agg(CASE WHEN len(s) = depth THEN conv_id::VARCHAR END, ',' ORDER BY conv_id), '')) AS ends_sha256 FROM m GROUP BY ALL),
k AS (SELECT n.*, u.conv_id AS parent_conv_id, (n.n_convs - 1) * coalesce(n_words, 0) AS own,
             (SELECT count(*) FROM n x WHERE x.depth = n.depth + 1 AND x.pre[1:n.depth] = n.pre) AS n_children
      FROM n LEFT JOIN n u ON u.depth = n.depth - 1 AND n.pre[1:n.depth - 1] = u.pre AND n.depth > 0 LEFT JOIN w ON w.item = n.pre[n.depth]),
b AS (SELECT s[1:d] AS pre, sum(own) AS saved_tokens, sum((n_children = 0)::BIGINT) AS n_leaves FROM (SELECT pre AS s, own, n_children, unnest(range(0, depth + 1)) AS d FROM k) GROUP BY s[1:d])
SELECT conv_id::BIGINT AS conv_id, depth::BIGINT AS depth, parent_conv_id::BIGINT AS parent_conv_id, n_convs::BIGINT AS n_convs, n_children::BIGINT AS n_children,
       n_leaves::BIGINT AS n_leaves, saved_tokens::BIGINT AS saved_tokens, ends_sha256
FROM k JOIN b USING (pre)
"""

ORACLE_SQL: dict[str, str] = {"op12_spot_signatures": _op12_sql(), "op13_prefix_trie": _OP13, "op11_lexical_search": _OP11, "op2_embedding_dedup": _OP2, "op8_quality_rules": _op8_sql()}
