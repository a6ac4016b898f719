"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import ann, bagminhash, bpe, decontaminate, langid, packing, quality, secretscan, substrings, tokencounts, tokens
from .shared import documents

WORD_BPE = "word_bpe_49k.json"
#: Characters of a section whose bounds fall inside words.
STRETCH = 100


def op1_token_files(spark, sf_dir):
    return packing.token_files(documents(spark, sf_dir), tokens.public_path(WORD_BPE))


def op2_substrings(spark, sf_dir):
    return substrings.remove_repeats(documents(spark, sf_dir))


def op3_bpe(spark, sf_dir):
    return bpe.encode_decode(documents(spark, sf_dir), tokens.public_path(WORD_BPE))


def op4_multi_index(spark, sf_dir):
    return ann.search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 100 == 0)


def op5_language(spark, sf_dir):
    return langid.identify(documents(spark, sf_dir))


def op6_secrets(spark, sf_dir):
    return secretscan.scan_secrets(documents(spark, sf_dir))


def op7_decontamination(spark, sf_dir):
    return decontaminate.contamination(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op8_near_duplicates(spark, sf_dir):
    return bagminhash.near_duplicates(documents(spark, sf_dir))


def op9_token_counts(spark, sf_dir):
    return tokencounts.line_counts(documents(spark, sf_dir), tokens.public_path(WORD_BPE))


def op9_token_stretches(spark, sf_dir):
    """Stretches of characters, whose bounds fall inside tokens, so that the rule decides; lines are never crossed."""
    return tokencounts.line_counts(documents(spark, sf_dir), tokens.public_path(WORD_BPE), width=STRETCH)


def op10_quality(spark, sf_dir):
    return quality.rank_quality(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


QUERIES = {
    "op1_token_files": op1_token_files,
    "op2_substrings": op2_substrings,
    "op3_bpe": op3_bpe,
    "op4_multi_index": op4_multi_index,
    "op5_language": op5_language,
    "op6_secrets": op6_secrets,
    "op7_decontamination": op7_decontamination,
    "op8_near_duplicates": op8_near_duplicates,
    "op9_token_stretches": op9_token_stretches,
    "op9_token_counts": op9_token_counts,
    "op10_quality": op10_quality,
}
SQL = {
    "op6_secrets": r"""
        WITH t AS (SELECT doc_id, coalesce(text, '') AS text, source FROM documents),
        q AS (
            SELECT * FROM (VALUES
                (0, '(?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?(?:[A-Za-z0-9+/_.=-]+)', '(?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)'),
                (1, 'AKIA[A-Z0-9]+', '(AKIA[A-Z0-9]+)'), (2, '[0-9a-f]{24,}', '([0-9a-f]{24,})'), (3, '[A-Za-z0-9+/_=-]{20,}', '([A-Za-z0-9+/_=-]{20,})')) AS v(k, p, g)),
        r AS (
            SELECT doc_id, source, k, regexp_extract_all(text, p) AS f, string_split_regex(text, p) AS u, regexp_extract_all(text, g, 1) AS v
            FROM (SELECT * FROM t, q) WHERE regexp_matches(text, p)),
        i AS (SELECT *, unnest(range(1, len(f) + 1)) AS i FROM r),
        m AS (
            SELECT doc_id, source, k, v[i] AS v, length(f[i]) AS n, CAST(coalesce(list_sum(list_transform(u[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(f[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS a
            FROM i),
        c AS (SELECT * FROM m WHERE CASE k WHEN 0 THEN length(v) >= 6 WHEN 1 THEN n >= 20 WHEN 2 THEN true ELSE regexp_matches(v, '[0-9]') AND regexp_matches(v, '[A-Za-z]') END),
        few AS (SELECT v FROM c WHERE k = 3 GROUP BY v HAVING count(DISTINCT source) <= 2),
        s AS (SELECT doc_id, k, a, a + n AS b, ['assign', 'access', 'hex', 'owned'][k + 1] || ':' || a || ':' || (a + n) AS say FROM c WHERE k < 3 OR v IN (SELECT v FROM few)),
        g AS (
            SELECT doc_id, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex, count(*) FILTER (k = 3) AS n_owned,
                string_agg(say, ',' ORDER BY a, k, b) FILTER (k < 3) AS base, string_agg(say, ',' ORDER BY a, k, b) AS spans
            FROM s GROUP BY doc_id)
        SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_owned, 0) AS n_owned
        FROM t LEFT JOIN g USING (doc_id)
    """,
    "op7_decontamination": r"""
        WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
        b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
        bw AS (
            SELECT DISTINCT item_id, least(len(w), 13) AS m, array_to_string(w[i : i + least(len(w), 13) - 1], ' ') AS s
            FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 13, 0) + 2)) AS i FROM b WHERE len(w) > 0)),
        dw AS (
            SELECT doc_id, i, m, array_to_string(w[i : i + m - 1], ' ') AS s
            FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, (SELECT DISTINCT m FROM bw) WHERE len(w) >= m)),
        f AS (SELECT DISTINCT doc_id, i, m, item_id FROM dw JOIN bw USING (m, s)),
        h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS p FROM f) GROUP BY doc_id),
        n AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(item_id, ',' ORDER BY item_id)) AS s FROM (SELECT DISTINCT doc_id, item_id FROM f) GROUP BY doc_id)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
            coalesce(n.s, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
        FROM d LEFT JOIN h USING (doc_id) LEFT JOIN n USING (doc_id)
    """,
}
