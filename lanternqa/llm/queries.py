"""One registered query per operator: production parameters, whole tables.

Each query is thin: it calls its operator and derives the digest columns
of its contract from the operator's output.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    graph_ann,
    hard_negatives,
    language_id,
    line_dedup,
    mixing,
    packing,
    prefix_trie,
    quality_rules,
    secret_scan,
    sharding,
    simhash,
    toxicity,
    url_filter,
)
from .common import table


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents"), with_text=False)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", "held_out", "score", "predicted",
                        F.transform("evidence", lambda e: e["doc_id"]).alias("evidence"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op4_graph_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return graph_ann.nearest_neighbours(vectors, vectors.where(F.col("vec_id") % 20 == 0))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    book = quality_rules.ledger(table(spark, sf_dir, "documents"))
    judged = quality_rules.apply_policy(book, "v1")
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                         quality_rules.rejected("base").alias("base_failed"), "kept", "failures")


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = url_filter.filter_urls(table(spark, sf_dir, "pages"))
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(table(spark, sf_dir, "documents"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard_documents(table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
                         F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan_secrets(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(secret_scan.of_kinds(F.col("spans"), (kind,))).cast("long")
    base = secret_scan.of_kinds(F.col("spans"), secret_scan.BASE_KINDS)
    return found.select("doc_id", *[count(k).alias(f"n_{k}") for k in secret_scan.BASE_KINDS],
                        F.sha2(secret_scan.spelled(base), 256).alias("base_sha256"),
                        secret_scan.spelled(F.col("spans")).alias("spans"), count("novel").alias("n_novel"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.hard_negatives(table(spark, sf_dir, "embeddings"))


def op12_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify_languages(table(spark, sf_dir, "documents"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_line_dedup": op1_line_dedup,
    "op2_toxicity": op2_toxicity,
    "op3_simhash": op3_simhash,
    "op4_graph_ann": op4_graph_ann,
    "op5_quality_rules": op5_quality_rules,
    "op6_url_filter": op6_url_filter,
    "op7_mixing": op7_mixing,
    "op8_packing": op8_packing,
    "op9_sharding": op9_sharding,
    "op10_secret_scan": op10_secret_scan,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_language_id": op12_language_id,
    "op13_prefix_trie": op13_prefix_trie,
}

_OP1 = f"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
        unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) AS n FROM documents),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
        '{url_filter.UPPER}', '{url_filter.LOWER}') AS key FROM l),
c AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
m AS (SELECT k.doc_id, k.n, k.line, c.key IS NOT NULL AND k.doc_id <> c.keeper AS dropped
    FROM k LEFT JOIN c ON c.key = k.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped,
    sha256(coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (NOT dropped), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""

_WORD = r"'[^\x20\x09-\x0D]+'"

_OP5 = f"""
WITH w AS (
    SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), {_WORD}) AS words FROM documents),
win AS (SELECT doc_id, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS g
    FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM w WHERE len(words) >= 3)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM win) WHERE n > 1),
rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (
    SELECT doc_id, i AS p FROM twice UNION ALL SELECT doc_id, i + 1 FROM twice
    UNION ALL SELECT doc_id, i + 2 FROM twice) GROUP BY doc_id),
lines AS (SELECT doc_id, count(*) AS n, count(*) - count(DISTINCT l) AS dup
    FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM w) WHERE regexp_matches(l, {_WORD}) GROUP BY doc_id),
m AS (SELECT w.doc_id, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars,
        length(t) - length(translate(t, '#*$%&|<>', '')) AS n_symbols, coalesce(lines.dup, 0) AS n_dup_lines,
        coalesce(rep.n, 0) AS n_repeat_words, coalesce(lines.n, 0) AS n_lines,
        length(regexp_replace(t, '[^A-Z]', '', 'g')) AS caps, length(regexp_replace(t, '[^A-Za-z]', '', 'g')) AS letters
    FROM w LEFT JOIN rep ON rep.doc_id = w.doc_id LEFT JOIN lines ON lines.doc_id = w.doc_id),
b AS (SELECT *, (n_words < 50)::BIGINT + 2 * (100 * n_repeat_words > 50 * n_words)::BIGINT
        + 4 * (100 * n_symbols > 10 * n_words)::BIGINT + 8 * (100 * caps > 30 * letters)::BIGINT
        + 16 * (100 * n_dup_lines > 30 * n_lines)::BIGINT
        + 32 * (word_chars < 2 * n_words OR word_chars > 20 * n_words)::BIGINT AS failures FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failures & 3 <> 0 AS base_failed,
    failures & 47 = 0 AS kept, failures FROM b
"""


def _op6_sql() -> str:
    fits = lambda r: f"regexp_matches(target, '{r.regex}')"
    longest = sorted(url_filter.PREFIX_RULES, key=lambda r: -len(r.name))
    rule = " ".join(f"WHEN {fits(r)} THEN '{r.name}'" for r in longest)
    said = " ".join(f"WHEN {fits(r)} THEN '{r.verdict}'" for r in longest)
    of = lambda v: " OR ".join(fits(r) for r in url_filter.PATTERN_RULES if r.verdict == v)
    return f"""
WITH a AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
    FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{url_filter.UPPER}', '{url_filter.LOWER}') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM a),
t AS (SELECT *, host || path AS target FROM p)
SELECT page_id, host, path, CASE {rule} END AS rule,
    CASE {said} WHEN ({of("block")}) AND NOT ({of("allow")}) THEN 'block' ELSE 'allow' END AS verdict FROM t
"""


_OP11 = """
WITH u AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
        list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
    FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same,
        list_inner_product(a.v::DOUBLE[], c.v::DOUBLE[])::BIGINT AS score
    FROM u a JOIN u c ON a.vec_id % 100 = 0 AND a.vec_id <> c.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score FROM s WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, positive_id, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, vec_id)::INT AS rank,
    vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND 80 * p.score <= 100 * s.score AND s.score <= p.score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, vec_id) <= 5
"""

# CRC-32 bit by bit: a byte goes in, then eight steps
_CRC32 = """xor(list_reduce(flatten(list_transform(string_split(conv_id::VARCHAR, ''),
    lambda ch: [ascii(ch)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1])),
    lambda v, e: CASE WHEN e >= 0 THEN xor(v, e) WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END,
    4294967295::BIGINT), 4294967295::BIGINT)"""

_OP13 = f"""
WITH t AS (SELECT conv_id, turn, length(coalesce(text, '')) AS chars,
        md5(length(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '')) AS k
    FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT conv_id, k, chars, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, k) AS i FROM t),
c AS (SELECT conv_id, count(*) AS n, conv_id - conv_id % 100 AS base, {_CRC32} % 6 AS h FROM o GROUP BY conv_id),
l AS (SELECT c.conv_id, c.n, c.base, c.h, least(c.h, coalesce(b.n, 0)) AS lead
    FROM c LEFT JOIN c b ON b.conv_id = c.base),
r AS (SELECT l.conv_id, i - h + lead AS i, k, chars FROM o JOIN l USING (conv_id) WHERE i > h
    UNION ALL SELECT l.conv_id, i, k, chars FROM o JOIN l ON o.conv_id = l.base AND i <= h),
m AS MATERIALIZED (SELECT conv_id, 0 AS depth, '' AS path, NULL AS parent, 0 AS chars, lead + greatest(n - h, 0) = 0 AS ends FROM l
    UNION ALL SELECT r.conv_id, i, md5(string_agg(k, '') OVER w), CASE WHEN i = 1 THEN '' ELSE
        md5(string_agg(k, '') OVER (PARTITION BY r.conv_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) END,
        chars, i = lead + greatest(n - h, 0)
    FROM r JOIN l USING (conv_id) WINDOW w AS (PARTITION BY r.conv_id ORDER BY i)),
n AS MATERIALIZED (SELECT depth, path, any_value(parent) AS parent, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(chars) AS chars,
        sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256
    FROM m GROUP BY depth, path),
k AS MATERIALIZED (SELECT depth - 1 AS depth, parent AS path, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY ALL),
x AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN k USING (depth, path)),
s AS (SELECT m.depth, m.path, count(*) FILTER (x.n_children = 0) AS n_leaves, sum((x.n_convs - 1) * x.chars) AS saved_tokens
    FROM x JOIN m ON m.conv_id = x.conv_id AND m.depth <= x.depth GROUP BY ALL)
SELECT x.conv_id, x.depth, q.conv_id AS parent_conv_id, x.n_convs, x.n_children, s.n_leaves,
    s.saved_tokens::BIGINT AS saved_tokens, x.ends_sha256
FROM x JOIN s USING (depth, path) LEFT JOIN n q ON q.depth = x.depth - 1 AND q.path = x.parent
"""

ORACLE: dict[str, str] = {
    "op1_line_dedup": _OP1,
    "op5_quality_rules": _OP5,
    "op6_url_filter": _op6_sql(),
    "op11_hard_negatives": _OP11,
    "op13_prefix_trie": _OP13,
}
