"""Registered queries for the text operators (B1-B16) over ``documents``.

Arrays are shown joined (by a space when tokens cannot hold one, else by
U+0001) so results hash the same in Spark and DuckDB.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import arrow
from ..functions import text as tx
from ..functions.constants import SEGMENT_PATTERN
from ..operators import tokens as tk
from ..operators.index import normalized_text
from ..session import materialized
from . import fixtures as fx
from .oracle_sql import filtered_word, lit, terms, tokens, uncased

SEP = "\u0001"
SLICE = (3, 12)          # token slice used by the untokenise check
NGRAM_N = 2              # the reference's usual bigram setting


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.documents(spark, sf_dir)


def nfd_normalize(spark, sf_dir):
    """B1, shown with combining marks removed (the oracle has no NFD)."""
    d = _docs(spark, sf_dir)
    nfd = d.select("doc_id", arrow.nfd(F.col("text")).alias("nfd"))
    return nfd.select("doc_id", F.regexp_replace("nfd", r"\p{M}", "").alias("folded"))


def tokenize(spark, sf_dir):
    d = _docs(spark, sf_dir).select("doc_id", tx.tokenize("text").alias("t"))
    return d.select("doc_id", F.size("t").cast("long").alias("n_tokens"),
                    F.array_join("t", " ").alias("tokens"))


def token_offsets(spark, sf_dir):
    return tk.token_offsets(_docs(spark, sf_dir))


def words_uncased(spark, sf_dir):
    d = _docs(spark, sf_dir).select("doc_id", tx.words(tx.tokenize("text"), uncased=True).alias("w"))
    return d.select("doc_id", F.array_join("w", " ").alias("words"))


def token_slice(spark, sf_dir):
    d = _docs(spark, sf_dir).select("doc_id", tx.tokenize("text").alias("t"))
    return d.select("doc_id",
                    F.array_join(tx.token_slice("t", 2, 7), " ").alias("head"),
                    F.array_join(tx.token_slice("t", -5, None), " ").alias("tail"))


def untokenize(spark, sf_dir):
    spans = tk.with_token_spans(_docs(spark, sf_dir))
    return spans.select("doc_id", tk.untokenize(F.col("text"), F.col("toks"), F.lit(SLICE[0]),
                                                F.lit(SLICE[1])).alias("span"),
                        tk.untokenize(F.col("text"), F.col("toks"), F.lit(0), F.size("toks")).alias("whole"))


def token_count(spark, sf_dir):
    d = _docs(spark, sf_dir)
    return d.select("doc_id", tx.token_count(tx.tokenize("text")).cast("long").alias("n_tokens"))


def ngrams(spark, sf_dir):
    d = _docs(spark, sf_dir).select("doc_id", tx.words(tx.tokenize("text"), uncased=True).alias("w"))
    g = d.select("doc_id", tx.ngrams("w", NGRAM_N).alias("g"))
    return g.select("doc_id", F.size("g").cast("long").alias("n_grams"),
                    F.array_join("g", SEP).alias("grams"))


def filter_word(spark, sf_dir):
    d = _docs(spark, sf_dir).select(F.explode(tx.words(tx.tokenize("text"), uncased=True)).alias("token"))
    return d.distinct().select("token", tx.is_filtered_word(F.col("token")).alias("dropped"))


def _filter_ngram(mode):
    def run(spark, sf_dir):
        d = _docs(spark, sf_dir).select("doc_id", tx.words(tx.tokenize("text"), uncased=True).alias("w"))
        g = d.select("doc_id", tx.ngrams("w", NGRAM_N, filter_fn=lambda x: tx.filter_ngram(x, mode)).alias("g"))
        return g.select("doc_id", F.size("g").cast("long").alias("n_kept"),
                        F.array_join("g", SEP).alias("kept"))
    run.__name__ = f"filter_ngram_{mode}"
    return run


def parse_terms(spark, sf_dir):
    d = tx.with_parsed_terms(_docs(spark, sf_dir), F.col("text"), ("doc_id",), NGRAM_N, "any", "g")
    return d.select("doc_id", F.array_join("g", SEP).alias("terms"))


def parse_unigrams(spark, sf_dir):
    """B11 with n=1, the path that the index takes."""
    d = _docs(spark, sf_dir).select("doc_id", tx.parse_terms("text", 1, "any").alias("g"))
    return d.select("doc_id", F.array_join("g", SEP).alias("terms"))


def normalize_answer(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", tx.normalize_answer("text").alias("normalized"))


def strip_whitespace(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", tx.strip_whitespace("text").alias("stripped"))


def annotation_arrays(spark, sf_dir):
    spans = tk.with_token_spans(_docs(spark, sf_dir))
    return spans.select("doc_id", F.array_join(tk.annotations(F.col("toks"), fx.fixture_ner_tag),
                                               " ").alias("ner"))


def entity_groups(spark, sf_dir):
    return tk.entity_groups(_docs(spark, sf_dir), fx.fixture_ner_tag)


#: Every column of a token table is stored; its places as differences, its words by a dictionary that holds most of them.
STORED_TOKENS = {"compression": "zstd", "parquet.writer.version": "v2", "parquet.enable.dictionary#pos": "false",
                 "parquet.dictionary.page.size": str(8 << 20), "parquet.page.size": str(4 << 20),
                 "parquet.page.row.count.limit": str(1 << 20)}


def _token_table(spark, sf_dir):
    """The annotated tokens, stored as a user would have them."""
    return materialized(tk.token_table(_docs(spark, sf_dir), fx.TAGGERS), "tokens", **STORED_TOKENS)


def annotation_kinds(spark, sf_dir):
    """B15 from a stored token table: three kinds at once."""
    arrays = tk.annotations_of_table(_token_table(spark, sf_dir), tuple(fx.TAGGERS))
    return arrays.select("doc_id", F.size("tokens").cast("long").alias("n_tokens"),
                         *[F.array_join(k, " ").alias(k) for k in fx.TAGGERS])


def entity_groups_long(spark, sf_dir):
    """B16 from a stored token table."""
    return tk.entity_groups_of_table(_token_table(spark, sf_dir))


def nfd_code_points(spark, sf_dir):
    """B1, marks included: the length, the marks and a digest of every decomposed text."""
    d = _docs(spark, sf_dir).select("doc_id", normalized_text(F.col("text"), "NFD").alias("t"))
    return d.select("doc_id", F.length("t").cast("long").alias("n_points"),
                    F.length(F.regexp_replace("t", r"[^\u0300-\u036f]+", "")).cast("long").alias("n_marks"),
                    F.sha2("t", 256).alias("nfd_sha256"))


QUERIES = {
    "nfd_code_points": nfd_code_points,
    "nfd_normalize": nfd_normalize,
    "tokenize": tokenize,
    "token_offsets": token_offsets,
    "words_uncased": words_uncased,
    "token_slice": token_slice,
    "untokenize": untokenize,
    "token_count": token_count,
    "ngrams": ngrams,
    "filter_word": filter_word,
    "filter_ngram_any": _filter_ngram("any"),
    "filter_ngram_all": _filter_ngram("all"),
    "filter_ngram_ends": _filter_ngram("ends"),
    "parse_terms": parse_terms,
    "parse_unigrams": parse_unigrams,
    "normalize_answer": normalize_answer,
    "strip_whitespace": strip_whitespace,
    "annotation_arrays": annotation_arrays,
    "entity_groups": entity_groups,
    "annotation_kinds": annotation_kinds,
    "entity_groups_long": entity_groups_long,
}

# ---------------------------------------------------------------- oracle SQL

PY_SPACE_RE2 = (r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
                r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]")


def _py_strip(expr: str) -> str:
    return f"regexp_replace({expr}, '^{PY_SPACE_RE2}+|{PY_SPACE_RE2}+$', '', 'g')"


TOKS_CTE = f"""
segs AS (SELECT doc_id, unnest(s) AS seg, generate_subscripts(s, 1) AS i
         FROM (SELECT doc_id, regexp_extract_all(text, {lit(SEGMENT_PATTERN)}) AS s FROM documents)),
offs AS (SELECT doc_id, i, seg, CAST(coalesce(sum(length(seg)) OVER (PARTITION BY doc_id ORDER BY i
         ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM segs),
toks AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS pos, seg AS token,
         start, start + length(seg) AS "end" FROM offs WHERE NOT regexp_matches(seg, '^[\\p{{Z}}\\p{{C}}]'))"""

_WORDS = uncased(tokens("text"))


def _ngram_sql(w: str, n: int) -> str:
    return (f"flatten(list_transform(range(1, len({w}) + 1), lambda i: list_transform("
            f"range(1, least({n}, len({w}) - i + 1) + 1), lambda m: {w}[i:i + m - 1])))")


def _gram_filter(mode: str) -> str:
    f = filtered_word
    if mode == "any":
        return f"list_aggregate(list_transform(g, lambda x: {f('x')}), 'bool_or')"
    if mode == "all":
        return f"list_aggregate(list_transform(g, lambda x: {f('x')}), 'bool_and')"
    return f"({f('g[1]')} OR {f('g[len(g)]')})"


def _filter_ngram_sql(mode: str) -> str:
    return f"""
SELECT doc_id, len(k) AS n_kept, array_to_string(k, chr(1)) AS kept FROM (
  SELECT doc_id, list_transform(list_filter({_ngram_sql('w', NGRAM_N)}, lambda g: NOT {_gram_filter(mode)}),
         lambda g: array_to_string(g, ' ')) AS k
  FROM (SELECT doc_id, {_WORDS} AS w FROM documents))"""


_WORD_RE2 = r"[\p{L}\p{N}_]"
_PUNCT_RE2 = r"[!-/:-@\[-`{-~]"

NORMALIZE_SQL = f"""
SELECT doc_id, array_to_string(list_filter(regexp_split_to_array(
  array_to_string(list_transform(regexp_extract_all(
    regexp_replace(lower(text), '{_PUNCT_RE2}', '', 'g'), '{_WORD_RE2}+|[^\\p{{L}}\\p{{N}}_]+'),
    lambda r: CASE WHEN r IN ('a', 'an', 'the') THEN ' ' ELSE r END), ''),
  '{PY_SPACE_RE2}+'), lambda x: x <> ''), ' ') AS normalized
FROM documents"""

NER_SQL_TAG = ("CASE WHEN upper(left(token, 1)) = left(token, 1) AND lower(left(token, 1)) <> left(token, 1) "
               "THEN 'ENT' ELSE 'O' END")

ORACLE = {
    "nfd_normalize": "SELECT doc_id, strip_accents(text) AS folded FROM documents",
    "tokenize": f"""SELECT doc_id, len(t) AS n_tokens, array_to_string(t, ' ') AS tokens
        FROM (SELECT doc_id, {tokens('text')} AS t FROM documents)""",
    "token_offsets": f"WITH {TOKS_CTE} SELECT doc_id, pos, token, start, \"end\" FROM toks",
    "words_uncased": f"SELECT doc_id, array_to_string({_WORDS}, ' ') AS words FROM documents",
    "token_slice": f"""SELECT doc_id, array_to_string(t[3:7], ' ') AS head,
        array_to_string(t[greatest(len(t) - 4, 1):len(t)], ' ') AS tail
        FROM (SELECT doc_id, {tokens('text')} AS t FROM documents)""",
    "untokenize": f"""WITH {TOKS_CTE},
        n AS (SELECT doc_id, count(*) AS n, max("end") AS last_end FROM toks GROUP BY doc_id)
        SELECT d.doc_id, CASE WHEN a.start IS NULL THEN '' ELSE
          {_py_strip('substring(d.text, a.start + 1, coalesce(b.start, n.last_end) - a.start)')} END AS span,
          CASE WHEN f.start IS NULL THEN '' ELSE
          {_py_strip('substring(d.text, f.start + 1, n.last_end - f.start)')} END AS whole
        FROM documents d LEFT JOIN n USING (doc_id)
        LEFT JOIN toks f ON f.doc_id = d.doc_id AND f.pos = 0
        LEFT JOIN toks a ON a.doc_id = d.doc_id AND a.pos = {SLICE[0]}
        LEFT JOIN toks b ON b.doc_id = d.doc_id AND b.pos = {SLICE[1]}""",
    "token_count": f"SELECT doc_id, len({tokens('text')}) AS n_tokens FROM documents",
    "ngrams": f"""SELECT doc_id, len(g) AS n_grams, array_to_string(g, chr(1)) AS grams FROM (
        SELECT doc_id, list_transform({_ngram_sql('w', NGRAM_N)}, lambda x: array_to_string(x, ' ')) AS g
        FROM (SELECT doc_id, {_WORDS} AS w FROM documents))""",
    "filter_word": f"""SELECT token, {filtered_word('token')} AS dropped FROM (
        SELECT DISTINCT unnest({_WORDS}) AS token FROM documents)""",
    "filter_ngram_any": _filter_ngram_sql("any"),
    "filter_ngram_all": _filter_ngram_sql("all"),
    "filter_ngram_ends": _filter_ngram_sql("ends"),
    "parse_terms": f"""SELECT doc_id, array_to_string(list_transform(list_filter(
        {_ngram_sql('w', NGRAM_N)}, lambda g: NOT {_gram_filter('any')}), lambda g: array_to_string(g, ' ')),
        chr(1)) AS terms FROM (SELECT doc_id, {_WORDS} AS w FROM documents)""",
    "parse_unigrams": f"SELECT doc_id, array_to_string({terms('text')}, chr(1)) AS terms FROM documents",
    "normalize_answer": NORMALIZE_SQL,
    "strip_whitespace": f"SELECT doc_id, regexp_replace(text, '{PY_SPACE_RE2}+', '', 'g') AS stripped FROM documents",
    "annotation_arrays": f"""WITH {TOKS_CTE} SELECT d.doc_id, coalesce(string_agg({NER_SQL_TAG}, ' ' ORDER BY pos)
        FILTER (WHERE token IS NOT NULL), '') AS ner
        FROM documents d LEFT JOIN toks USING (doc_id) GROUP BY d.doc_id""",
    "entity_groups": f"""WITH {TOKS_CTE},
        tt AS (SELECT *, {NER_SQL_TAG} AS tag FROM toks),
        lg AS (SELECT *, lag(tag) OVER (PARTITION BY doc_id ORDER BY pos) AS prev FROM tt),
        isl AS (SELECT *, sum(CASE WHEN prev IS NULL OR prev <> tag THEN 1 ELSE 0 END)
                OVER (PARTITION BY doc_id ORDER BY pos) AS island FROM lg),
        runs AS (SELECT doc_id, island, any_value(tag) AS tag, min(pos) AS lo, max(pos) AS hi, min(start) AS s
                 FROM isl GROUP BY doc_id, island HAVING any_value(tag) <> 'O')
        SELECT r.doc_id, row_number() OVER (PARTITION BY r.doc_id ORDER BY r.lo) - 1 AS group_idx,
          {_py_strip('substring(d.text, r.s + 1, coalesce(nx.start, lt."end") - r.s)')} AS text, r.tag
        FROM runs r JOIN documents d ON d.doc_id = r.doc_id
        JOIN toks lt ON lt.doc_id = r.doc_id AND lt.pos = r.hi
        LEFT JOIN toks nx ON nx.doc_id = r.doc_id AND nx.pos = r.hi + 1""",
}
ORACLE["entity_groups_long"] = ORACLE["entity_groups"]
ORACLE["annotation_kinds"] = f"""WITH {TOKS_CTE},
    tt AS (SELECT doc_id, pos, CASE WHEN regexp_full_match(token, '\\p{{N}}+') THEN 'NUM'
        WHEN regexp_full_match(token, '\\p{{P}}+') THEN 'PUNCT' ELSE 'WORD' END AS pos_tag,
        regexp_replace(lower(token), 's$', '') AS lemma, {NER_SQL_TAG} AS ner FROM toks)
    SELECT doc_id, count(*) AS n_tokens, string_agg(pos_tag, ' ' ORDER BY pos) AS pos_tag,
    string_agg(lemma, ' ' ORDER BY pos) AS lemma, string_agg(ner, ' ' ORDER BY pos) AS ner FROM tt GROUP BY doc_id"""
# which letter and mark a character composes of, by composing them all (four marks are other names of some)
ORACLE["nfd_code_points"] = """WITH letters AS (SELECT chr(unnest(range(65, 91))::INTEGER) AS b UNION ALL SELECT chr(unnest(range(97, 123))::INTEGER)),
    marks AS (SELECT chr(k::INTEGER) AS k FROM (SELECT unnest(range(768, 880)) AS k) WHERE k NOT IN (832, 833, 835, 836)),
    parts AS (SELECT nfc_normalize(b || k) AS c, b || k AS d FROM letters, marks WHERE length(nfc_normalize(b || k)) = 1),
    chars AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), '')) AS c,
        unnest(range(len(string_split(coalesce(text, ''), '')))) AS i FROM documents),
    t AS (SELECT doc_id, string_agg(coalesce(d, chars.c), '' ORDER BY i) AS t FROM chars LEFT JOIN parts ON parts.c = chars.c GROUP BY doc_id)
    SELECT doc_id, length(t) AS n_points, length(regexp_replace(t, '[^\\x{300}-\\x{36f}]+', '', 'g')) AS n_marks,
    sha256(t) AS nfd_sha256 FROM t"""
