"""DuckDB SQL that states each registered query independently of Spark.

The SQL works on the raw (NFC) corpus: NFD changes the bytes of a term
but not which tokens exist, so ids, counts and scores are the same.
Lambdas use DuckDB's ``lambda x: ...`` form.
"""

from __future__ import annotations

from ..functions.constants import (BM25_B, BM25_K1, STOPWORDS, TOKEN_PATTERN)


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


STOP_LIST = "[" + ", ".join(lit(w) for w in STOPWORDS) + "]"


def tokens(text: str) -> str:
    return f"regexp_extract_all({text}, {lit(TOKEN_PATTERN)})"


def uncased(expr: str) -> str:
    return f"list_transform({expr}, lambda w: lower(w))"


def filtered_word(w: str) -> str:
    return f"(regexp_full_match({w}, '\\p{{P}}+') OR list_contains({STOP_LIST}, lower({w})))"


def terms(text: str) -> str:
    """Uncased unigrams with stop words and punctuation removed."""
    return f"list_filter({uncased(tokens(text))}, lambda w: NOT {filtered_word('w')})"


QUESTIONS_AND_BLANKS = r"""SELECT item_id AS query_id, text AS question FROM benchmark UNION ALL
    SELECT item_id + 1000000, regexp_replace(text, '[\p{L}\p{M}\p{N}]+', '', 'g') FROM benchmark"""

_U32 = "4294967295::HUGEINT"


def _rotl(x: str, r: int) -> str:
    return f"((({x} << {r}) | ({x} >> {32 - r})) & {_U32})"


def _times(x: str, factor: int) -> str:
    return f"(({x} * {factor}::HUGEINT) & {_U32})"


def _block(hex_digits: str) -> str:
    """Up to four bytes, given as hex digits, read little-endian."""
    byte = lambda i: f"coalesce(try_cast('0x' || nullif(substr({hex_digits}, {2 * i + 1}, 2), '') AS BIGINT), 0)"
    return "(" + " + ".join(f"{byte(i)} * {1 << (8 * i)}" for i in range(4)) + ")::HUGEINT"


def murmur3(text: str) -> str:
    """MurmurHash3 x86 32-bit with seed 0 (public algorithm) of the UTF-8 bytes."""
    mixed = lambda k: _times(_rotl(_times(k, 0xCC9E2D51), 15), 0x1B873593)
    digits = f"hex(encode({text}))"
    n = f"(octet_length(encode({text})))"
    body = (f"list_reduce(list_prepend(0::HUGEINT, list_transform(range(0, {n} // 4), "
            f"lambda i: {_block(f'substr({digits}, 8 * i + 1, 8)')})), "
            f"lambda h, k: (({_times(_rotl('xor(h, ' + mixed('k') + ')', 13), 5)} + 3864292196) & {_U32}))")
    tail = mixed(_block(f"substr({digits}, 8 * ({n} // 4) + 1, 6)"))
    out = f"xor(xor({body}, CASE WHEN {n} % 4 > 0 THEN {tail} ELSE 0::HUGEINT END), {n}::HUGEINT)"
    last = ("list_reduce([{0}, 2246822507::HUGEINT, 3266489909::HUGEINT], lambda h, f, i: "
            "((xor(h, h >> (CASE WHEN f = 2246822507 THEN 16 ELSE 13 END)) * f) & 4294967295::HUGEINT))").format(out)
    return f"list_reduce([{last}, 16::HUGEINT], lambda h, s: xor(h, h >> s::INTEGER))::BIGINT"


def index_ctes(doc_source: str = "documents") -> str:
    """CTEs ``doc_terms``, ``docs``, ``stats``, ``postings``."""
    return f"""
doc_terms AS (SELECT doc_id, {terms('text')} AS terms FROM {doc_source}),
docs AS (SELECT doc_id, len(terms) AS dl FROM doc_terms),
stats AS (SELECT count(*) AS n_docs, avg(dl) AS avgdl FROM docs),
postings AS (
  SELECT doc_id, term, count(*) AS tf, any_value(dl) AS dl
  FROM (SELECT doc_id, unnest(terms) AS term, len(terms) AS dl FROM doc_terms)
  GROUP BY doc_id, term)"""


def question_ctes(question_source: str = "benchmark") -> str:
    """CTEs ``questions`` and ``qterms``."""
    return f"""
questions AS (SELECT item_id AS query_id, text AS question, [text] AS answer FROM {question_source}),
qterms AS (
  SELECT query_id, term, count(*) AS qtf
  FROM (SELECT query_id, unnest({terms('question')}) AS term FROM questions)
  GROUP BY query_id, term)"""


def idf_expr(df: str = "df") -> str:
    return f"greatest(ln((n_docs - {df} + 0.5) / ({df} + 0.5)), 0.0)"


def bm25_part(k1: float = BM25_K1, b: float = BM25_B) -> str:
    return f"tf * {k1 + 1.0} / (tf + {k1} * (1.0 - {b} + {b} * dl / avgdl))"


def scores_cte(ranker: str = "bm25") -> str:
    """CTEs ``qidf``, ``qvec``, ``scores`` (needs index and question CTEs)."""
    if ranker == "bm25":
        qweight, dweight = "q.qtf", f"i.idf * {bm25_part()}"
    else:
        qweight, dweight = "ln(1 + q.qtf) * i.idf", "ln(1 + tf) * i.idf"
    return f"""
qidf AS (
  SELECT term, {idf_expr()} AS idf
  FROM (SELECT term, count(*) AS df FROM postings
        WHERE term IN (SELECT term FROM qterms) GROUP BY term), stats),
qvec AS (SELECT q.query_id, q.term, {qweight} AS qweight, i.idf FROM qterms q
         JOIN qidf i ON q.term = i.term WHERE i.idf > 0),
scores AS (
  SELECT query_id, doc_id, sum(qweight * {dweight.replace('i.idf', 'v.idf')}) AS score
  FROM postings p JOIN qvec v ON p.term = v.term, stats
  GROUP BY query_id, doc_id HAVING sum(qweight * {dweight.replace('i.idf', 'v.idf')}) > 0)"""


def topk_select(k: int, source: str = "scores") -> str:
    return f"""
SELECT query_id, rank, doc_id, score FROM (
  SELECT query_id, doc_id, round(score, 6) AS score,
         row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, doc_id) AS rank
  FROM {source}) WHERE rank <= {k}"""


def retrieval_sql(ranker: str, k: int) -> str:
    return ("WITH " + index_ctes() + "," + question_ctes() + "," + scores_cte(ranker)
            + topk_select(k))
