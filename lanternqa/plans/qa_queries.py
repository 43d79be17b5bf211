"""Registered queries for reading (E), linking (F) and evaluation (G).

Inputs: BM25 retrieval over the whole corpus for every benchmark item
(top 5 for evaluation, top 30 - the command-line default - for reading),
the arithmetic span scorer, and every ``embeddings`` vector both as a
mention and as a catalogue entry (leave-one-out).  Mentions are grouped
into questions of five consecutive vector ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.constants import (DOCS_PER_QUESTION, EMITTED_SPANS, ENTITY_CANDIDATES,
                                   EVAL_CUTOFF, MAX_ANSWER_TOKENS, N_BEST)
from ..operators import evaluate as ev
from ..operators import link as lk
from ..operators import pruned as pr
from ..operators import read as rd
from ..session import materialized
from . import fixtures as fx
from .oracle_sql import QUESTIONS_AND_BLANKS, retrieval_sql, tokens, uncased
from .text_queries import NORMALIZE_SQL

MENTIONS_PER_QUESTION = 5
HITS_K = 5


def _retrieved(spark, sf_dir, k, questions=None):
    """Top-k documents of every question, retrieved once: the small result table is stored."""
    from .catalog import corpus_segments
    questions = fx.questions(spark, sf_dir) if questions is None else questions
    return materialized(pr.retrieve_terms(corpus_segments(spark, sf_dir), questions, k, "bm25"), "retrieved")


# ------------------------------------------------------------------ G1-G5

def _hits(spark, sf_dir, match="string"):
    answers = fx.questions(spark, sf_dir)
    if match == "regex":  # the whole text's words, any white space or marks between them
        words_only = F.regexp_extract_all("question", F.lit(r"[\p{L}\p{N}\p{M}]+"), 0)
        joined = F.array_join(words_only, r"[^\p{L}\p{N}\p{M}]+")
        # texts of even length: with an inline flag, which only the regex package knows as answers have it
        inline = F.concat(F.lit("(?i:"), joined, F.lit(")"))
        answers = answers.select("query_id", F.array(
            F.when(F.length("question") % 2 == 0, inline).otherwise(joined)).alias("answer"))
    return ev.answer_hits(_retrieved(spark, sf_dir, EVAL_CUTOFF), fx.documents(spark, sf_dir),
                          answers, EVAL_CUTOFF, match)


def contains_tokens(spark, sf_dir):
    return _hits(spark, sf_dir, "string")


def contains_regex(spark, sf_dir):
    return _hits(spark, sf_dir, "regex")


def retrieval_hit(spark, sf_dir):
    return ev.retrieval_hits(_hits(spark, sf_dir), fx.questions(spark, sf_dir))


def retrieval_accuracy(spark, sf_dir):
    return ev.retrieval_accuracy(retrieval_hit(spark, sf_dir))


# ------------------------------------------------------------------ E1-E11

def _pairs(spark, sf_dir):
    return rd.reader_pairs(_retrieved(spark, sf_dir, DOCS_PER_QUESTION), fx.questions(spark, sf_dir),
                           fx.documents(spark, sf_dir))


def _scored(spark, sf_dir):
    enc = rd.pair_encoding(_pairs(spark, sf_dir))
    enc = enc.withColumn("doc_num", F.coalesce(F.col("doc_key").try_cast("long"), F.lit(0)))
    return rd.score_passages(enc, fx.fixture_start_logit, fx.fixture_end_logit, fx.fixture_relevance)


def _nbest(spark, sf_dir, max_len=MAX_ANSWER_TOKENS):
    scored = rd.materialize_passages(_scored(spark, sf_dir))
    return rd.nbest(rd.passage_spans(scored, max_len, N_BEST), N_BEST)


def reader_pairs(spark, sf_dir):
    return _pairs(spark, sf_dir).select("query_id", "passage_idx", "doc_key")


def reader_placeholder(spark, sf_dir):
    """Of the questions and their blank forms, those without any document."""
    questions = fx.questions_and_blanks(spark, sf_dir)
    found = _retrieved(spark, sf_dir, DOCS_PER_QUESTION, questions)
    pairs = rd.reader_pairs(found, questions, fx.documents(spark, sf_dir))
    return pairs.where(F.col("doc_key") == "pass").select("query_id", "passage_idx", "text")


def pair_encoding(spark, sf_dir):
    enc = rd.pair_encoding(_pairs(spark, sf_dir))
    return enc.select("query_id", "passage_idx", F.size("seq").cast("long").alias("n_seq"),
                      F.col("sep1").cast("long").alias("sep1"), F.col("sep2").cast("long").alias("sep2"),
                      F.array_join("seq", " ").alias("seq"))


def score_passages(spark, sf_dir):
    sc = _scored(spark, sf_dir)
    total = lambda c: F.round(F.aggregate(c, F.lit(0.0), lambda a, x: a + x), 6)
    return sc.select("query_id", "passage_idx", F.round("rel", 6).alias("rel"),
                     total("start_logits").alias("start_sum"), total("end_logits").alias("end_sum"))


def _model_scored(spark, sf_dir):
    return rd.score_passages_with(rd.pair_encoding(_pairs(spark, sf_dir)), fx.fixture_model)


def score_passages_model(spark, sf_dir):
    """E4 with a batch model that reads the tokens."""
    total = lambda c: F.round(F.aggregate(c, F.lit(0.0), lambda a, x: a + x), 6)
    return _model_scored(spark, sf_dir).select("query_id", "passage_idx", F.round("rel", 6).alias("rel"),
                                               total("start_logits").alias("start_sum"), total("end_logits").alias("end_sum"))


def span_sum_model(spark, sf_dir):
    """E5 to E11 over the batch model's logits."""
    scored = rd.materialize_passages(_model_scored(spark, sf_dir))
    nbest = rd.nbest(rd.passage_spans(scored, MAX_ANSWER_TOKENS, N_BEST), N_BEST)
    return _show_spans(rd.aggregate_spans(nbest, "sum", EMITTED_SPANS))


def span_scores(spark, sf_dir):
    """E5 + E6: each passage's best valid spans, cut to its n-best."""
    scored = rd.materialize_passages(_scored(spark, sf_dir))
    spans = rd.passage_spans(scored, MAX_ANSWER_TOKENS, N_BEST)
    w = Window.partitionBy("query_id", "passage_idx").orderBy(F.desc("logit"), "start_idx", "end_idx")
    return spans.withColumn("n", F.row_number().over(w)).where(F.col("n") <= N_BEST) \
        .select("query_id", "passage_idx", "start_idx", "end_idx", "logit", "span")


def span_nbest(spark, sf_dir):
    b = rd.require_spans(_nbest(spark, sf_dir), fx.questions(spark, sf_dir))
    return b.select("query_id", "nbest_rank", "passage_idx", "start_idx", "end_idx", "logit", "span")


def _show_spans(df: DataFrame) -> DataFrame:
    return df.select("query_id", "rank", "span", "score",
                     F.array_join("docs", " ").alias("docs"),
                     F.array_join(F.transform("start_idx", lambda x: x.cast("string")), " ").alias("starts"),
                     F.array_join(F.transform("end_idx", lambda x: x.cast("string")), " ").alias("ends"))


def span_sum(spark, sf_dir):
    return _show_spans(rd.aggregate_spans(_nbest(spark, sf_dir), "sum", EMITTED_SPANS))


def span_none(spark, sf_dir):
    return _show_spans(rd.aggregate_spans(_nbest(spark, sf_dir), "none", EMITTED_SPANS))


def reader_output(spark, sf_dir):
    """E11 with the function default of 10 answer tokens."""
    return _show_spans(rd.aggregate_spans(_nbest(spark, sf_dir, 10), "sum", EMITTED_SPANS))


def reader_hits(spark, sf_dir):
    preds = rd.aggregate_spans(_nbest(spark, sf_dir), "sum", EMITTED_SPANS)
    gold = fx.questions(spark, sf_dir).select("query_id", F.explode("answer").alias("span"))
    return ev.hits_at_k(preds, gold, HITS_K, item="span", normalize=True, lists=fx.questions(spark, sf_dir))


# ------------------------------------------------------------------ F1-F4

def _occurrences(spark, sf_dir):
    """F1 of the reader's output, stored: mentions read it more than once."""
    preds = rd.aggregate_spans(_nbest(spark, sf_dir), "sum", EMITTED_SPANS)
    return materialized(lk.occurrences(preds), "occurrences")


def _mentions(spark, sf_dir, occ=None):
    occ = _occurrences(spark, sf_dir) if occ is None else occ
    return lk.mention_spans(occ, fx.questions(spark, sf_dir), fx.documents(spark, sf_dir))


def occurrences(spark, sf_dir):
    return _occurrences(spark, sf_dir).select("query_id", "mention_idx", "pred_rank", F.col("occ").cast("long").alias("occ"),
                      "doc_key", F.col("start_idx").cast("long").alias("start_idx"),
                      F.col("end_idx").cast("long").alias("end_idx"))


def mention_spans(spark, sf_dir):
    return _mentions(spark, sf_dir).select("query_id", "mention_idx", "doc_key", "char_start", "char_end")


def mention_context(spark, sf_dir):
    return lk.mention_context(_mentions(spark, sf_dir)).select("query_id", "mention_idx", "id", "label", "label_id",
                                         "context_left", "mention", "context_right")


def mention_mismatch(spark, sf_dir):
    """F4 on mentions of which every second starts one token late: those are reported."""
    occ = _occurrences(spark, sf_dir)
    late = occ.withColumn("start_idx", F.col("start_idx") + F.col("mention_idx") % 2)
    return lk.mention_mismatch(lk.mention_context(_mentions(spark, sf_dir, late)))


# ------------------------------------------------------------------ F5-F8, G7-G9

def _vectors(spark, sf_dir):
    return fx.table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")


def dense_topk(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    return lk.dense_topk(v.select(F.col("vec_id").alias("mention_id"), "embedding"), v,
                         ENTITY_CANDIDATES, exclude_self=True)


def _candidates(spark, sf_dir):
    d = dense_topk(spark, sf_dir)
    q = F.floor(F.col("mention_id") / MENTIONS_PER_QUESTION).cast("long")
    return d.select(q.alias("query_id"), (F.col("mention_id") - q * MENTIONS_PER_QUESTION).alias("mention_idx"),
                    "rank", "entity_id")


def _index_map(spark, sf_dir):
    return _vectors(spark, sf_dir).select(F.col("vec_id").cast("string").alias("key"),
                                          F.concat(F.lit("E"), F.col("label").cast("string")).alias("value"))


def _gold(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    first = v.where(F.col("vec_id") == F.floor(F.col("vec_id") / MENTIONS_PER_QUESTION) * MENTIONS_PER_QUESTION)
    return first.select(F.floor(F.col("vec_id") / MENTIONS_PER_QUESTION).cast("long").alias("query_id"),
                        F.concat(F.lit("E"), F.col("label").cast("string")).alias("entity"))


def fuse_candidates(spark, sf_dir):
    return lk.fuse_candidates(_candidates(spark, sf_dir))


def map_entities(spark, sf_dir):
    return lk.map_entities(lk.fuse_candidates(_candidates(spark, sf_dir)), _index_map(spark, sf_dir))


def dedupe_entities(spark, sf_dir):
    return lk.dedupe_entities(map_entities(spark, sf_dir))


def entity_hits(spark, sf_dir):
    return ev.hits_at_k(dedupe_entities(spark, sf_dir), _gold(spark, sf_dir), HITS_K, item="entity",
                        lists=_gold(spark, sf_dir))


def entity_mrr(spark, sf_dir):
    return ev.mean_reciprocal_rank(dedupe_entities(spark, sf_dir), _gold(spark, sf_dir), item="entity",
                                   lists=_gold(spark, sf_dir))


def remap_predictions(spark, sf_dir):
    fused = lk.fuse_candidates(_candidates(spark, sf_dir))
    raw = fused.select("query_id", F.col("fused_rank").alias("rank"),
                       F.col("entity_id").cast("string").alias("entity"))
    return ev.remap_predictions(raw, _index_map(spark, sf_dir), item="entity")


QUERIES = {
    "contains_tokens": contains_tokens, "contains_regex": contains_regex,
    "retrieval_hit": retrieval_hit, "retrieval_accuracy": retrieval_accuracy,
    "reader_pairs": reader_pairs, "reader_placeholder": reader_placeholder,
    "pair_encoding": pair_encoding, "score_passages": score_passages,
    "score_passages_model": score_passages_model, "span_sum_model": span_sum_model,
    "span_scores": span_scores, "span_nbest": span_nbest, "span_sum": span_sum, "span_none": span_none,
    "reader_output": reader_output, "reader_hits": reader_hits,
    "occurrences": occurrences, "mention_spans": mention_spans,
    "mention_context": mention_context, "mention_mismatch": mention_mismatch,
    "dense_topk": dense_topk, "fuse_candidates": fuse_candidates,
    "map_entities": map_entities, "dedupe_entities": dedupe_entities,
    "entity_hits": entity_hits, "entity_mrr": entity_mrr, "remap_predictions": remap_predictions,
}

# ---------------------------------------------------------------- oracle SQL

_SEP1 = "chr(1)"


def _top(k: int) -> str:
    return f"top AS ({retrieval_sql('bm25', k)})"


HITS_SQL = f"""WITH {_top(EVAL_CUTOFF)},
pairs AS (SELECT t.query_id, t.rank, t.doc_id, {uncased(tokens('d.text'))} AS dw, {uncased(tokens('b.text'))} AS aw
          FROM top t JOIN documents d ON d.doc_id = t.doc_id JOIN benchmark b ON b.item_id = t.query_id),
hits AS (SELECT query_id, rank, doc_id, (len(aw) = 0 OR contains({_SEP1} || array_to_string(dw, {_SEP1}) || {_SEP1},
         {_SEP1} || array_to_string(aw, {_SEP1}) || {_SEP1})) AS hit FROM pairs)"""

REGEX_SQL = f"""WITH {_top(EVAL_CUTOFF)},
pat AS (SELECT query_id, CASE WHEN even THEN '(?i:' || w || ')' ELSE w END AS p FROM (
        SELECT item_id AS query_id, length(text) % 2 = 0 AS even, array_to_string(
        regexp_extract_all(text, '[\\p{{L}}\\p{{N}}\\p{{M}}]+'), '[^\\p{{L}}\\p{{N}}\\p{{M}}]+') AS w FROM benchmark))
SELECT t.query_id, t.rank, t.doc_id, coalesce(regexp_matches(d.text, '(?im)' || p.p), false) AS hit
FROM top t JOIN documents d ON d.doc_id = t.doc_id JOIN pat p ON p.query_id = t.query_id"""

L = MAX_ANSWER_TOKENS


def _reader_ctes(max_len: int = L) -> str:
    return f"""{_top(DOCS_PER_QUESTION)},
pass AS (SELECT t.query_id, t.rank - 1 AS passage_idx, CAST(t.doc_id AS VARCHAR) AS doc_key, t.doc_id AS doc_num,
         b.text AS question, d.text FROM top t JOIN benchmark b ON b.item_id = t.query_id
         JOIN documents d ON d.doc_id = t.doc_id),
enc AS (SELECT *, flatten([['[CLS]'], qw, ['[SEP]'], pw, ['[SEP]']]) AS seq, len(qw) + 1 AS sep1,
        len(qw) + len(pw) + 2 AS sep2
        FROM (SELECT *, {uncased(tokens('question'))} AS qw, {uncased(tokens('text'))} AS pw FROM pass)),
st AS (SELECT query_id, passage_idx, doc_key, doc_num, sep2, unnest(range(sep1 + 1, sep2)) AS i FROM enc),
sp AS (SELECT *, unnest(range(i, least(i + {max_len}, sep2))) AS j FROM st),
lg AS (SELECT query_id, passage_idx, doc_key, i AS start_idx, j AS end_idx,
       ((i * 37 + doc_num * 13) % 101) / 20.0::DOUBLE - 4.0::DOUBLE
             + (((j * 53 + doc_num * 7) % 97) / 20.0::DOUBLE - 4.0::DOUBLE)
             + (doc_num % 11) / 10.0::DOUBLE AS raw_logit FROM sp),
sc AS (SELECT *, round(raw_logit, 6) AS logit FROM lg),
nr AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id
       ORDER BY logit DESC, passage_idx, start_idx, end_idx) AS nbest_rank FROM sc) WHERE nbest_rank <= {N_BEST}),
nb AS (SELECT nr.*, array_to_string(enc.seq[nr.start_idx + 1:nr.end_idx + 1], ' ') AS span
       FROM nr JOIN enc ON enc.query_id = nr.query_id AND enc.passage_idx = nr.passage_idx)"""


def _agg_sql(mode: str, max_len: int = L) -> str:
    if mode == "sum":
        grouped = """SELECT query_id, span, sum(exp(raw_logit)) AS score, min(nbest_rank) AS first,
            string_agg(doc_key, ' ' ORDER BY nbest_rank) AS docs,
            string_agg(CAST(start_idx AS VARCHAR), ' ' ORDER BY nbest_rank) AS starts,
            string_agg(CAST(end_idx AS VARCHAR), ' ' ORDER BY nbest_rank) AS ends FROM nb GROUP BY query_id, span"""
    else:
        grouped = """SELECT query_id, span, exp(raw_logit) AS score, nbest_rank AS first, doc_key AS docs,
            CAST(start_idx AS VARCHAR) AS starts, CAST(end_idx AS VARCHAR) AS ends FROM nb"""
    return f"""WITH {_reader_ctes(max_len)}, agg AS ({grouped}),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, first) AS rank FROM agg)
SELECT query_id, rank, span, round(score, 6) AS score, docs, starts, ends FROM ranked WHERE rank <= {EMITTED_SPANS}"""


def _norm(expr: str) -> str:
    return NORMALIZE_SQL.replace("SELECT doc_id, ", "SELECT ").replace("lower(text)", f"lower({expr})") \
        .replace("AS normalized\nFROM documents", "").strip()


_SPAN_SUM_CTE = _agg_sql("sum").replace(
    "SELECT query_id, rank, span, round(score, 6) AS score, docs, starts, ends FROM ranked WHERE rank <= 30",
    "")

VEC_SQL = """WITH cand AS (SELECT mention_id, rank, entity_id, score FROM (
  SELECT m.vec_id AS mention_id, c.vec_id AS entity_id,
         round(list_inner_product(CAST(m.embedding AS DOUBLE[]), CAST(c.embedding AS DOUBLE[])), 6) AS score,
         row_number() OVER (PARTITION BY m.vec_id ORDER BY round(list_inner_product(
           CAST(m.embedding AS DOUBLE[]), CAST(c.embedding AS DOUBLE[])), 6) DESC, c.vec_id) AS rank
  FROM embeddings m JOIN embeddings c ON m.vec_id <> c.vec_id) WHERE rank <= 30),
cq AS (SELECT mention_id // 5 AS query_id, mention_id - (mention_id // 5) * 5 AS mention_idx, rank, entity_id FROM cand),
fused AS (SELECT query_id, mention_idx, rank, entity_id,
          row_number() OVER (PARTITION BY query_id ORDER BY rank, mention_idx) AS fused_rank FROM cq),
imap AS (SELECT CAST(vec_id AS VARCHAR) AS key, 'E' || CAST(label AS VARCHAR) AS value FROM embeddings),
mapped AS (SELECT f.query_id, f.fused_rank, i.value AS entity FROM fused f JOIN imap i ON i.key = CAST(f.entity_id AS VARCHAR)),
dedup AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY first) AS rank, entity FROM
          (SELECT query_id, entity, min(fused_rank) AS first FROM mapped GROUP BY query_id, entity)),
gold AS (SELECT vec_id // 5 AS query_id, 'E' || CAST(label AS VARCHAR) AS entity FROM embeddings
         WHERE vec_id = (vec_id // 5) * 5)"""

ORACLE = {
    "contains_tokens": HITS_SQL + " SELECT query_id, rank, doc_id, hit FROM hits",
    "contains_regex": REGEX_SQL,
    "retrieval_hit": HITS_SQL + """ SELECT b.item_id AS query_id, coalesce(max(CAST(hit AS INTEGER)), 0)::BIGINT AS hit
        FROM benchmark b LEFT JOIN hits h ON h.query_id = b.item_id GROUP BY b.item_id""",
    "retrieval_accuracy": HITS_SQL + """, per AS (SELECT b.item_id, coalesce(max(CAST(hit AS INTEGER)), 0) AS hit
        FROM benchmark b LEFT JOIN hits h ON h.query_id = b.item_id GROUP BY b.item_id)
        SELECT count(*) AS total, CAST(coalesce(sum(hit), 0) AS BIGINT) AS matches,
        round(CASE WHEN count(*) = 0 THEN NULL ELSE coalesce(sum(hit), 0) * 100.0 / count(*) END, 6) AS accuracy FROM per""",
    "reader_pairs": f"WITH {_reader_ctes()} SELECT query_id, passage_idx, doc_key FROM pass",
    "reader_placeholder": f"""WITH {_top(DOCS_PER_QUESTION)}, q AS ({QUESTIONS_AND_BLANKS})
        SELECT query_id, CAST(0 AS BIGINT) AS passage_idx, 'pass' AS text FROM q
        WHERE query_id NOT IN (SELECT query_id FROM top)""",
    "span_scores": f"""WITH {_reader_ctes()}, pn AS (SELECT * FROM (SELECT *, row_number() OVER (
        PARTITION BY query_id, passage_idx ORDER BY logit DESC, start_idx, end_idx) AS n FROM sc) WHERE n <= {N_BEST})
        SELECT pn.query_id, pn.passage_idx, start_idx, end_idx, logit,
        array_to_string(enc.seq[start_idx + 1:end_idx + 1], ' ') AS span
        FROM pn JOIN enc ON enc.query_id = pn.query_id AND enc.passage_idx = pn.passage_idx""",
    "pair_encoding": f"""WITH {_reader_ctes()} SELECT query_id, passage_idx, len(seq) AS n_seq, sep1, sep2,
        array_to_string(seq, ' ') AS seq FROM enc""",
    "score_passages": f"""WITH {_reader_ctes()} SELECT query_id, passage_idx, round((doc_num % 11) / 10.0::DOUBLE, 6) AS rel,
        round(list_sum(list_transform(range(0, len(seq)), lambda t: ((t * 37 + doc_num * 13) % 101) / 20.0::DOUBLE - 4.0::DOUBLE)), 6) AS start_sum,
        round(list_sum(list_transform(range(0, len(seq)), lambda t: ((t * 53 + doc_num * 7) % 97) / 20.0::DOUBLE - 4.0::DOUBLE)), 6) AS end_sum
        FROM enc""",
    "span_nbest": f"""WITH {_reader_ctes()} SELECT query_id, nbest_rank, passage_idx, start_idx, end_idx, logit, span FROM nb""",
    "span_sum": _agg_sql("sum"),
    "span_none": _agg_sql("none"),
    "reader_output": _agg_sql("sum", 10),
    "reader_hits": _SPAN_SUM_CTE + f""",
        p AS (SELECT query_id, ({_norm('span')}) AS v FROM ranked WHERE rank <= {HITS_K}),
        g AS (SELECT item_id AS query_id, ({_norm('text')}) AS v FROM benchmark)
        SELECT total, hits, round(hits * 100.0 / total, 6) AS hits_at_k FROM (
          SELECT (SELECT count(*) FROM benchmark) AS total,
          (SELECT count(DISTINCT p.query_id) FROM p JOIN g ON p.query_id = g.query_id AND p.v = g.v) AS hits)""",
    "dense_topk": VEC_SQL + " SELECT mention_id, rank, entity_id, score FROM cand",
    "fuse_candidates": VEC_SQL + " SELECT query_id, mention_idx, rank, entity_id, fused_rank FROM fused",
    "map_entities": VEC_SQL + " SELECT query_id, fused_rank, entity FROM mapped",
    "dedupe_entities": VEC_SQL + " SELECT query_id, rank, entity FROM dedup",
    "entity_hits": VEC_SQL + f""", h AS (SELECT DISTINCT d.query_id FROM dedup d JOIN gold g
          ON d.query_id = g.query_id AND d.entity = g.entity WHERE d.rank <= {HITS_K})
        SELECT total, hits, round(hits * 100.0 / total, 6) AS hits_at_k FROM (
          SELECT (SELECT count(*) FROM gold) AS total, (SELECT count(*) FROM h) AS hits)""",
    "entity_mrr": VEC_SQL + """, best AS (SELECT d.query_id, min(d.rank) AS r FROM dedup d JOIN gold g
          ON d.query_id = g.query_id AND d.entity = g.entity GROUP BY d.query_id)
        SELECT count(*) AS total, round(avg(coalesce(1.0 / b.r, 0.0)), 6) AS mrr
        FROM gold q LEFT JOIN best b ON b.query_id = q.query_id""",
    "remap_predictions": VEC_SQL + """ SELECT f.query_id, row_number() OVER (PARTITION BY f.query_id ORDER BY f.fused_rank) AS rank,
        i.value AS entity FROM fused f JOIN imap i ON i.key = CAST(f.entity_id AS VARCHAR)""",
}


# the model's logits by token, joined to the spans' ends
_MODEL_CTES = _reader_ctes().split("st AS (")[0] + f"""
ml AS (SELECT *, list_transform(seq, lambda t, i: (37 * length(t) + 13 * unicode(t) + i - 1) % 101 / 20.0::DOUBLE - 4.0::DOUBLE) AS sl,
       list_transform(seq, lambda t, i: (53 * length(t) + 7 * unicode(t[-1]) + i - 1) % 97 / 20.0::DOUBLE - 4.0::DOUBLE) AS el,
       (len(seq) % 11) / 10.0::DOUBLE AS rel FROM enc),
tl AS MATERIALIZED (SELECT query_id, passage_idx, doc_key, sep1, sep2, rel, unnest(range(len(seq))) AS i, unnest(sl) AS s, unnest(el) AS e FROM ml),
sp AS (SELECT *, unnest(range(i, least(i + {L}, sep2))) AS j FROM tl WHERE i > sep1 AND i < sep2),
lg AS (SELECT a.query_id, a.passage_idx, a.doc_key, a.i AS start_idx, a.j AS end_idx, a.s + b.e + a.rel AS raw_logit
       FROM sp a JOIN tl b ON b.query_id = a.query_id AND b.passage_idx = a.passage_idx AND b.i = a.j),
sc AS (""" + _reader_ctes().split("sc AS (")[1]
ORACLE["score_passages_model"] = f"""WITH {_MODEL_CTES.split("tl AS MATERIALIZED")[0].rstrip().rstrip(",")}
    SELECT query_id, passage_idx, round(rel, 6) AS rel, round(list_sum(sl), 6) AS start_sum, round(list_sum(el), 6) AS end_sum FROM ml"""
ORACLE["span_sum_model"] = _agg_sql("sum").replace(_reader_ctes(), _MODEL_CTES)


_OCC_SQL = _SPAN_SUM_CTE + """,
occ0 AS (SELECT r.query_id, r.rank AS pred_rank, n.doc_key, n.start_idx, n.end_idx,
         row_number() OVER (PARTITION BY r.query_id, r.rank ORDER BY n.nbest_rank) - 1 AS occ
         FROM ranked r JOIN nb n ON n.query_id = r.query_id AND n.span = r.span WHERE r.rank <= 30),
occ AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY pred_rank, occ) - 1 AS mention_idx,
        pred_rank, occ, doc_key, start_idx, end_idx FROM occ0)"""


def _mention_ctes(start: str = "o.start_idx") -> str:
    """CTE ``ment``: the mentions with their character spans and document texts."""
    from .text_queries import TOKS_CTE
    mentioned = TOKS_CTE.replace("FROM documents)", "FROM documents WHERE doc_id IN (SELECT CAST(doc_key AS BIGINT) FROM occ))")
    return _OCC_SQL.replace("nb AS (", "nb AS MATERIALIZED (").replace("occ AS (", "occ AS MATERIALIZED (") + "," + mentioned + f""",
ms AS (SELECT o.* EXCLUDE (start_idx), {start} AS start_idx, len({tokens('b.text')}) AS qlen
       FROM occ o JOIN benchmark b ON b.item_id = o.query_id),
ment AS (SELECT ms.query_id, ms.mention_idx, ms.doc_key, r.span, a.start AS char_start, z."end" AS char_end, d.text FROM ms
JOIN ranked r ON r.query_id = ms.query_id AND r.rank = ms.pred_rank
JOIN documents d ON d.doc_id = CAST(ms.doc_key AS BIGINT)
LEFT JOIN toks a ON a.doc_id = CAST(ms.doc_key AS BIGINT) AND a.pos = ms.start_idx - ms.qlen - 2
LEFT JOIN toks z ON z.doc_id = CAST(ms.doc_key AS BIGINT) AND z.pos = ms.end_idx - ms.qlen - 2),
ctx AS (SELECT query_id, mention_idx, span, lower(substring(text, 1, char_start)) AS context_left,
        lower(substring(text, char_start + 1, greatest(char_end - char_start, 0))) AS mention,
        lower(substring(text, char_end + 1)) AS context_right FROM ment)"""


def _stripped(expr: str) -> str:
    from .text_queries import PY_SPACE_RE2
    return f"regexp_replace({expr}, '{PY_SPACE_RE2}+', '', 'g')"


ORACLE["occurrences"] = _OCC_SQL + " SELECT * FROM occ"
ORACLE["mention_spans"] = _mention_ctes() + " SELECT query_id, mention_idx, doc_key, char_start, char_end FROM ment"
ORACLE["mention_context"] = _mention_ctes() + """ SELECT query_id, mention_idx, 0::BIGINT AS id, 'unknown' AS label,
    (-1)::BIGINT AS label_id, context_left, mention, context_right FROM ctx"""
ORACLE["mention_mismatch"] = _mention_ctes("o.start_idx + o.mention_idx % 2") + f""" SELECT query_id, mention_idx, span, mention
    FROM ctx WHERE {_stripped('span')} <> {_stripped('mention')}"""
