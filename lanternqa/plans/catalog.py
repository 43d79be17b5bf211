"""Registered queries: ``name -> (spark, sf_dir) -> DataFrame``.

Every query reads the driver tables (or what Spark derives from them)
in full; there are no id subsets, prefixes or row caps.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.constants import DOCS_PER_QUESTION, EVAL_CUTOFF
from ..operators import index as ix
from ..operators import pruned as pr
from ..operators import retrieve as rt
from ..session import scratch_path
from ..sources import index_store, segments
from . import fixtures as fx
from . import oracle_sql as osql
from . import qa_queries, source_queries, text_queries

Query = Callable[[SparkSession, str], DataFrame]


def corpus_index(spark: SparkSession, sf_dir: str, unicode_form: str | None = "NFD",
                 ngram: int = 1, mode: str = "any", stored: bool = True) -> ix.TermIndex:
    """The corpus index; stored once under the shared checkpoint folder.

    One pass over the text builds the postings; retrieval and the weights
    read the stored tables.
    """
    index = ix.build_index(fx.documents(spark, sf_dir), ngram=ngram, mode=mode,
                           unicode_form=unicode_form)
    return index_store.save_index(index, scratch_path(spark, "index")) if stored else index


def corpus_segments(spark: SparkSession, sf_dir: str, unicode_form: str | None = "NFD") -> segments.SegmentIndex:
    """The corpus as a stored index of one segment, by which questions are answered."""
    return segments.build_segments(fx.documents(spark, sf_dir), scratch_path(spark, "segments"), unicode_form=unicode_form)


def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top-5 BM25 documents for every benchmark question (flagship)."""
    return pr.retrieve_terms(corpus_segments(spark, sf_dir), fx.questions(spark, sf_dir), EVAL_CUTOFF, "bm25")


def tfidf_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pr.retrieve_terms(corpus_segments(spark, sf_dir), fx.questions(spark, sf_dir), EVAL_CUTOFF, "tfidf")


def batch_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D6 with the command-line default of 30 documents per question."""
    return pr.retrieve_terms(corpus_segments(spark, sf_dir), fx.questions(spark, sf_dir), DOCS_PER_QUESTION, "bm25")


def bounded_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D5 by bounds on ranges of documents: the same rows as ``bm25_topk``."""
    return pr.retrieve_bounded(corpus_segments(spark, sf_dir), fx.questions(spark, sf_dir), EVAL_CUTOFF, "bm25")


def best_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first document of every question, where the bounds leave most ranges unread."""
    return pr.retrieve_bounded(corpus_segments(spark, sf_dir), fx.questions(spark, sf_dir), 1, "tfidf")


#: Added to a document's id for the copy that ``segment_index`` deletes again.
STALE_ID = 1_000_000_000


def segment_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A10: the corpus in two segments, with a stale copy of every document that is deleted: all four tables.

    Rows are postings, terms, documents and one of totals, as of an index built at once.
    """
    docs = fx.documents(spark, sf_dir)
    stale = docs.select((F.col("doc_id") + STALE_ID).alias("doc_id"), F.concat("text", F.lit(" stale copy")).alias("text"))
    short = F.length("text") < 1500
    path = scratch_path(spark, "segments")
    built = segments.build_segments(docs.where(short).unionByName(stale.where(short)), path, unicode_form=None)
    built.append(docs.where(~short).unionByName(stale.where(~short))).delete(stale)
    index = segments.open_index(spark, path)
    null = F.lit(None)
    totals = spark.range(1).select(F.lit(index.n).cast("long").alias("n"), F.lit(index.total).cast("long").alias("dl"))
    return index.postings.select(F.lit("posting").alias("kind"), "term", "doc_id", F.col("tf").alias("n"), "dl") \
        .unionByName(index.terms.select(F.lit("term").alias("kind"), "term", null.cast("long").alias("doc_id"),
                                        F.col("df").alias("n"), null.cast("long").alias("dl"))) \
        .unionByName(index.docs.select(F.lit("document").alias("kind"), null.cast("string").alias("term"), "doc_id",
                                       null.cast("long").alias("n"), "dl")) \
        .unionByName(totals.select(F.lit("totals").alias("kind"), null.cast("string").alias("term"),
                                   null.cast("long").alias("doc_id"), "n", "dl"))


# --- C: index build.  Term strings are shown as stored (NFC corpus), so
# these use no Unicode normalisation; NFD is checked by ``nfd_normalize``.

def _raw_index(spark: SparkSession, sf_dir: str) -> ix.TermIndex:
    return corpus_index(spark, sf_dir, unicode_form=None, stored=False)


def _stored_index(spark: SparkSession, sf_dir: str) -> ix.TermIndex:
    return corpus_index(spark, sf_dir, unicode_form=None)


def term_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ix.term_counts(_raw_index(spark, sf_dir))


def doc_freqs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ix.doc_freqs(_raw_index(spark, sf_dir))


def doc_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ix.doc_lengths(_raw_index(spark, sf_dir))


def corpus_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    st = ix.corpus_stats(_raw_index(spark, sf_dir))
    return st.select("n_docs", F.round("avgdl", 6).alias("avgdl"))


def idf(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = ix.idf(_raw_index(spark, sf_dir))
    return t.select("term", "df", F.round("idf", 6).alias("idf"))


def tfidf_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = ix.tfidf_weights(_stored_index(spark, sf_dir))
    return w.select("term", "doc_id", F.round("weight", 6).alias("weight"))


def bm25_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = ix.bm25_weights(_stored_index(spark, sf_dir))
    return w.select("term", "doc_id", F.round("weight", 6).alias("weight"))


HASH_SIZE = 1 << 20  # buckets of the registered hashed queries
WIDE_HASH = 1 << 32  # one bucket for each hash value


def hash_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every distinct term with its bucket."""
    terms = ix.doc_freqs(_raw_index(spark, sf_dir)).select("term")
    return ix.hash_terms(terms, HASH_SIZE)


def hashed_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C8 with 2**20 buckets: ``(bucket, doc_id, tf)``."""
    h = ix.hashed_index(_raw_index(spark, sf_dir), HASH_SIZE)
    return h.postings.select(F.col("term").cast("long").alias("bucket"), "doc_id", "tf")


def hashed_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D6 over the hashed index: documents and questions are hashed alike."""
    hashed = ix.hashed_index(corpus_index(spark, sf_dir, stored=False), WIDE_HASH)
    index = index_store.save_index(hashed, scratch_path(spark, "hashed-index"))
    return rt.retrieve(index, fx.questions(spark, sf_dir), k=EVAL_CUTOFF, ranker="bm25")


# --- D: retrieval pieces ---

def _stored_questions(spark: SparkSession, sf_dir: str):
    index = _stored_index(spark, sf_dir)
    return index, rt.question_terms(fx.questions(spark, sf_dir), index)


def query_vec_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    qterms = rt.question_terms(fx.questions(spark, sf_dir), _raw_index(spark, sf_dir))
    return qterms.select("query_id", "term", F.col("qtf").cast("double").alias("weight"))


def query_vec_tfidf(spark: SparkSession, sf_dir: str) -> DataFrame:
    index, qterms = _stored_questions(spark, sf_dir)
    vec = rt.query_vectors(qterms, index, "tfidf")
    return vec.select("query_id", "term", F.round("qweight", 6).alias("weight"))


def empty_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D3's report: the questions and, for each, one that holds its punctuation only."""
    questions = fx.questions_and_blanks(spark, sf_dir)
    qterms = rt.question_terms(questions, _raw_index(spark, sf_dir))
    return rt.empty_queries(questions, qterms).select("query_id")


def score_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = corpus_segments(spark, sf_dir)
    scores = pr.score_terms(index, pr.question_vectors(index, fx.questions(spark, sf_dir)))
    return scores.select("query_id", "doc_id", F.round("score", 6).alias("score"))


def doc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rt.doc_index(fx.documents(spark, sf_dir, parsed=False))


QUERIES: dict[str, Query] = {
    "bm25_topk": bm25_topk,
    "tfidf_topk": tfidf_topk,
    "batch_topk": batch_topk,
    "bounded_topk": bounded_topk,
    "best_document": best_document,
    "segment_index": segment_index,
    "term_counts": term_counts,
    "doc_freqs": doc_freqs,
    "doc_lengths": doc_lengths,
    "corpus_stats": corpus_stats,
    "idf": idf,
    "tfidf_weights": tfidf_weights,
    "bm25_weights": bm25_weights,
    "hash_terms": hash_terms,
    "hashed_index": hashed_index,
    "hashed_topk": hashed_topk,
    "query_vec_bm25": query_vec_bm25,
    "query_vec_tfidf": query_vec_tfidf,
    "empty_queries": empty_queries,
    "score_pairs": score_pairs,
    "doc_index": doc_index,
}

_IX = "WITH " + osql.index_ctes()
_IXQ = _IX + "," + osql.question_ctes()

ORACLE: dict[str, str] = {
    "bm25_topk": osql.retrieval_sql("bm25", EVAL_CUTOFF),
    "tfidf_topk": osql.retrieval_sql("tfidf", EVAL_CUTOFF),
    "batch_topk": osql.retrieval_sql("bm25", DOCS_PER_QUESTION),
    "bounded_topk": osql.retrieval_sql("bm25", EVAL_CUTOFF),
    "best_document": osql.retrieval_sql("tfidf", 1),
    "segment_index": _IX + """ SELECT 'posting' AS kind, term, doc_id, tf AS n, dl FROM postings
        UNION ALL SELECT 'term', term, NULL, count(*), NULL FROM postings GROUP BY term
        UNION ALL SELECT 'document', NULL, doc_id, NULL, dl FROM docs
        UNION ALL SELECT 'totals', NULL, NULL, count(*), sum(dl)::BIGINT FROM docs""",
    "term_counts": _IX + " SELECT term, doc_id, tf FROM postings",
    "doc_freqs": _IX + " SELECT term, count(*) AS df FROM postings GROUP BY term",
    "doc_lengths": _IX + " SELECT doc_id, dl FROM docs",
    "corpus_stats": _IX + " SELECT n_docs, round(avgdl, 6) AS avgdl FROM stats",
    "idf": _IX + f""" SELECT term, df, round({osql.idf_expr()}, 6) AS idf
        FROM (SELECT term, count(*) AS df FROM postings GROUP BY term), stats""",
    "tfidf_weights": _IX + f""" SELECT p.term, p.doc_id, round(ln(1 + p.tf) * i.idf, 6) AS weight
        FROM postings p JOIN (SELECT term, {osql.idf_expr()} AS idf
        FROM (SELECT term, count(*) AS df FROM postings GROUP BY term), stats) i ON p.term = i.term""",
    "bm25_weights": _IX + f""" SELECT p.term, p.doc_id, round(i.idf * {osql.bm25_part()}, 6) AS weight
        FROM postings p JOIN (SELECT term, {osql.idf_expr()} AS idf
        FROM (SELECT term, count(*) AS df FROM postings GROUP BY term), stats) i ON p.term = i.term, stats""",
    "query_vec_bm25": _IXQ + " SELECT query_id, term, CAST(qtf AS DOUBLE) AS weight FROM qterms",
    "query_vec_tfidf": _IXQ + "," + osql.scores_cte("tfidf")
        + " SELECT query_id, term, round(qweight, 6) AS weight FROM qvec",
    "hash_terms": _IX + f""" SELECT term, {osql.murmur3('term')} % {HASH_SIZE} AS bucket
        FROM (SELECT DISTINCT term FROM postings)""",
    "hashed_index": _IX + f""", h AS (SELECT term, {osql.murmur3('term')} % {HASH_SIZE} AS bucket
        FROM (SELECT DISTINCT term FROM postings))
        SELECT h.bucket, p.doc_id, CAST(sum(p.tf) AS BIGINT) AS tf FROM postings p JOIN h ON h.term = p.term
        GROUP BY h.bucket, p.doc_id""",
    "hashed_topk": osql.retrieval_sql("bm25", EVAL_CUTOFF),
    "empty_queries": f"""WITH q AS ({osql.QUESTIONS_AND_BLANKS})
        SELECT query_id FROM q WHERE len({osql.terms('question')}) = 0""",
    "score_pairs": osql.retrieval_sql("bm25", 0).split("SELECT query_id, rank")[0]
        + " SELECT query_id, doc_id, round(score, 6) AS score FROM scores",
    "doc_index": "SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS doc_index FROM documents",
}
ORACLE["index_roundtrip"] = ORACLE["term_counts"]


def _register(queries: dict, oracle: dict) -> None:
    QUERIES.update(queries)
    ORACLE.update(oracle)


_register(text_queries.QUERIES, text_queries.ORACLE)
_register(qa_queries.QUERIES, qa_queries.ORACLE)
_register(source_queries.QUERIES, source_queries.ORACLE)
