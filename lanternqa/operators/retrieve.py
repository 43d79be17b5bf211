"""Question vectors, sparse scoring and top-k documents.

Plan shape over a stored index (BM25, the same for TF-IDF):

1. question terms ``(query_id, term, qtf)`` - counted per question, hashed
   if the index is.
2. joined with the stored ``terms(term, df)``: idf of the question terms.
   Terms with idf 0 (in at least half of the documents) contribute nothing
   and are pruned here; they are also the most skewed keys.
3. ``postings JOIN question vector ON term`` - the postings are scanned
   once, the question side is broadcast if its bytes are few, else both
   sides are stored tables whose skewed partitions AQE splits.
4. ``groupBy(query_id, doc_id).sum`` - the postings are bucketed by
   ``doc_id``, so (with the broadcast join) the sums need no exchange.
5. ``row_number`` per question; Spark plans a partial
   ``WindowGroupLimit`` before the shuffle, so only k rows per question
   and partition move.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import with_parsed_terms
from ..session import materialized
from .index import TermIndex, bm25_tf_part, bucket_of, idf_column, normalized_text
from .joins import fits_broadcast

RANKERS = ("bm25", "tfidf")
SCORE_DIGITS = 6


def question_terms(questions: DataFrame, index: TermIndex, id_col: str = "query_id",
                   text_col: str = "question") -> DataFrame:
    """B11 on questions, counted: ``(query_id, term, qtf)``; bucket numbers for a hashed index."""
    text = normalized_text(F.col(text_col), index.unicode_form)
    base = questions.select(F.col(id_col).alias("query_id"), text.alias("_text"))
    parsed = with_parsed_terms(base, F.col("_text"), ("query_id",), index.ngram, index.mode)
    found = parsed.select("query_id", F.explode_outer("terms").alias("term")).where(F.col("term").isNotNull())
    if index.hash_size:
        found = found.select("query_id", bucket_of(F.col("term"), index.hash_size).cast("string").alias("term"))
    return found.groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("qtf"))


def empty_queries(questions: DataFrame, qterms: DataFrame, id_col: str = "query_id") -> DataFrame:
    """D3: questions without a single valid term."""
    return questions.join(qterms.select(F.col("query_id").alias(id_col)).distinct(),
                          id_col, "left_anti")


def check_empty_queries(questions: DataFrame, qterms: DataFrame, strict: bool,
                        id_col: str = "query_id") -> DataFrame:
    """D3 policy: strict raises on the first empty question, lenient reports them."""
    empty = empty_queries(questions, qterms, id_col)
    if strict:
        bad = empty.select(id_col).limit(1).collect()  # a probe of the question table
        if bad:
            raise RuntimeError(f"No valid word in question {bad[0][0]}")
    return empty


def query_vectors(qterms: DataFrame, index: TermIndex, ranker: str = "bm25",
                  small: bool | None = None) -> DataFrame:
    """``(query_id, term, qweight, idf)`` with zero-idf terms pruned.

    BM25 keeps the raw question counts; TF-IDF uses ``ln(1+qtf) * idf``.
    ``idf`` is carried along because the document side needs it once more.
    ``small`` says whether ``qterms`` passed the broadcast row check.
    """
    if ranker not in RANKERS:
        raise ValueError(f"unknown ranker: {ranker}")
    if small is None:
        small = fits_broadcast(qterms)
    term_idf = index.terms.join(F.broadcast(qterms) if small else qterms, "term") \
        .withColumn("idf", idf_column(F.col("df"), index.n_docs())).where(F.col("idf") > 0)
    if ranker == "bm25":
        weight = F.col("qtf").cast("double")
    else:
        weight = F.log1p("qtf") * F.col("idf")
    return term_idf.select("query_id", "term", weight.alias("qweight"), "idf")


def score_pairs(index: TermIndex, qvec: DataFrame, ranker: str = "bm25",
                small: bool = True) -> DataFrame:
    """Sparse dot product ``(query_id, doc_id, score)``, scores > 0 only.

    ``small``: the question vector is broadcast (it is no larger than the
    checked question terms); otherwise a shuffle join on ``term`` of two
    stored tables, where AQE splits the partitions of hot terms.
    """
    if ranker == "bm25":
        doc_weight = F.col("idf") * bm25_tf_part(F.col("tf"), F.col("dl"), index.avgdl(),
                                                index.k1, index.b)
    else:
        doc_weight = F.log1p("tf") * F.col("idf")
    joined = index.postings.join(F.broadcast(qvec) if small else materialized(qvec, "question-vectors"), "term")
    return (joined
            .groupBy("query_id", "doc_id")
            .agg(F.sum(F.col("qweight") * doc_weight).alias("score"))
            .where(F.col("score") > 0))


def top_k(scores: DataFrame, k: int, key: str = "query_id", item: str = "doc_id",
          score: str = "score") -> DataFrame:
    """First k items per key by score (rounded to 6 digits), ties by item id."""
    rounded = F.round(F.col(score), SCORE_DIGITS)
    w = Window.partitionBy(key).orderBy(rounded.desc(), F.col(item).asc())
    return (scores.withColumn("rank", F.row_number().over(w).cast("long"))
            .where(F.col("rank") <= k)
            .select(key, "rank", item, rounded.alias(score)))


def retrieve(index: TermIndex, questions: DataFrame, k: int = 5, ranker: str = "bm25",
             strict: bool = False, id_col: str = "query_id",
             text_col: str = "question") -> DataFrame:
    """Top-k documents for a whole question table in one job.

    With ``strict`` a question without a valid term raises; otherwise it has
    no rows here and ``empty_queries`` reports it.
    """
    qterms = materialized(question_terms(questions, index, id_col, text_col), "question-terms")
    if strict:
        check_empty_queries(questions, qterms, strict, id_col)
    small = fits_broadcast(qterms)
    scores = score_pairs(index, query_vectors(qterms, index, ranker, small), ranker, small)
    return top_k(scores, k)


def doc_index(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Contiguous 0-based ``doc_index`` for each ``doc_id`` (range order).

    The ids are range-partitioned and stored; rows are numbered within their
    partition and shifted by the rows of the partitions before it (one row
    per partition), so no task holds all ids.
    """
    ranged = docs.select(id_col).repartitionByRange(id_col).withColumn("_part", F.spark_partition_id())
    ordered = materialized(ranged, "doc-index")
    sizes = ordered.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    within = F.row_number().over(Window.partitionBy("_part").orderBy(id_col)) - 1
    return ordered.join(F.broadcast(before), "_part") \
        .select(id_col, (F.col("_before") + within).cast("long").alias("doc_index"))
