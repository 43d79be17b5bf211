"""D4 / D5 over a segment index: only the questions' parts, only the ranges that can matter.

``score_terms`` reads the parts that hold question terms: the join is on
(part, term), the question side is broadcast behind a check of its bytes,
and Spark prunes the part folders by it at run time.  The blocks, each with
its questions, are then dealt out by range, and scores are added up where
the range's documents are: a task's sums don't grow with the corpus, and no
pair of question and document is moved before the cut to k.

``retrieve_bounded`` reads less of them.  A block's largest count and
smallest length bound the weight of all its documents; summed over a
question's terms they bound the score of every document of a range.  The
``SEEDS`` ranges of the highest bounds are scored first; the k-th best score
found there is one the answer has to reach, so a range with a lower bound
is never read.  Results are those of the full product, ties included.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialized
from ..sources.segments import SegmentIndex, part_of
from .index import bm25_tf_part, idf_column
from .joins import BROADCAST_MAX_BYTES, fits_broadcast
from .retrieve import RANKERS, question_terms, top_k

SEEDS = 2
MARGIN = 2e-6  # ranks are by scores rounded to six digits
RANGE = ("seg", "range")
CELL = (*RANGE, "bucket")
BUCKET_QUESTIONS = 256  # about; a block meets the questions of a bucket as one row
DOCS_PER_TASK = 2048
RANGES_MAX_BYTES = 2 << 20  # the ranges of all questions grow with the documents


def _weight(index: SegmentIndex, ranker: str, tf: str, dl: str) -> Column:
    """Rises with the count and falls with the length."""
    if ranker == "tfidf":
        return F.log1p(tf) * F.col("idf")
    avgdl = F.lit(index.total / index.n if index.n else 1.0)
    return F.col("idf") * bm25_tf_part(F.col(tf), F.col(dl), avgdl, index.k1, index.b)


def _small(df: DataFrame, max_bytes: int = BROADCAST_MAX_BYTES) -> DataFrame:
    return F.broadcast(df) if fits_broadcast(df, max_bytes) else df


def question_vectors(index: SegmentIndex, questions: DataFrame, ranker: str = "bm25", id_col: str = "query_id",
                     text_col: str = "question") -> DataFrame:
    """``(query_id, part, term, qweight, idf)``, stored; terms without weight are left out."""
    if ranker not in RANKERS:
        raise ValueError(f"unknown ranker: {ranker}")
    terms = materialized(question_terms(questions, index, id_col, text_col), "question-terms")
    known = index.terms.join(_small(terms), "term").withColumn("idf", idf_column(F.col("df"), F.lit(index.n)))
    weight = F.col("qtf").cast("double") if ranker == "bm25" else F.log1p("qtf") * F.col("idf")
    return materialized(known.where(F.col("idf") > 0).select(
        "query_id", part_of(F.col("term"), index.parts).alias("part"), "term", weight.alias("qweight"), "idf"),
        "question-vectors")


def _asked(index: SegmentIndex, vectors: DataFrame) -> DataFrame:
    """The blocks of the questions' terms, each with its ``asked`` questions of a ``bucket``; other parts aren't read."""
    held = vectors.where(F.col("idf") > 0)
    n = held.agg(F.count_distinct("query_id")).first()[0]
    bucket = F.pmod(F.xxhash64("query_id"), F.lit(max(1, -(-n // BUCKET_QUESTIONS)))).cast("int")
    by_term = held.groupBy("part", "term", bucket.alias("bucket")) \
        .agg(F.collect_list(F.struct("query_id", "qweight", "idf")).alias("asked"))
    return index.blocks.join(F.broadcast(by_term) if fits_broadcast(held) else by_term, ["part", "term"])


def _dealt(index: SegmentIndex, rows: DataFrame) -> DataFrame:
    """Rows by range and bucket: a task has so many documents, however many there are."""
    cores = index.spark.sparkContext.defaultParallelism
    return rows.repartition(max(cores, -(-index.n // DOCS_PER_TASK)), *CELL)


def _sums(index: SegmentIndex, blocks: DataFrame, ranker: str) -> DataFrame:
    """``blocks`` are dealt by range: what is added up for a document is in one task, no sums are moved."""
    rows = index.exploded(blocks, "range", "bucket", "asked").select("*", F.inline("asked")).drop("asked")
    weight = F.col("qweight") * _weight(index, ranker, "tf", "dl")
    sums = rows.groupBy(*CELL, "query_id", "doc_id").agg(F.sum(weight).alias("score"))
    if len(index.manifest["segments"]) > 1:
        sums = sums.groupBy("query_id", "doc_id").agg(F.sum("score").alias("score"))
    return sums.where(F.col("score") > 0).select("query_id", "doc_id", "score")


_POSTED = (*CELL, "asked", "docs", "tfs", "dls")


def score_terms(index: SegmentIndex, vectors: DataFrame, ranker: str = "bm25") -> DataFrame:
    """``(query_id, doc_id, score)`` of every pair that shares a term."""
    return _sums(index, _dealt(index, _asked(index, vectors).select(*_POSTED)), ranker)


def range_bounds(index: SegmentIndex, vectors: DataFrame, ranker: str = "bm25") -> DataFrame:
    """``(query_id, seg, range, bound, n)``: no document of the range scores more; ``n`` postings would be read."""
    bound = F.sum(F.col("qweight") * _weight(index, ranker, "max_tf", "min_dl"))
    blocks = _dealt(index, _asked(index, vectors).select(*CELL, "asked", "max_tf", "min_dl", "n"))
    return blocks.select("*", F.inline("asked")).groupBy(*CELL, "query_id").agg(bound.alias("bound"), F.sum("n").alias("n")) \
        .select("query_id", *RANGE, "bucket", "bound", "n")


def _in_ranges(index: SegmentIndex, vectors: DataFrame, ranges: DataFrame, ranker: str) -> DataFrame:
    """The scores of each question in its ranges.  Few ranges meet the blocks before these are dealt, many after."""
    few = fits_broadcast(ranges, RANGES_MAX_BYTES)
    wanted = ranges.groupBy(*CELL).agg(F.collect_set("query_id").alias("wanted"))
    blocks = _asked(index, vectors).select(*_POSTED)
    met = blocks.join(F.broadcast(wanted), list(CELL)) if few else _dealt(index, blocks).join(_dealt(index, wanted), list(CELL))
    left = met.withColumn("asked", F.filter("asked", lambda q: F.array_contains("wanted", q["query_id"]))) \
        .where(F.size("asked") > 0).select(*_POSTED)
    return _sums(index, _dealt(index, left) if few else left, ranker)


def _reachable(index: SegmentIndex, vectors: DataFrame, k: int, ranker: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(bounds, scores of the seeds, ranges beyond the seeds that can reach the first k)``, the first two stored."""
    bounds = materialized(range_bounds(index, vectors, ranker), "range-bounds")
    best = Window.partitionBy("query_id").orderBy(F.desc("bound"), *RANGE)
    bounds = materialized(bounds.withColumn("nth", F.row_number().over(best)), "range-order")
    seeds = materialized(_in_ranges(index, vectors, bounds.where(F.col("nth") <= SEEDS), ranker), "seed-scores")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"))
    reach = seeds.withColumn("n", F.row_number().over(order)).where(F.col("n") == k).select("query_id", F.col("score").alias("reach"))
    rest = bounds.where(F.col("nth") > SEEDS).join(reach, "query_id", "left") \
        .where(F.col("bound") >= F.coalesce("reach", F.lit(0.0)) - MARGIN)
    return bounds, seeds, rest


def retrieve_bounded(index: SegmentIndex, questions: DataFrame, k: int = 5, ranker: str = "bm25", id_col: str = "query_id",
                     text_col: str = "question") -> DataFrame:
    """The top-k documents of every question, by bounds on ranges."""
    vectors = question_vectors(index, questions, ranker, id_col, text_col)
    _, seeds, rest = _reachable(index, vectors, k, ranker)
    rest = materialized(rest, "ranges-left")
    return top_k(seeds.unionByName(_in_ranges(index, vectors, rest, ranker)), k)


def retrieve_terms(index: SegmentIndex, questions: DataFrame, k: int = 5, ranker: str = "bm25", id_col: str = "query_id",
                   text_col: str = "question") -> DataFrame:
    """The top-k documents of every question, from the parts of its terms in one pass."""
    return top_k(score_terms(index, question_vectors(index, questions, ranker, id_col, text_col), ranker), k)


def pruning_report(index: SegmentIndex, questions: DataFrame, k: int = 5, ranker: str = "bm25") -> DataFrame:
    """``(postings, of_terms, scored)``, one row a question: in the index, of its terms, and of those the ones it reads."""
    vectors = question_vectors(index, questions, ranker)
    bounds, _, rest = _reachable(index, vectors, k, ranker)
    read = bounds.where(F.col("nth") <= SEEDS).select("query_id", "n").unionByName(rest.select("query_id", "n"))
    scored = read.groupBy("query_id").agg(F.sum("n").alias("scored"))
    return bounds.groupBy("query_id").agg(F.sum("n").alias("of_terms")).join(scored, "query_id") \
        .select("query_id", F.lit(index.total).alias("postings"), "of_terms", "scored")
