"""Answer containment, retrieval accuracy, Hits@k and MRR.

All metrics are joins plus partial/final aggregations; nothing is
collected.  Totals count the question or list table, so questions without
documents, answers or predictions stay in them; a row that refers to
something missing raises.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import arrow, patterns
from ..functions.text import contains_token_run, normalize_answer, tokenize, words
from .index import normalized_text
from .joins import attach_text

MATCH_MODES = ("string", "regex")
NEVER = "(?!)"


def retrieved_texts(retrieved: DataFrame, docs: DataFrame, n_docs: int) -> DataFrame:
    """G4 + A3: the first ``n_docs`` of each list with the document text.

    A retrieved id without a document is an error, not a dropped row.
    """
    top = retrieved.where(F.col("rank") <= n_docs).select("query_id", "rank", "doc_id")
    return attach_text(top, docs)


def answer_hits(retrieved: DataFrame, docs: DataFrame, answers: DataFrame, n_docs: int = 5,
                match: str = "string", unicode_form: str | None = "NFD") -> DataFrame:
    """G1 / G2 per retrieved document: ``(query_id, rank, doc_id, hit)``.

    ``string``: any answer's uncased token run occurs in the uncased tokens
    of the (NFD) text.  ``regex``: ``answer[0]`` is searched case-
    insensitively, Unicode-aware and multi-line; a pattern that does not
    compile is a miss (checked once per distinct pattern).  A question
    without answers has no hit.
    """
    if match not in MATCH_MODES:
        raise ValueError(f"unknown match mode: {match}")
    pairs = retrieved_texts(retrieved, docs, n_docs)
    if match == "string":
        doc_words = pairs.select(
            "query_id", "rank", "doc_id",
            words(tokenize(normalized_text(F.col("text"), unicode_form)), uncased=True).alias("dw"))
        ans = answers.select("query_id", F.explode_outer("answer").alias("a")) \
            .where(F.col("a").isNotNull())
        ans = ans.select("query_id", words(tokenize(normalized_text(F.col("a"), unicode_form)),
                                           uncased=True).alias("aw"))
        hits = doc_words.join(ans, "query_id", "left").select(
            "query_id", "rank", "doc_id",
            F.coalesce(contains_token_run(F.col("dw"), F.col("aw")), F.lit(False)).alias("hit"))
        return hits.groupBy("query_id", "rank", "doc_id").agg(F.max("hit").alias("hit"))
    first = answers.select("query_id", F.get(F.col("answer"), 0).alias("pattern"))
    first = first.withColumn("pattern", normalized_text(F.col("pattern"), unicode_form))
    checked = first.select("pattern").distinct().where(F.col("pattern").isNotNull())
    checked = checked.select("pattern", patterns.checked_patterns(F.col("pattern")).alias("checked"))
    known = first.join(checked, "pattern", "left").select("query_id", "pattern", "checked.valid", "checked.java")
    rows = pairs.withColumn("text", normalized_text(F.col("text"), unicode_form)).join(known, "query_id", "left")
    # characters that Java's Unicode version lacks could be of any category
    in_java = F.col("java").isNotNull() & ~F.col("text").rlike(r"\p{Cn}")
    rest = F.coalesce("valid", F.lit(False)) & ~in_java
    rows = rows.select("query_id", "rank", "doc_id", F.when(in_java, F.col("text")).alias("java_text"), "java",
                       F.when(rest, F.col("pattern")).alias("pattern"), F.when(rest, F.col("text")).alias("text"))
    found = F.coalesce(F.regexp_like("java_text", F.coalesce("java", F.lit(NEVER))),
                       patterns.regex_found(F.col("pattern"), F.col("text")), F.lit(False))
    return rows.select("query_id", "rank", "doc_id", found.alias("hit"))


def retrieval_hits(hits: DataFrame, questions: DataFrame) -> DataFrame:
    """``(query_id, hit)`` for every question, 1 when any of the first n documents hit.

    Questions without retrieved documents or without answers count as misses.
    """
    per = hits.groupBy("query_id").agg(F.max(F.col("hit").cast("int")).cast("long").alias("hit"))
    return questions.select("query_id").join(per, "query_id", "left") \
        .select("query_id", F.coalesce("hit", F.lit(0)).cast("long").alias("hit"))


def retrieval_accuracy(per_query: DataFrame) -> DataFrame:
    """``(total, matches, accuracy)``; accuracy is NULL for no questions."""
    agg = per_query.agg(F.count(F.lit(1)).alias("total"),
                        F.coalesce(F.sum("hit"), F.lit(0)).cast("long").alias("matches"))
    return agg.select("total", "matches",
                      F.round(F.try_divide(F.col("matches") * 100.0, F.col("total")), 6).alias("accuracy"))


def _answered(lists: DataFrame, gold: DataFrame) -> DataFrame:
    """The prediction lists' questions, once each; one without a gold row is an error."""
    known = gold.select("query_id").distinct().withColumn("_known", F.lit(True))
    checked = lists.select("query_id").distinct().join(known, "query_id", "left")
    missing = F.raise_error(F.concat(F.lit("no answer for question "), F.col("query_id").cast("string")))
    return checked.select(F.when(F.col("_known"), F.col("query_id")).otherwise(missing.cast("long")).alias("query_id"))


def hits_at_k(predictions: DataFrame, gold: DataFrame, k: int, item: str = "item",
              normalize: bool = False, lists: DataFrame | None = None) -> DataFrame:
    """``(total, hits, hits_at_k)`` over the prediction lists.

    ``predictions(query_id, rank, item)``; ``gold(query_id, item)``;
    ``lists(query_id)`` names every list, empty ones included (default: the
    questions that have predictions).  With ``normalize`` both sides go
    through NFD and answer normalisation.
    """
    preds = predictions.where(F.col("rank") <= k).select("query_id", F.col(item).alias("v"))
    gold_v = gold.select("query_id", F.col(item).alias("v"))
    if normalize:
        preds = preds.select("query_id", normalize_answer(arrow.nfd(F.col("v"))).alias("v"))
        gold_v = gold_v.select("query_id", normalize_answer(arrow.nfd(F.col("v"))).alias("v"))
    queries = _answered(predictions if lists is None else lists, gold)
    hit = preds.join(gold_v, ["query_id", "v"], "left_semi").select("query_id").distinct() \
        .withColumn("h", F.lit(1))
    agg = queries.join(hit, "query_id", "left").agg(
        F.count("query_id").alias("total"), F.coalesce(F.sum("h"), F.lit(0)).cast("long").alias("hits"))
    return agg.select("total", "hits",
                      F.round(F.try_divide(F.col("hits") * 100.0, F.col("total")), 6).alias("hits_at_k"))


def mean_reciprocal_rank(predictions: DataFrame, gold: DataFrame, item: str = "item",
                         lists: DataFrame | None = None) -> DataFrame:
    """Mean over the lists of ``max over golds of 1 / first rank`` (0 if absent)."""
    per_gold = predictions.join(gold.select("query_id", item), ["query_id", item]) \
        .groupBy("query_id").agg(F.min("rank").alias("best"))
    queries = _answered(predictions if lists is None else lists, gold)
    rr = queries.join(per_gold, "query_id", "left").select(
        "query_id", F.coalesce(1.0 / F.col("best"), F.lit(0.0)).alias("rr"))
    return rr.agg(F.count("query_id").alias("total"), F.round(F.avg("rr"), 6).alias("mrr"))


def remap_predictions(predictions: DataFrame, ent_map: DataFrame | None,
                      item: str = "item") -> DataFrame:
    """With a map, drop blanks, map ids, close up ranks; without, unchanged.

    An id that the map lacks is an error.
    """
    if ent_map is None:
        return predictions
    kept = predictions.where(F.col(item).isNotNull() & (F.col(item) != ""))
    mapped = kept.join(ent_map.select(F.col("key").alias(item), "value"), item, "left")
    missing = F.raise_error(F.concat(F.lit("not in the entity map: "), F.col(item)))
    w = Window.partitionBy("query_id").orderBy("rank")
    return mapped.select("query_id", F.row_number().over(w).cast("long").alias("rank"),
                         F.coalesce("value", missing.cast("string")).alias(item))
