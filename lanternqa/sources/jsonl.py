"""The JSON-lines files the stages exchange, read and written by Spark.

The files carry no question id: a line belongs to the question of the same
line (A6).  Writers therefore write a line for every question, in question
order, empty lists included; readers number the lines and return the lists
(``query_id`` and the whole list) and, from those, rows in long form.
Document ids are text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .json_object import read_json_object

QUESTION_SCHEMA = T.StructType([
    T.StructField("query_id", T.LongType()),
    T.StructField("question", T.StringType()),
    T.StructField("answer", T.ArrayType(T.StringType())),
    T.StructField("entity", T.StringType()),
])

PDOCS_SCHEMA = T.StructType([
    T.StructField("query", T.StringType()),
    T.StructField("doc_ids", T.ArrayType(T.StringType())),
    T.StructField("doc_scores", T.ArrayType(T.DoubleType())),
])

FAIL = {"mode": "FAILFAST"}

PRED_ELEMENT = ("array<struct<query:string,span:string,score:double,docs:array<string>,"
                "start_idx:array<int>,end_idx:array<int>>>")


def with_line_ids(spark: SparkSession, path: str) -> DataFrame:
    """``(query_id, value)`` with ``query_id`` = 0-based line number.

    Files are ordered by name, lines by their place; each scan task numbers
    its own lines and is shifted by the lines of the tasks before it (one
    row per task).  ``_metadata`` gives a task's file and first byte.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_file"),
                                         F.col("_metadata.file_block_start").alias("_block"),
                                         F.monotonically_increasing_id().alias("_row"))
    sizes = lines.groupBy("_file", "_block").agg(F.count(F.lit(1)).alias("_n"), F.min("_row").alias("_first"))
    before = sizes.select("_file", "_block", "_first",
                          (F.sum("_n").over(Window.orderBy("_file", "_block")) - F.col("_n")).alias("_before"))
    return lines.join(F.broadcast(before), ["_file", "_block"]) \
        .select((F.col("_before") + F.col("_row") - F.col("_first")).cast("long").alias("query_id"), "value")


def _write_lines(lines: DataFrame, path: str) -> None:
    """``(query_id, value)`` as text, one line each, in the order of ``query_id``."""
    lines.orderBy("query_id").select("value").write.mode("error").text(path)


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """A4: questions JSONL; ``query_id`` from line order when the file has none."""
    raw = with_line_ids(spark, path)
    parsed = raw.select(F.col("query_id").alias("_line"),
                        F.from_json("value", QUESTION_SCHEMA, FAIL).alias("j"))
    return parsed.select(F.coalesce("j.query_id", "_line").alias("query_id"), "j.question",
                         "j.answer", "j.entity")


def write_questions(questions: DataFrame, path: str) -> None:
    """A4 writer: every column but the id, NULLs left out, in question order."""
    held = [c for c in ("question", "answer", "entity") if c in questions.columns]
    _write_lines(questions.select("query_id", F.to_json(F.struct(*held)).alias("value")), path)


def _every_question(nested: DataFrame, questions: DataFrame) -> DataFrame:
    """One row per question; ``nested(query_id, l)`` gives its list, an empty one where it has none."""
    joined = questions.join(nested, "query_id", "left")
    empty = F.array().cast(nested.schema["l"].dataType)
    return joined.withColumn("l", F.coalesce("l", empty))


def write_pdocs(retrieved: DataFrame, questions: DataFrame, path: str) -> None:
    """A5 writer: one line per question, documents in rank order."""
    nested = retrieved.groupBy("query_id").agg(
        F.array_sort(F.collect_list(F.struct("rank", "doc_id", "score"))).alias("l"))
    rows = _every_question(nested, questions.select("query_id", F.col("question").alias("query")))
    line = F.struct("query", F.transform("l", lambda x: x["doc_id"].cast("string")).alias("doc_ids"),
                    F.transform("l", lambda x: x["score"]).alias("doc_scores"))
    _write_lines(rows.select("query_id", F.to_json(line).alias("value")), path)


def read_pdocs_lists(spark: SparkSession, path: str) -> DataFrame:
    """A5 reader, a row per question: ``(query_id, query, doc_ids, doc_scores)``."""
    parsed = with_line_ids(spark, path).select("query_id", F.from_json("value", PDOCS_SCHEMA, FAIL).alias("j"))
    return parsed.select("query_id", "j.query", "j.doc_ids", "j.doc_scores")


def read_pdocs(spark: SparkSession, path: str) -> DataFrame:
    """A5 reader, long form ``(query_id, rank, doc_id string, score)``."""
    ex = read_pdocs_lists(spark, path).select(
        "query_id", F.posexplode(F.arrays_zip("doc_ids", "doc_scores")).alias("p", "d"))
    return ex.select("query_id", (F.col("p") + 1).cast("long").alias("rank"),
                     F.col("d.doc_ids").alias("doc_id"), F.col("d.doc_scores").alias("score"))


def write_preds(spans: DataFrame, questions: DataFrame, path: str) -> None:
    """A7 writer: exactly one JSON array per question line (reader output)."""
    el = F.struct(F.col("query"), "span", "score", "docs",
                  F.col("start_idx").cast("array<int>").alias("start_idx"),
                  F.col("end_idx").cast("array<int>").alias("end_idx"))
    q = questions.select("query_id", F.col("question").alias("query"))
    nested = spans.join(q, "query_id").groupBy("query_id").agg(
        F.array_sort(F.collect_list(F.struct("rank", el.alias("e")))).alias("l"))
    rows = _every_question(nested, q)
    _write_lines(rows.select("query_id", F.to_json(F.transform("l", lambda x: x["e"])).alias("value")), path)


def read_preds_lists(spark: SparkSession, path: str) -> DataFrame:
    """A7 reader, a row per question: ``(query_id, preds)``; empty lists stay."""
    return with_line_ids(spark, path).select("query_id", F.from_json("value", PRED_ELEMENT, FAIL).alias("preds"))


def read_preds(spark: SparkSession, path: str) -> DataFrame:
    """A7 reader: ``(query_id, rank, span, score, docs, start_idx, end_idx)``."""
    ex = read_preds_lists(spark, path).select("query_id", F.posexplode("preds").alias("p", "e"))
    return ex.select("query_id", (F.col("p") + 1).cast("long").alias("rank"), "e.span", "e.score",
                     "e.docs", F.col("e.start_idx").cast("array<long>").alias("start_idx"),
                     F.col("e.end_idx").cast("array<long>").alias("end_idx"))


def write_entities(ranked: DataFrame, path: str, questions: DataFrame | None = None) -> None:
    """A8 writer: ``{"entities": [...]}`` per question (default: those that have entities)."""
    nested = ranked.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "entity"))).alias("l"))
    if questions is None:
        questions = ranked.select("query_id").distinct()
    rows = _every_question(nested, questions.select("query_id"))
    line = F.struct(F.transform("l", lambda x: x["entity"]).alias("entities"))
    _write_lines(rows.select("query_id", F.to_json(line).alias("value")), path)


def read_entities_lists(spark: SparkSession, path: str) -> DataFrame:
    """A8 reader, a row per question: ``(query_id, entities)``; empty lists stay."""
    parsed = with_line_ids(spark, path).select(
        "query_id", F.from_json("value", "entities array<string>", FAIL).alias("j"))
    return parsed.select("query_id", "j.entities")


def read_entities(spark: SparkSession, path: str) -> DataFrame:
    """A8 reader, long form ``(query_id, rank, entity)``."""
    ex = read_entities_lists(spark, path).select("query_id", F.posexplode("entities").alias("p", "entity"))
    return ex.select("query_id", (F.col("p") + 1).cast("long").alias("rank"), "entity")


def write_entity_map(index_map: DataFrame, path: str) -> None:
    """A9 writer: a JSON object per line, each holding some of ``(key, value)``."""
    one = F.map_from_arrays(F.array("key"), F.array("value"))
    index_map.select(F.to_json(one).alias("value")).write.mode("error").text(path)


def read_entity_map(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """A JSON object ``{id: entity}`` per file -> ``(key, value)``, each file read in byte ranges.

    With ``lines`` every line is an object (``write_entity_map``).
    """
    if not lines:
        return read_json_object(spark, path)
    m = spark.read.text(path).where(F.trim("value") != "") \
        .select(F.from_json("value", "map<string,string>", FAIL).alias("m"))
    return m.select(F.explode("m").alias("key", "value"))
