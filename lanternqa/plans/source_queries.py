"""Registered queries for sources and sinks (A1-A10): each writes its
format under the shared checkpoint folder and reads it back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.constants import EVAL_CUTOFF
from ..operators import index as ix
from ..operators import retrieve as rt
from ..session import scratch_path
from ..sources import documents as sd
from ..sources import index_store, json_object, jsonl
from . import fixtures as fx
from . import qa_queries as qa
from .oracle_sql import retrieval_sql


def doc_ids(spark, sf_dir):
    return sd.doc_ids(fx.documents(spark, sf_dir, parsed=False))


def doc_text_lookup(spark, sf_dir):
    top = qa._retrieved(spark, sf_dir, EVAL_CUTOFF)
    got = sd.fetch_text(top, fx.documents(spark, sf_dir, parsed=False))
    return got.select("query_id", "rank", "doc_id", "text")


def questions_scan(spark, sf_dir):
    path = scratch_path(spark, "questions")
    jsonl.write_questions(fx.questions(spark, sf_dir), path)
    return _with_ids(jsonl.read_questions(spark, path), fx.questions(spark, sf_dir)).select(
        "query_id", "question", F.array_join("answer", "|").alias("answer"))


def line_ids(spark, sf_dir):
    """The lines of a file with their numbers."""
    path = scratch_path(spark, "lines")
    items = fx.table(spark, sf_dir, "benchmark").select("item_id", F.regexp_replace("text", r"\s+", " ").alias("text"))
    items.orderBy("item_id").select("text").write.text(path)
    return jsonl.with_line_ids(spark, path).select(F.col("query_id").alias("line"), F.col("value").alias("text"))


def _with_ids(lines, questions):
    """Line numbers back to the ids of the questions, which were written in order."""
    ids = rt.doc_index(questions, "query_id").select(F.col("doc_index").alias("_line"), F.col("query_id").alias("_id"))
    return lines.join(ids, lines["query_id"] == ids["_line"]).withColumn("query_id", F.col("_id")).drop("_line", "_id")


def pdocs_roundtrip(spark, sf_dir):
    path = scratch_path(spark, "pdocs")
    jsonl.write_pdocs(qa._retrieved(spark, sf_dir, EVAL_CUTOFF), fx.questions(spark, sf_dir), path)
    back = _with_ids(jsonl.read_pdocs(spark, path), fx.questions(spark, sf_dir))
    return back.select("query_id", "rank", F.col("doc_id").cast("long").alias("doc_id"), F.round("score", 6).alias("score"))


def preds_roundtrip(spark, sf_dir):
    path = scratch_path(spark, "preds")
    spans = qa.rd.aggregate_spans(qa._nbest(spark, sf_dir), "sum", qa.EMITTED_SPANS)
    jsonl.write_preds(spans, fx.questions(spark, sf_dir), path)
    return qa._show_spans(_with_ids(jsonl.read_preds(spark, path), fx.questions(spark, sf_dir)))


def entity_roundtrip(spark, sf_dir):
    path = scratch_path(spark, "entities")
    jsonl.write_entities(qa.dedupe_entities(spark, sf_dir), path, qa._gold(spark, sf_dir))
    return _with_ids(jsonl.read_entities(spark, path), qa._gold(spark, sf_dir))


def entity_map_scan(spark, sf_dir):
    """The map as one object in one file, read in byte ranges."""
    path = scratch_path(spark, "entity-map")
    json_object.write_json_object(qa._index_map(spark, sf_dir), path)
    return jsonl.read_entity_map(spark, path)


def entity_map_lines(spark, sf_dir):
    """A9 with an object a line."""
    path = scratch_path(spark, "entity-map-lines")
    jsonl.write_entity_map(qa._index_map(spark, sf_dir), path)
    return jsonl.read_entity_map(spark, path, lines=True)


def index_roundtrip(spark, sf_dir):
    path = scratch_path(spark, "index-store")
    built = ix.build_index(fx.documents(spark, sf_dir), unicode_form=None)
    index_store.save_index(built, path)
    return ix.term_counts(index_store.load_index(spark, path))


QUERIES = {
    "doc_ids": doc_ids, "doc_text_lookup": doc_text_lookup, "questions_scan": questions_scan,
    "pdocs_roundtrip": pdocs_roundtrip, "preds_roundtrip": preds_roundtrip,
    "entity_roundtrip": entity_roundtrip, "entity_map_scan": entity_map_scan,
    "entity_map_lines": entity_map_lines, "line_ids": line_ids,
    "index_roundtrip": index_roundtrip,
}

ORACLE = {
    "doc_ids": "SELECT doc_id FROM documents",
    "doc_text_lookup": f"""WITH top AS ({retrieval_sql('bm25', EVAL_CUTOFF)})
        SELECT t.query_id, t.rank, t.doc_id, d.text FROM top t JOIN documents d ON d.doc_id = t.doc_id""",
    "questions_scan": "SELECT item_id AS query_id, text AS question, text AS answer FROM benchmark",
    "line_ids": r"""SELECT row_number() OVER (ORDER BY item_id) - 1 AS line,
        regexp_replace(text, '[ \t\n\x0b\f\r]+', ' ', 'g') AS text FROM benchmark""",
    "entity_map_scan": "SELECT CAST(vec_id AS VARCHAR) AS key, 'E' || CAST(label AS VARCHAR) AS value FROM embeddings",
    "pdocs_roundtrip": retrieval_sql("bm25", EVAL_CUTOFF),
    "preds_roundtrip": qa.ORACLE["span_sum"],
    "entity_roundtrip": qa.ORACLE["dedupe_entities"],
}
ORACLE["entity_map_lines"] = ORACLE["entity_map_scan"]
