"""Annotations and entity groups over a token table equal those in the document's row."""

import pytest
from pyspark.sql import functions as F

from lanternqa.operators import read as rd
from lanternqa.operators import tokens as tk
from lanternqa.plans import fixtures as fx

from .conftest import SF001

TEXTS = ["New York City is big , Paris", "", None, "all lower", "One  Two\nthree Four.", "X " * 50 + "y " + "Z " * 23, "A", "a​B  C "]


def groups(df):
    return sorted(tuple(r) for r in df.select("doc_id", "group_idx", "text", "tag").collect())


@pytest.mark.parametrize("block", [1, 3, 7, 4096])
def test_groups_across_block_borders(spark, block):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    table = tk.token_table(docs, fx.TAGGERS)
    assert groups(tk.entity_groups_of_table(table, block=block)) == groups(tk.entity_groups(docs, fx.fixture_ner_tag))


def test_groups_of_the_corpus(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet").select("doc_id", "text")
    want = groups(tk.entity_groups(docs, fx.fixture_ner_tag))
    assert groups(tk.entity_groups_of_table(tk.token_table(docs, fx.TAGGERS), block=50)) == want


def test_tokens_do_not_carry_the_document(spark):
    """A row a token that held the document's token array took time with its square."""
    long = spark.range(1).select(F.col("id").alias("doc_id"), F.expr("repeat('One two, three.  ', 30000)").alias("text"))
    table = tk.token_table(long, fx.TAGGERS)
    generate = [line for line in table._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Generate" in line]
    assert len(generate) == 1 and "toks" not in generate[0]
    got = table.agg(F.count("*"), F.sum(F.length("text_ws")), F.count_if(F.col("text_ws") == ".")).first()
    assert tuple(got) == (150_000, 30_000 * 17 - 2, 1)


def test_any_kind_and_absent_tags(spark):
    rows = [(1, i, t, t + " ", tag) for i, (t, tag) in enumerate([("a", "X"), ("b", "X"), ("c", None), ("d", "X"), ("e", "Y"), ("f", "-")])]
    table = spark.createDataFrame(rows, "doc_id long, pos long, token string, text_ws string, kind string")
    assert groups(tk.entity_groups_of_table(table, "kind", "-", block=2)) == [(1, 0, "a b", "X"), (1, 1, "d", "X"), (1, 2, "e", "Y")]
    assert tk.entity_groups_of_table(table.where("false"), "kind").count() == 0


def test_kinds_come_in_token_order_and_fit_the_text(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    arrays = tk.annotations_of_table(tk.token_table(docs, fx.TAGGERS), tuple(fx.TAGGERS))
    joined = docs.join(arrays.withColumnRenamed("pos_tag", "pos"), "doc_id")
    tagged = {r.doc_id: r for r in tk.stored_annotations(joined, "text").collect()}  # raises where lengths differ
    assert tagged[4].tokens == ["One", "Two", "three", "Four", "."]
    assert tagged[4].pos_tags == ["WORD"] * 4 + ["PUNCT"] and tagged[4].lemma_tags == ["one", "two", "three", "four", "."]
    assert tagged[4].ner_tags == ["ENT", "ENT", "O", "ENT", "O"] and set(tagged) == {0, 3, 4, 5, 6, 7}


def test_models_get_bounded_batches(spark):
    questions = spark.createDataFrame([(1, "who")], "query_id long, question string")
    docs = spark.range(40).select(F.col("id").alias("doc_id"), F.concat(F.lit("text number "), "id").alias("text"))
    found = docs.select(F.lit(1).cast("long").alias("query_id"), (F.col("doc_id") + 1).alias("rank"), "doc_id")

    def scorer():
        def model(seqs):
            assert len(seqs) <= 8
            return [([float(len(seqs))] * len(s), [0.0] * len(s), 0.0) for s in seqs]
        return model

    scored = rd.score_passages_with(rd.pair_encoding(rd.reader_pairs(found, questions, docs)), scorer, batch_size=8)
    assert scored.count() == 40 and scored.agg(F.max(F.get("start_logits", F.lit(0)))).first()[0] <= 8
