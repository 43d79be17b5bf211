"""Rows dealt out as compressed pieces: nothing is changed on the way, and little is moved."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lanternqa.operators import packed as pk
from lanternqa.operators import tokens as tk
from lanternqa.plans import fixtures as fx
from lanternqa.session import materialized

COLUMNS = [
    pa.array([1, None, -5, 2**62, -(2**63), 2**63 - 1, 7], pa.int64()),
    pa.array([3, 4, 5, 6, 7, 8, None], pa.int32()),
    pa.array(["a", "", None, "é́", "x" * 300, " ", "z"]),
    pa.array([[1, 2], [], None, [-(2**40), 5], [0], [7, 8, 9], [1]], pa.list_(pa.int64())),
    pa.array([["p", None], [], None, ["q"], [""], ["r", "s"], None], pa.list_(pa.string())),
    pa.array([True, None, False, True, True, False, None]),
    pa.array([0.5, None, float("inf"), -0.0, 1e300, 2.0, 3.0]),
    pa.array([[[1], []], None, [], [[2, 3]], [None], [[4]], [[5]]], pa.list_(pa.list_(pa.int32()))),
]


@pytest.mark.parametrize("low,high", [(0, 7), (2, 6), (1, 2), (3, 3)])
def test_a_piece_holds_what_was_packed(low, high):
    columns = [c.slice(low, high - low) for c in COLUMNS]
    schema = pa.schema([pa.field(f"c{i}", c.type) for i, c in enumerate(columns)])
    got = pk.unpack(pk.pack(columns), schema)
    assert [c.to_pylist() for c in got.columns] == [c.to_pylist() for c in columns]
    for c in got.columns:
        c.validate(full=True)


def test_rows_are_dealt_by_key(spark, monkeypatch):
    monkeypatch.setattr(pk, "PACK_BYTES", 500)  # many pieces a task
    rows = spark.range(2000).select((F.col("id") % 31).alias("k"), F.when(F.col("id") % 5 > 0, F.col("id").cast("string")).alias("s"),
                                    F.sequence(F.lit(0), F.col("id") % 4).alias("a"))
    got = pk.deal(rows, 7, "k").withColumn("at", F.spark_partition_id())
    assert got.rdd.getNumPartitions() == 7 and got.groupBy("k").agg(F.count_distinct("at").alias("n")).where("n > 1").count() == 0
    assert got.drop("at").exceptAll(rows).count() == 0 == rows.exceptAll(got.drop("at")).count() and got.schema[:3] == rows.schema[:3]


def exchanged(df):
    """Bytes that the exchanges of the finished plan of ``df`` have written."""
    def of(plan):
        if plan.nodeName() == "AdaptiveSparkPlan":
            return of(plan.executedPlan())
        if "QueryStage" in plan.nodeName():
            return of(plan.plan())
        metrics = plan.metrics()
        own = int(metrics.get("shuffleBytesWritten").get().value()) if metrics.contains("shuffleBytesWritten") and "Exchange" == plan.nodeName() else 0
        return own + sum(of(plan.children().apply(i)) for i in range(plan.children().size()))
    df.collect()
    return of(df._jdf.queryExecution().executedPlan())


@pytest.fixture(scope="module")
def stored(spark):
    rng = random.Random(7)
    words = ["".join(rng.choices("abcdefghijklmnoprstu", k=rng.randrange(2, 9))) for _ in range(3000)]
    texts = [" ".join(rng.choice(words).capitalize() if rng.random() < 0.1 else rng.choice(words) for _ in range(rng.randrange(700)))
             for _ in range(300)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    return sum(map(len, texts)), materialized(tk.token_table(docs, fx.TAGGERS), "tokens")


def test_annotations_move_less_than_the_text(spark, stored):
    size, table = stored
    assert 0 < exchanged(tk.annotations_of_table(table, tuple(fx.TAGGERS))) < size


def test_entity_groups_move_less_than_the_text(spark, stored):
    size, table = stored
    assert 0 < exchanged(tk.entity_groups_of_table(table)) < size / 2


ROWS = [(1, 0, "a", "a ", "X"), (1, 0, "b", "b ", "X"), (1, 1, "c", "c ", "Y"), (None, 1, "e", "e", "X"), (None, 0, "d", "d ", "X"),
        (1, 1, "c", "c ", "Y"), (2, None, "n", "n", "X"), (2, 5, "g", "g ", None), (2, 9, "h", "h ", "X"), (2, 7, "f", "f ", "X"), (3, 0, "o", "o", "O")]


def test_keys_that_repeat_or_are_null(spark):
    table = spark.createDataFrame(random.Random(1).sample(ROWS, len(ROWS)), "doc_id long, pos long, token string, text_ws string, ner string").repartition(3)
    got = {r.doc_id: (r.tokens, r.ner) for r in tk.annotations_of_table(table, ("ner",)).collect()}
    assert got == {1: (["a", "b", "c", "c"], ["X", "X", "Y", "Y"]), None: (["d", "e"], ["X", "X"]),
                   2: (["n", "g", "f", "h"], ["X", None, "X", "X"]), 3: (["o"], ["O"])}
    for block in (1, 2, 8, 4096):
        groups = sorted(tuple(r) for r in tk.entity_groups_of_table(table, block=block).select("doc_id", "group_idx", "text", "tag").collect())
        assert groups == [(1, 0, "a b", "X"), (1, 1, "c c", "Y"), (2, 0, "f h", "X")]
