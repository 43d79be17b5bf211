"""Streaming retrieval gives the batch result."""

import os
import shutil
import tempfile

from pyspark.sql import functions as F

from lanternqa.plans import catalog
from lanternqa.streaming.retrieval import start_retrieval

from .conftest import SF001


def test_stream_equals_batch(spark):
    d = tempfile.mkdtemp(prefix="lq-stream-")
    os.makedirs(f"{d}/in")
    shutil.copy(f"{SF001}/benchmark.parquet", f"{d}/in/part-0.parquet")
    bench = spark.read.parquet(f"{SF001}/benchmark.parquet")
    stream = spark.readStream.schema(bench.schema).parquet(f"{d}/in") \
        .select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))
    index = catalog.corpus_index(spark, SF001)
    q = start_retrieval(stream, index, f"{d}/out", f"{d}/ckpt", k=5)
    q.awaitTermination(300)
    got = spark.read.parquet(f"{d}/out").drop("epoch")
    expected = catalog.bm25_topk(spark, SF001)
    assert got.count() == expected.count() > 0
    assert got.exceptAll(expected).count() == 0
