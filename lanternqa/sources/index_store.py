"""A10: persist and load a term index as Parquet folders.

``postings/`` (bucketed by ``doc_id``, sorted by ``term``), ``docs/``,
``terms/`` (with document frequencies) and ``meta/``, a one-row table with
the corpus statistics and the parameters the index was built with.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.index import TermIndex

META = ("ngram int, mode string, unicode_form string, tokenizer string, k1 double, b double, hash_size long, "
        "n_docs long, total_terms long, buckets int")


def _postings(spark: SparkSession, path: str, buckets: int) -> DataFrame:
    """The stored postings as a bucketed table.

    The catalog is where Spark takes buckets from: a name is made, resolved
    and dropped again (the name only: the files lie under the given path).
    """
    name = f"postings_{uuid.uuid4().hex}"
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spark.read.parquet(f"{path}/postings").schema)
    spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY (doc_id) SORTED BY (term) "
              f"INTO {buckets} BUCKETS LOCATION '{path}/postings'")
    found = spark.table(name)
    spark.sql(f"DROP TABLE {name}")
    return found


def save_index(index: TermIndex, path: str, buckets: int | None = None) -> TermIndex:
    """Write the index and return the stored one; the text is parsed once."""
    spark = index.postings.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"postings_{uuid.uuid4().hex}"
    # dealt out by document as the buckets are: one file for each bucket
    index.postings.repartition(buckets, "doc_id").write.bucketBy(buckets, "doc_id").sortBy("term") \
        .option("path", f"{path}/postings").saveAsTable(name)
    stored = spark.table(name)
    lengths = stored.groupBy("doc_id").agg(F.max("dl").alias("dl"))  # bucketed by doc_id: no exchange
    index.docs.select("doc_id").join(lengths, "doc_id", "left") \
        .select("doc_id", F.coalesce("dl", F.lit(0)).cast("long").alias("dl")).write.parquet(f"{path}/docs")
    stored.groupBy("term").agg(F.count(F.lit(1)).alias("df")).write.parquet(f"{path}/terms")
    totals = spark.read.parquet(f"{path}/docs").agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("total")).first()
    meta = [(index.ngram, index.mode, index.unicode_form or "", "simple", index.k1, index.b, index.hash_size,
             totals["n"], totals["total"], buckets)]
    spark.createDataFrame(meta, META).coalesce(1).write.parquet(f"{path}/meta")
    spark.sql(f"DROP TABLE {name}")  # the name only: the files lie under the given path
    return load_index(spark, path)


def load_index(spark: SparkSession, path: str) -> TermIndex:
    m = spark.read.parquet(f"{path}/meta").collect()[0]  # one row of parameters
    return TermIndex(_postings(spark, path, m.buckets), spark.read.parquet(f"{path}/docs"), m.ngram, m.mode,
                     m.unicode_form or None, m.k1, m.b, m.hash_size, spark.read.parquet(f"{path}/terms"),
                     m.n_docs, m.total_terms)
