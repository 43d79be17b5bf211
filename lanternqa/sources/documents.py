"""A1 / A3: the document store as a Parquet table ``(doc_id, text)``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.index import normalized_text


def read_documents(spark: SparkSession, path: str, id_col: str = "doc_id",
                   text_col: str = "text", partitions: int | None = None) -> DataFrame:
    """``(doc_id, text)`` from Parquet, only the two columns are read.

    The scan's splits (``spark.sql.files.maxPartitionBytes``) are the tasks.
    ``partitions`` deals the rows out by ``doc_id`` instead: for a corpus of
    few row groups whose parsing costs more than moving the text once.
    """
    df = spark.read.parquet(path).select(F.col(id_col).alias("doc_id"),
                                         F.col(text_col).alias("text"))
    return df if partitions is None else df.repartition(partitions, "doc_id")


def doc_ids(docs: DataFrame) -> DataFrame:
    """A1: the document ids (column pruning reads only this column)."""
    return docs.select("doc_id")


def fetch_text(ids: DataFrame, docs: DataFrame, id_col: str = "doc_id",
               normalize_ids: bool = False) -> DataFrame:
    """A3: ``ids LEFT JOIN docs`` - one join instead of a lookup per id.

    With ``normalize_ids`` the ids are NFD-normalised first (string ids, as
    the store keys them).  Missing ids keep a NULL text.
    """
    key = F.col(id_col)
    if normalize_ids:
        key = normalized_text(key.cast("string"), "NFD")
    left = ids.withColumn("_key", key)
    right = docs.select(F.col("doc_id").alias("_key"), "text")
    if normalize_ids:
        right = right.withColumn("_key", F.col("_key").cast("string"))
    return left.join(right, "_key", "left").drop("_key")


def missing_ids(ids: DataFrame, docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Ids with no document (the reference fails on them; we report them)."""
    return ids.join(docs.select(F.col("doc_id").alias(id_col)), id_col, "left_anti")
