"""Join helpers: broadcast only behind a check of the size in bytes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A side is broadcast only when its rows are at most this many bytes; beyond
# it the join is a shuffle join of stored tables, which AQE can split.
BROADCAST_MAX_BYTES = 32 << 20
ROW_OVERHEAD = 32


def _row_bytes(df: DataFrame) -> Column:
    """Bytes of a row: its strings' octets, 16 for any other column, and overhead."""
    size = F.lit(ROW_OVERHEAD)
    for name, kind in df.dtypes:
        size = size + (F.coalesce(F.octet_length(name), F.lit(0)) if kind == "string" else F.lit(16))
    return size.cast("long")


def fits_broadcast(df: DataFrame, max_bytes: int = BROADCAST_MAX_BYTES) -> bool:
    """True when the rows of ``df`` (strings and scalars) are at most ``max_bytes``.

    One aggregation over ``df``; give it a stored or otherwise cheap table.
    """
    total = df.agg(F.coalesce(F.sum(_row_bytes(df)), F.lit(0))).first()[0]
    return total <= max_bytes


def attach_text(pairs: DataFrame, docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``pairs`` plus the ``text`` of their document; an id without document raises.

    Only the texts that are asked for are shuffled (semi join first).
    """
    ids = pairs.select(id_col).distinct()
    texts = docs.select(F.col("doc_id").alias(id_col), "text", F.lit(True).alias("_found")).join(ids, id_col, "left_semi")
    missing = F.raise_error(F.concat(F.lit("no such document: "), F.col(id_col).cast("string")))
    joined = pairs.join(texts, id_col, "left")
    return joined.select(*pairs.columns, F.when(F.col("_found"), F.col("text"))
                         .otherwise(missing.cast("string")).alias("text"))
