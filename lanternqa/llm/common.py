"""Helpers the operators share: table access, stored intermediates, text maps."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path


#: Arrow batches between the JVM and Python are bounded by rows only unless this is set.
BATCH_BYTES_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = 4 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by bytes as well, where the session leaves that open: 10,000 long texts
    otherwise lie in the JVM's direct memory and in the Python worker at once."""
    if BATCH_BYTES_SETTING not in spark.conf.getAll:
        spark.conf.set(BATCH_BYTES_SETTING, str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


#: Rows of a narrow table that go into one file where their number is known beforehand.
ROWS_PER_FILE = 1 << 19


def stored(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """Write ``df`` to the shared scratch folder and read it back.

    Cuts the lineage (a lost executor re-reads the files) and gives joins a
    plain scan below their exchange, so AQE may split a skewed partition.
    ``rows``, where a bound is known, keeps a small table from being
    scattered over a file for each shuffle partition.
    """
    spark = df.sparkSession
    bounded_batches(spark)
    path = scratch_path(spark, name)
    if rows is not None:
        df = df.coalesce(max(1, -(-rows // ROWS_PER_FILE)))
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def compacted(df: DataFrame, name: str) -> DataFrame:
    """``stored`` for a narrow table of unknown size, in as many files as its rows need.

    The rows are counted first and held by the executors meanwhile; what a
    lost executor held is computed again.
    """
    held = df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return stored(held, name, held.count())
    finally:
        held.unpersist()


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id long, text string)`` and nothing else: extra columns of the
    input, whatever their names, never meet the operator's own columns."""
    bounded_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"),
                       F.col(text_col).cast("string").alias("text"))


#: Text of the rows that a Python worker has in hand at a time.
PART_BYTES = 1 << 21


def in_parts(batches: Iterable[pa.RecordBatch], text: int = 1, max_bytes: int = PART_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches in slices of about ``max_bytes`` of text (column number ``text``), one row at least.

    What a slice's rows become in Python is given back before the next;
    at the end of a task Arrow's pool is emptied for the next ones.
    """
    for batch in batches:
        at = np.cumsum(pc.binary_length(batch.column(text)).fill_null(0).to_numpy(zero_copy_only=False)) // max_bytes
        cuts = np.flatnonzero(np.diff(at)) + 1
        for low, high in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
            if low < high:
                yield batch.slice(low, high - low)
    pa.default_memory_pool().release_unused()


def map_texts(docs: DataFrame, fn: Callable[[str], tuple], fields: list[tuple[str, pa.DataType, str]],
              make: Callable[[], Callable[[str], tuple]] | None = None) -> DataFrame:
    """One output row per document: ``doc_id`` and the fields ``fn(text)`` gives.

    NULL texts count as empty.  ``fields`` is ``[(name, arrow type, Spark
    type)]``.  With ``make`` the function is built once per task instead.
    """
    schema = pa.schema([("doc_id", pa.int64()), *[(n, t) for n, t, _ in fields]])
    ddl = ", ".join(["doc_id long", *[f"{n} {s}" for n, _, s in fields]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make() if make else fn
        for batch in in_parts(batches):
            found = [f(t.as_py() or "") for t in batch.column(1)]
            columns = list(zip(*found, strict=True))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(c, type=t) for c, (_, t, _) in zip(columns, fields, strict=True)]],
                schema=schema)

    return docs.select("doc_id", "text").mapInArrow(run, ddl)
