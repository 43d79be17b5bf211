"""A2: the SQLite document store as a Python data source (``sqlite_docs``).

Each partition reads one rowid range with its own read-only connection and
yields Arrow batches.  The file must lie under the same path on the driver
and on every executor (a shared mount); a reader that does not find it fails.
"""

from __future__ import annotations

import sqlite3

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


BATCH_ROWS = 1024


class _Range(InputPartition):
    def __init__(self, lo: int, hi: int):
        self.lo, self.hi = lo, hi


class SqliteDocsReader(DataSourceReader):
    def __init__(self, options, schema):
        self.path = options["path"]
        self.table = options.get("table", "documents")
        self.parts = int(options.get("numPartitions", "8"))

    def _connect(self):
        return sqlite3.connect(f"file:{self.path}?mode=ro", uri=True)

    def partitions(self):
        with self._connect() as con:
            lo, hi = con.execute(f"SELECT min(rowid), max(rowid) FROM {self.table}").fetchone()
        if lo is None:
            return [_Range(0, -1)]
        step = max(1, -(-(hi - lo + 1) // self.parts))
        return [_Range(s, min(s + step - 1, hi)) for s in range(lo, hi + 1, step)]

    def read(self, partition):
        con = self._connect()
        try:
            cur = con.execute(f"SELECT id, text FROM {self.table} WHERE rowid BETWEEN ? AND ?",
                              (partition.lo, partition.hi))
            while rows := cur.fetchmany(BATCH_ROWS):
                ids, texts = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(map(str, ids), pa.string()), pa.array(texts, pa.string())],
                                                 names=["id", "text"])
        finally:
            con.close()


class SqliteDocs(DataSource):
    """``spark.read.format("sqlite_docs").option("path", ...).load()`` -> ``(id, text)``."""

    @classmethod
    def name(cls):
        return "sqlite_docs"

    def schema(self):
        return "id string, text string"

    def reader(self, schema):
        return SqliteDocsReader(self.options, schema)


def register(spark) -> None:
    spark.dataSource.register(SqliteDocs)
