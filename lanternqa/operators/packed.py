"""Rows dealt out by a key as compressed pieces of columns.

Spark's exchange writes a row for a row, each with its own padding; short
rows of a few words take many times their content.  Here a task collects
``PACK_BYTES`` of rows, deals them by the key's hash and moves one
compressed piece for each target task.  Whole numbers are stored as
differences where these are smaller, and as planes of bytes; strings and
lists as lengths and content; other types as Arrow writes them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Bytes of rows that a task collects before it deals them.
PACK_BYTES = 24 << 20


def _numbers(values: np.ndarray) -> bytes:
    """Whole numbers: (differences?, width), then their planes of bytes."""
    values = values.astype(np.int64)
    steps = np.diff(values, prepend=0)
    stepped = np.abs(steps.astype(np.float64)).sum() < np.abs(values.astype(np.float64)).sum()
    kept = steps if stepped else values
    kept = ((kept << 1) ^ (kept >> 63)).view(np.uint64)
    most = int(kept.max()) if len(kept) else 0
    width = next(w for w in (1, 2, 4, 8) if most < 1 << 8 * w)
    planes = kept.astype(f"<u{width}").view(np.uint8).reshape(len(kept), width).T
    return bytes((int(stepped), width)) + planes.tobytes()


def _numbers_of(data: memoryview) -> np.ndarray:
    stepped, width = data[0], data[1]
    planes = np.frombuffer(data, dtype=np.uint8, offset=2).reshape(width, -1)
    kept = np.ascontiguousarray(planes.T).view(f"<u{width}").ravel().astype(np.uint64)
    values = (kept >> np.uint64(1)).view(np.int64) ^ -(kept & np.uint64(1)).view(np.int64)
    return np.cumsum(values) if stepped else values


def _offsets(array: pa.Array) -> np.ndarray:
    kind = np.int64 if pa.types.is_large_string(array.type) or pa.types.is_large_list(array.type) else np.int32
    if not len(array):
        return np.zeros(1, dtype=kind)
    return np.frombuffer(array.buffers()[1], dtype=kind)[array.offset:array.offset + len(array) + 1]


def _is_string(kind: pa.DataType) -> bool:
    return pa.types.is_string(kind) or pa.types.is_large_string(kind)


def _is_list(kind: pa.DataType) -> bool:
    return pa.types.is_list(kind) or pa.types.is_large_list(kind)


def _plain(kind: pa.DataType) -> bool:
    """Types written by ``_numbers``."""
    return pa.types.is_signed_integer(kind)


def _write(array: pa.Array, out: list[bytes]) -> None:
    kind = array.type
    if not (_plain(kind) or _is_string(kind) or _is_list(kind)):
        batch = pa.RecordBatch.from_arrays([array], names=["_"])
        out.append(batch.serialize().to_pybytes())
        return
    gaps = array.null_count
    out.append(np.packbits(array.is_valid().to_numpy(zero_copy_only=False)).tobytes() if gaps else b"")
    if _plain(kind):
        out.append(_numbers((array.fill_null(0) if gaps else array).to_numpy(zero_copy_only=False)))
        return
    if gaps:  # what a null holds is left out
        array = array.fill_null("") if _is_string(kind) else array.take(pa.array(np.arange(len(array))))
    offsets = _offsets(array)
    out.append(_numbers(np.diff(offsets)))
    if _is_string(kind):
        data = array.buffers()[2]
        out.append(bytes(memoryview(data)[offsets[0]:offsets[-1]]) if data is not None else b"")
    else:
        _write(array.values[offsets[0]:offsets[-1]], out)


def _read(kind: pa.DataType, n: int, chunks: Iterator[memoryview]) -> pa.Array:
    if not (_plain(kind) or _is_string(kind) or _is_list(kind)):
        schema = pa.schema([pa.field("_", kind)])
        return pa.ipc.read_record_batch(pa.py_buffer(next(chunks)), schema).column(0)
    mask = next(chunks)
    valid = np.unpackbits(np.frombuffer(mask, dtype=np.uint8), count=n).astype(bool) if len(mask) else None
    gaps = None if valid is None else pa.py_buffer(np.packbits(valid, bitorder="little").tobytes())
    numbers = _numbers_of(next(chunks))
    if _plain(kind):
        return pa.array(numbers.astype(kind.to_pandas_dtype()), type=kind, mask=None if valid is None else ~valid)
    wide = np.int64 if pa.types.is_large_string(kind) or pa.types.is_large_list(kind) else np.int32
    offsets = pa.py_buffer(np.concatenate(([0], np.cumsum(numbers))).astype(wide).tobytes())
    if _is_string(kind):
        return pa.Array.from_buffers(kind, n, [gaps, offsets, pa.py_buffer(next(chunks))])
    return pa.Array.from_buffers(kind, n, [gaps, offsets], children=[_read(kind.value_type, int(numbers.sum()), chunks)])


def pack(columns: list[pa.Array]) -> bytes:
    """The columns' rows as one compressed piece."""
    out: list[bytes] = []
    for column in columns:
        _write(column, out)
    head = np.array([len(columns[0]), len(out), *map(len, out)], dtype="<i8").tobytes()
    data = b"".join((head, *out))
    return len(data).to_bytes(8, "little") + pa.Codec("zstd", compression_level=3).compress(data, asbytes=True)


def unpack(piece: bytes, schema: pa.Schema) -> pa.RecordBatch:
    size = int.from_bytes(piece[:8], "little")
    data = memoryview(pa.Codec("zstd").decompress(piece[8:], decompressed_size=size, asbytes=True))
    n, count = np.frombuffer(data, dtype="<i8", count=2)
    ends = np.cumsum(np.frombuffer(data, dtype="<i8", count=count, offset=16)) + 16 + 8 * count
    chunks = (data[a:b] for a, b in zip([16 + 8 * int(count), *ends[:-1]], ends, strict=True))
    return pa.RecordBatch.from_arrays([_read(field.type, int(n), chunks) for field in schema], schema=schema)


def _packed(batches: Iterator[pa.RecordBatch], schema: pa.Schema, most: int) -> Iterator[pa.RecordBatch]:
    """Rows whose last column is the target task, as ``(task, piece)``."""
    held: list[pa.RecordBatch] = []
    size = 0

    def dealt() -> pa.RecordBatch:
        rows = pa.Table.from_batches(held)
        to = rows.column(rows.num_columns - 1).to_numpy()
        order = np.argsort(to, kind="stable")
        to, taken = to[order], pa.array(order)
        first = np.flatnonzero(np.diff(to, prepend=-1))
        columns = [rows.column(i).cast(field.type).combine_chunks().take(taken) for i, field in enumerate(schema)]
        columns = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in columns]
        pieces = [pack([c.slice(a, b - a) for c in columns]) for a, b in zip(first, [*first[1:], len(to)], strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(to[first], pa.int32()), pa.array(pieces, pa.binary())], names=["to", "piece"])

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            size += batch.nbytes
        if size >= most:
            yield dealt()
            held, size = [], 0
            pa.default_memory_pool().release_unused()
    if held:
        yield dealt()


def deal(rows: DataFrame, tasks: int, *by: str, work: Callable[[pa.Table], Iterator[pa.RecordBatch]] | None = None,
         schema: StructType | str | None = None) -> DataFrame:
    """``rows`` in ``tasks`` partitions by the hash of the columns ``by``, in no order.

    With ``work``, what it makes (``schema``) of all rows of a task that has any.
    """
    kinds, most = to_arrow_schema(rows.schema), PACK_BYTES
    to = F.pmod(F.xxhash64(*by), F.lit(tasks)).cast("int")
    pieces = rows.select("*", to.alias("_to")).mapInArrow(lambda batches: _packed(batches, kinds, most), "to int, piece binary") \
        .repartitionById(tasks, "to").select("piece")

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in batch.column(0):
                yield unpack(piece.as_py(), kinds)

    def worked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if held := list(opened(batches)):
            yield from work(pa.Table.from_batches(held))

    return pieces.mapInArrow(worked, schema) if work else pieces.mapInArrow(opened, rows.schema)
