"""The few expressions Spark has no built-in for, as Arrow-batched UDFs.

Each works on a whole Arrow batch with vectorised pyarrow / numpy calls;
callers apply them to distinct values where that shrinks the work.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.arrow_udf(T.StringType())
def nfd(text: pa.Array) -> pa.Array:
    """B1: Unicode NFD (Spark has no normalisation function)."""
    return pc.utf8_normalize(text, "NFD")


@F.arrow_udf(T.ArrayType(T.IntegerType()))
def segment_starts(segments: pa.Array) -> pa.Array:
    """Code-point start offset of every segment in a tiling of a text.

    The segments of one row cover its text end to end, so each start is
    the running sum of the preceding lengths: one cumulative sum over the
    flattened batch, rebased at each row's first segment.
    """
    if isinstance(segments, pa.ChunkedArray):
        segments = segments.combine_chunks()
    lengths = pc.list_value_length(segments).fill_null(0).to_numpy(zero_copy_only=False)
    flat = pc.list_flatten(segments)
    seg_len = pc.utf8_length(flat).to_numpy(zero_copy_only=False).astype(np.int64)
    running = np.cumsum(seg_len) - seg_len
    offsets = np.zeros(len(lengths) + 1, dtype=np.int64)
    np.cumsum(lengths, out=offsets[1:])
    row_first = np.repeat(offsets[:-1], lengths)
    base = running[row_first] if len(row_first) else running
    starts = (running - base).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(starts),
                                    mask=segments.is_null())


def _rotl(x: np.ndarray, r: int) -> np.ndarray:
    return (x << np.uint32(r)) | (x >> np.uint32(32 - r))


def _mixed(k: np.ndarray) -> np.ndarray:
    return _rotl(k * np.uint32(0xCC9E2D51), 15) * np.uint32(0x1B873593)


def murmur3_32(data: np.ndarray, seed: int = 0) -> np.ndarray:
    """Unsigned MurmurHash3 x86 32-bit (public algorithm) of every row of a
    ``(n, length)`` byte matrix."""
    n, length = data.shape
    h = np.full(n, seed, dtype=np.uint32)
    whole = length // 4
    if whole:
        body = np.ascontiguousarray(data[:, :4 * whole]).view("<u4")
        for i in range(whole):
            h = _rotl(h ^ _mixed(body[:, i]), 13) * np.uint32(5) + np.uint32(0xE6546B64)
    if length % 4:
        tail = np.zeros((n, 4), dtype=np.uint8)
        tail[:, :length % 4] = data[:, 4 * whole:]
        h ^= _mixed(tail.view("<u4")[:, 0])
    h ^= np.uint32(length)
    for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
        h = (h ^ (h >> np.uint32(shift))) * np.uint32(factor)
    return h ^ (h >> np.uint32(16))


@F.arrow_udf(T.LongType())
def murmur3_unsigned(terms: pa.Array) -> pa.Array:
    """B12 helper: unsigned murmur3_32 (seed 0) of each UTF-8 term; terms of
    the same length are hashed together."""
    if isinstance(terms, pa.ChunkedArray):
        terms = terms.combine_chunks()
    raw = terms.cast(pa.large_binary())
    lengths = pc.binary_length(raw).fill_null(-1).to_numpy(zero_copy_only=False)
    out = np.zeros(len(terms), dtype=np.int64)
    for length in np.unique(lengths[lengths >= 0]):
        at = np.flatnonzero(lengths == length)
        data = b"".join(raw.take(pa.array(at)).to_pylist())
        out[at] = murmur3_32(np.frombuffer(data, dtype=np.uint8).reshape(len(at), int(length)))
    return pa.array(out, mask=lengths < 0)
