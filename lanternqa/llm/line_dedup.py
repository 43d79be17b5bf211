"""Line dedup: two Bloom filters find suspects, only suspects are shuffled.

1. Every task hashes the keys of its documents' lines (each key once per
   document) and sends the 8-byte hashes, dealt by hash range into
   segments, never the lines; a hash that a task met more often is sent
   twice.  A segment owns a slice of both filters: a hash that the *once*
   filter already holds goes into the *twice* filter.  The once filter
   stays in the segments, sized to the hashes they get; only the twice
   filter leaves them.  Segments grow in number with the shuffle
   partitions, so each stays small.
2. The twice filter has a fixed size (``TWICE_BITS``), whatever the input,
   and is broadcast.  Lines whose hash it holds are suspects: every key of
   two or more documents, and some by chance - a fuller filter costs more
   suspects, never a wrong result.
3. Suspects are counted exactly by their whole key; a key in enough
   documents is confirmed with the largest id that holds it, its keeper.
4. Confirmed keys meet the suspects' ids by a 128-bit hash; each document
   gets the hashes it loses and is joined with them once.

Defined cases: a NULL or empty text is one empty line; rows that share a
``doc_id`` are one document for counting and lose the same keys; NULL ids
count as one document, sort below every id and lose lines like any other;
an empty table gives an empty result; extra columns are ignored by
``dedup_lines`` and kept by ``deduplicated_documents``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import compacted, id_and_text, in_parts, stored

MIN_CHARS = 40
MIN_DOCS = 5
MAX_SEGMENTS = 1 << 16
TWICE_BITS = 1 << 27  # 16 MiB, the whole broadcast
ONCE_BITS_PER_HASH = 8
HASHES = 2  # bits set for each hash in either filter
FLUSH = 1 << 18  # hashes a task holds before it sends them
WHITE = b" \t\n\x0b\x0c\r"


def line_keys(text: str | None) -> list[bytes]:
    """The key of every line: ASCII white space stripped at both ends, A-Z lower-cased."""
    return [line.strip(WHITE).lower() for line in (text or "").encode("utf-8", "surrogatepass").split(b"\n")]


def code_points(key: bytes) -> int:
    return len(key) if key.isascii() else len(key.decode("utf-8", "surrogatepass"))


def _long_keys(text: str | None, min_chars: int) -> set[bytes]:
    return {k for k in line_keys(text) if len(k) >= min_chars and code_points(k) >= min_chars}


def _bits(hashes: np.ndarray, size: int) -> np.ndarray:
    """``(HASHES, n)`` bit numbers below ``size`` by double hashing of the lower hash bits."""
    low, step = hashes & np.uint64(0xFFFFFFF), (hashes >> np.uint64(28)) & np.uint64(0xFFFFFFF) | np.uint64(1)
    return np.stack([(low + np.uint64(i) * step) % np.uint64(size) for i in range(HASHES)]).astype(np.int64)


def _has(filter_: np.ndarray, bits: np.ndarray) -> np.ndarray:
    held = np.ones(bits.shape[1], dtype=bool)
    for row in bits:
        held &= (filter_[row >> 3] >> (row & 7).astype(np.uint8)) & 1 == 1
    return held


def _put(filter_: np.ndarray, bits: np.ndarray) -> None:
    flat = bits.ravel()
    np.bitwise_or.at(filter_, flat >> 3, np.uint8(1) << (flat & 7).astype(np.uint8))


def _segment_of(hashes: np.ndarray, segments: int) -> np.ndarray:
    """The top bits: the hash range of a power of two of segments."""
    return (hashes >> np.uint64(65 - segments.bit_length())).astype(np.int64)


def segments_for(spark: SparkSession) -> int:
    """Four segments, at least, for each shuffle partition; a power of two from 64 to ``MAX_SEGMENTS``."""
    wanted = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    return min(MAX_SEGMENTS, max(64, 1 << (wanted - 1).bit_length()))


def hash_blocks(docs: DataFrame, min_chars: int, segments: int) -> DataFrame:
    """``(segment, hashes binary)``: the 64-bit key hashes, each key once per document."""
    schema = pa.schema([("segment", pa.int32()), ("hashes", pa.binary())])

    def send(found: list[int]) -> pa.RecordBatch:
        h, n = np.unique(np.array(found, dtype=np.uint64), return_counts=True)  # in order, so by segment
        h = np.repeat(h, np.minimum(n, 2))
        seg = _segment_of(h, segments)
        cut = np.flatnonzero(np.diff(seg)) + 1
        return pa.RecordBatch.from_arrays(
            [pa.array(seg[np.concatenate(([0], cut))], type=pa.int32()),
             pa.array([p.tobytes() for p in np.split(h, cut)], type=pa.binary())], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[int] = []
        for batch in in_parts(batches):
            for text in batch.column(1):
                found += [xxhash.xxh64_intdigest(k) for k in _long_keys(text.as_py(), min_chars)]
                if len(found) >= FLUSH:
                    yield send(found)
                    found = []
        if found:
            yield send(found)

    return docs.select("doc_id", "text").mapInArrow(run, "segment int, hashes binary")


def twice_filter(docs: DataFrame, min_chars: int, segments: int, twice_bits: int = TWICE_BITS) -> bytes:
    """The filter of hashes seen twice or more: ``twice_bits`` bits, segment after segment."""
    slice_bits = twice_bits // segments
    schema = pa.schema([("segment", pa.int32()), ("bits", pa.binary())])

    def build(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = [np.frombuffer(b.as_py(), dtype=np.uint64) for batch in batches for b in batch.column(1)]
        size = max(1024, ONCE_BITS_PER_HASH * sum(map(len, blocks)))
        once, twice = np.zeros(size // 8 + 1, dtype=np.uint8), np.zeros(slice_bits // 8, dtype=np.uint8)
        for block in blocks:
            hashes, n = np.unique(block, return_counts=True)
            bits = _bits(hashes, size)
            again = _has(once, bits) | (n > 1)
            _put(twice, _bits(hashes[again], slice_bits))
            _put(once, bits)
        yield pa.RecordBatch.from_arrays(
            [pa.array([key[0].as_py()], type=pa.int32()), pa.array([twice.tobytes()], type=pa.binary())], schema=schema)

    slices = hash_blocks(docs, min_chars, segments).groupBy("segment") \
        .applyInArrow(build, "segment int, bits binary")
    whole = bytearray(twice_bits // 8)
    for row in slices.collect():  # segments * slice_bits = twice_bits, whatever the input
        at = row["segment"] * slice_bits // 8
        whole[at:at + slice_bits // 8] = row["bits"]
    return bytes(whole)


def suspects(docs: DataFrame, min_chars: int = MIN_CHARS, twice_bits: int = TWICE_BITS) -> DataFrame:
    """``(doc_id, key, h binary)``: keys that the twice filter holds, once per row of ``docs``."""
    spark = docs.sparkSession
    segments = segments_for(spark)
    shared = spark.sparkContext.broadcast(twice_filter(docs, min_chars, segments, twice_bits))
    slice_bits = twice_bits // segments
    schema = pa.schema([("doc_id", pa.int64()), ("key", pa.string()), ("h", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        twice = np.frombuffer(shared.value, dtype=np.uint8)
        for batch in in_parts(batches):
            ids, keys = [], []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own = _long_keys(text.as_py(), min_chars)
                keys += own
                ids += [i] * len(own)
            if not keys:
                continue
            h = np.array([xxhash.xxh64_intdigest(k) for k in keys], dtype=np.uint64)
            hit = np.flatnonzero(_has(twice, _bits(h, slice_bits) + _segment_of(h, segments) * slice_bits))
            yield pa.RecordBatch.from_arrays(
                [pa.array([ids[j] for j in hit], type=pa.int64()),
                 pa.array([keys[j].decode("utf-8", "surrogatepass") for j in hit], type=pa.string()),
                 pa.array([xxhash.xxh3_128_digest(keys[j]) for j in hit], type=pa.binary())], schema=schema)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, key string, h binary")


def lost_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS,
               twice_bits: int = TWICE_BITS) -> DataFrame:
    """``(doc_id, lost array<binary>)``: the key hashes whose lines a document loses."""
    found = stored(suspects(docs, min_chars, twice_bits), "line-suspects")
    # one row per key and document, then per key: hot keys shrink in every task first
    confirmed = found.select("key", "h", "doc_id").distinct() \
        .groupBy("key", "h").agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("keeper")) \
        .where(F.col("n") >= min_docs).select("h", "keeper")
    confirmed = compacted(confirmed, "line-confirmed")
    lost = found.select("doc_id", "h").join(confirmed, "h") \
        .where(~F.col("doc_id").eqNullSafe(F.col("keeper")))
    return lost.groupBy("doc_id").agg(F.collect_set("h").alias("lost"))


def _without(text: str, lost: set[bytes]) -> tuple[str, int, int]:
    """The text without its lost lines, its lines before, and how many went."""
    lines = text.split("\n")
    if not lost:
        return text, len(lines), 0
    kept = [line for line, key in zip(lines, line_keys(text), strict=True) if xxhash.xxh3_128_digest(key) not in lost]
    return "\n".join(kept), len(lines), len(lines) - len(kept)


def _with_lost(docs: DataFrame, id_col: str, text_col: str, **limits: int) -> DataFrame:
    """``docs`` plus ``__lost`` (NULL where nothing goes)."""
    lost = lost_lines(id_and_text(docs, id_col, text_col), **limits) \
        .select(F.col("doc_id").alias("__id"), F.col("lost").alias("__lost"))
    return docs.join(lost, F.col(id_col).cast("long").eqNullSafe(F.col("__id")), "left").drop("__id")


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS,
                id_col: str = "doc_id", text_col: str = "text", with_text: bool = True) -> DataFrame:
    """``(doc_id, n_lines, n_dropped, kept_sha256[, text])`` for every document.

    Keys of at least ``min_chars`` code points found in at least
    ``min_docs`` documents lose all their lines, except in the largest
    ``doc_id`` that holds them.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    src = _with_lost(docs, "doc_id", "text", min_chars=min_chars, min_docs=min_docs)
    fields = [("doc_id", pa.int64()), ("n_lines", pa.int64()), ("n_dropped", pa.int64()), ("kept_sha256", pa.string())]
    ddl = "doc_id long, n_lines long, n_dropped long, kept_sha256 string"
    if with_text:
        fields.append(("text", pa.string()))
        ddl += ", text string"
    schema = pa.schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_parts(batches):
            out: list[list] = [[], [], [], []]
            for text, lost in zip(batch.column(1), batch.column(2), strict=True):
                kept, n, gone = _without(text.as_py() or "", set(lost.as_py() or ()))
                digest = hashlib.sha256(kept.encode("utf-8", "surrogatepass")).hexdigest()
                for column, value in zip(out, (n, gone, digest, kept), strict=True):
                    column.append(value)
            columns = [batch.column(0), *out[:4 if with_text else 3]]
            yield pa.RecordBatch.from_arrays(
                [c if isinstance(c, pa.Array) else pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)],
                schema=schema)

    return src.select("doc_id", "text", "__lost").mapInArrow(run, ddl)


def deduplicated_documents(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS,
                           id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the lost lines taken out of the text; every other column as it was.

    A NULL text stays NULL.
    """
    src = _with_lost(docs, id_col, text_col, min_chars=min_chars, min_docs=min_docs)

    @F.arrow_udf("string")
    def cleaned(text: pa.Array, lost: pa.Array) -> pa.Array:
        return pa.array((None if not t.is_valid else _without(t.as_py(), set(gone.as_py()))[0]
                         for t, gone in zip(text, lost, strict=True)), type=pa.string())

    # only the texts that lose something are handed to Python
    some = F.col("__lost").isNotNull()
    text = F.when(some, cleaned(F.when(some, F.col(text_col)), F.coalesce("__lost", F.array().cast("array<binary>")))) \
        .otherwise(F.col(text_col))
    return src.select(*[text.alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns])
