"""Near-equal shards by sampled splitters, in DataFrame and SQL functions only.

Records lie on a line by ``(key, tie)``.  A size-weighted sample gives
quantile splitters that cut the line into many fine ranges of about equal
bytes; the exact bytes of each range are then summed, ranges that turn
out overfull are cut again by splitters from a sample of their own, and
runs of whole ranges become shards by exact prefix sums.  A shard's rows
are numbered range by range, so no task ever holds a shard.

Only bounded things reach the driver: the sample (``RANGES * SAMPLES``
rows in expectation, whatever the input) and one row per range.

Defined cases: a NULL text has size 1 (no bytes, plus one) and the CRC of
the empty text; a NULL id sorts first among equal texts; repeated rows
(same id and text) stay in one range, in the order of their columns;
fewer records than shards leave shards empty; an empty table gives an
empty result; extra columns are ignored.
"""

from __future__ import annotations

import json
from bisect import bisect_right

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

RANGES = 2048  # fine ranges: a cut is off by half a range, 1/4096 of all bytes, at most
SAMPLES = 32  # draws for each range
GROUP = 64  # splitters under one top splitter
OVERFULL = 2.0  # times the mean, beyond which a range is cut again
LOWEST = -(1 << 63)


def _draws(records: DataFrame, total: Column, draws: int, seed: int) -> list[tuple[int, int, int]]:
    """A size-weighted sample ``(key, tie, copies)``: each record is drawn
    ``size * draws / total`` times in expectation (bounded: ``draws`` rows)."""
    u = F.pmod(F.xxhash64(F.lit(seed), F.col("key"), F.col("tie")), F.lit(1 << 53)) / float(1 << 53)
    copies = F.floor(F.col("size") * F.lit(float(draws)) / total + u)
    picked = records.select("key", "tie", copies.cast("long").alias("copies")).where(F.col("copies") > 0)
    return [tuple(r) for r in picked.collect()]


def quantile_splitters(sample: list[tuple[int, int, int]], parts: int) -> list[tuple[int, int]]:
    """``parts - 1`` keys, at most, that cut the weighted sample evenly; each starts a range."""
    sample = sorted(sample)
    whole, seen, cuts = sum(c for *_, c in sample), 0, []
    for key, tie, copies in sample:
        if seen * parts // whole != (seen + copies) * parts // whole and (not cuts or cuts[-1] != (key, tie)):
            cuts.append((key, tie))
        seen += copies
    return cuts


def range_of(splitters: list[tuple[int, int]]) -> Column:
    """Number of splitters at or below ``(key, tie)``, found in two steps."""
    groups = [splitters[i:i + GROUP] for i in range(0, len(splitters), GROUP)]
    if not groups:
        return F.lit(0)
    one = "struct<key: bigint, tie: bigint>"
    as_rows = lambda x: [{"key": k, "tie": t} for k, t in x]
    tops = F.from_json(F.lit(json.dumps(as_rows([g[0] for g in groups]))), f"array<{one}>")
    all_ = F.from_json(F.lit(json.dumps([as_rows(g) for g in groups])), f"array<array<{one}>>")

    def at_or_below(s: Column) -> Column:
        return (s["key"] < F.col("key")) | ((s["key"] == F.col("key")) & (s["tie"] <= F.col("tie")))

    top = F.size(F.filter(tops, at_or_below))
    inner = F.size(F.filter(F.element_at(all_, F.greatest(top, F.lit(1))), at_or_below))
    return F.when(top == 0, F.lit(0)).otherwise((top - 1) * GROUP + inner)


def _range_sizes(records: DataFrame, splitters: list[tuple[int, int]]) -> dict[int, tuple[int, int]]:
    """``{range: (bytes, rows)}``; one row per range reaches the driver."""
    rows = records.groupBy(range_of(splitters).alias("range")).agg(F.sum("size"), F.count(F.lit(1))).collect()
    return {r[0]: (r[1], r[2]) for r in rows}


def shard_records(records: DataFrame, n_shards: int = 16, ranges: int = RANGES, samples: int = SAMPLES) -> DataFrame:
    """``records(key long, tie long, size long, ...)`` plus ``shard`` and ``slot`` (gapless from 0).

    ``records`` should be a stored table: it is read once for the total, the
    sample and the range sizes each.  ``key`` and ``tie`` must not be NULL.
    """
    total = records.agg(F.sum("size").cast("long")).first()[0]
    splitters: list[tuple[int, int]] = []
    sizes: dict[int, tuple[int, int]] = {}
    if total:
        sample = _draws(records, F.lit(float(total)), ranges * samples, 1)
        splitters = quantile_splitters(sample, ranges)
        sizes = _range_sizes(records, splitters)
        overfull = [i for i, (b, n) in sizes.items() if b > OVERFULL * total / ranges and n > 1]
        if overfull:
            # as many draws for each overfull range as it has bytes above its share
            share = sum(sizes[i][0] for i in overfull)
            again = _draws(records.where(range_of(splitters).isin(overfull)), F.lit(float(share)),
                           min(ranges, 4 * share * ranges // total + 1) * samples, 2)
            by_range: dict[int, list] = {}
            for s in again:
                by_range.setdefault(bisect_right(splitters, s[:2]), []).append(s)
            extra = [c for i, s in by_range.items() for c in quantile_splitters(s, 1 + 2 * sizes[i][0] * ranges // total)]
            splitters = sorted({*splitters, *extra})
            sizes = _range_sizes(records, splitters)
    shards, starts, before = [], [], 0
    rows_in = [0] * n_shards
    for i in range(len(splitters) + 1):
        b, n = sizes.get(i, (0, 0))
        shard = min(n_shards - 1, int((2 * before + b) * n_shards // (2 * total))) if total else 0
        shards.append(shard)
        starts.append(rows_in[shard])
        rows_in[shard] += n
        before += b
    at = F.col("__range") + 1
    array = lambda x, kind: F.from_json(F.lit(json.dumps(x)), f"array<{kind}>")
    order = Window.partitionBy("__range").orderBy("key", "tie", "size")
    return records.withColumn("__range", range_of(splitters)) \
        .withColumn("shard", F.element_at(array(shards, "int"), at)) \
        .withColumn("slot", F.element_at(array(starts, "bigint"), at) + F.row_number().over(order) - 1) \
        .drop("__range")


def document_records(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, size, text_crc32, key, tie)``: equal texts share a key, so they lie side by side."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    doc_id = F.col(id_col).cast("long")
    return docs.select(doc_id.alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"),
                       F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("key"),
                       F.coalesce(doc_id, F.lit(LOWEST).cast("long")).alias("tie"))


def shard_documents(docs: DataFrame, n_shards: int = 16, ranges: int = RANGES, samples: int = SAMPLES,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, size, text_crc32, shard, slot)`` for every document, shards of near-equal bytes.

    The text is read once; what follows works on the narrow stored table.
    """
    records = stored(document_records(docs, id_col, text_col), "shard-records")
    return shard_records(records, n_shards, ranges, samples).select("doc_id", "size", "text_crc32", "shard", "slot")


def write_shards(docs: DataFrame, path: str, n_shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> None:
    """The documents as files in ``path/shard=N``, each shard written by several tasks.

    ``shard`` and ``slot`` are the operator's: input columns of these names are left out.
    """
    docs = docs.drop("shard", "slot", "text_crc32")
    placed = shard_documents(docs, n_shards, id_col=id_col, text_col=text_col).select(
        F.col("doc_id").alias("__id"), "text_crc32", "shard", "slot").dropDuplicates(["__id", "text_crc32"])
    crc = F.crc32(F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary"))
    joined = docs.withColumn("__crc", crc).join(
        placed, F.col(id_col).cast("long").eqNullSafe(F.col("__id")) & (F.col("__crc") == F.col("text_crc32")))
    joined.drop("__id", "__crc", "text_crc32").write.partitionBy("shard").parquet(path)
