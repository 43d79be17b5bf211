"""SimHash near-duplicates through an inverted index of fingerprint bytes.

A fingerprint's eight bytes are its positional features.  Fingerprints
within ``max_bits`` differing bits differ in at most ``max_bits`` bytes,
so a linked pair shares at least ``8 - max_bits`` positional bytes: that
is the guaranteed minimum of the count filter.  Postings of single bytes
would hold 1/256 of all documents each; instead a posting is keyed by a
whole set of ``8 - max_bits`` positions with their bytes.  A pair's tally
of shared positional bytes reaches the minimum exactly if the pair meets
in such a posting, so no pair below it is ever looked at and none at or
above it is missed.  The fingerprints of one posting differ in
``max_bits`` bytes only, so a posting holds at most ``256 ** max_bits``
distinct ones however many documents there are; each looks up its
possible partners (flips of up to ``max_bits`` of the open bits), which
verifies the distance and costs time in proportion to the posting, and
the posting reports one star per group found instead of its pairs.

Copies collapse to one fingerprint before the index, documents meet their
group again by a join on the fingerprint.

Defined cases: a NULL or empty text, and one without words, has
fingerprint zero and is linked like any other; fewer words than a shingle
form one shingle; repeated rows and ties share a fingerprint; a row whose
id is NULL keeps its fingerprint, stands outside the groups and has a
NULL component; an empty table gives an empty result; extra input columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import compacted, id_and_text, map_texts, stored
from .components import connected_components

SHINGLE = 3
MAX_BITS = 2
SEED = 42
CHUNK = 1 << 16  # hashes whose bits are counted at a time


def simhash(text: str, shingle: int = SHINGLE) -> int:
    """The fingerprint as a signed 64-bit integer."""
    words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and [\x20\x09-\x0D] only
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        hashes = [xxhash.xxh64_intdigest(joined, SEED)]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1)
        starts = np.concatenate(([0], ends[:-shingle])).tolist()
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[s:e], SEED) for s, e in zip(starts, (ends[shingle - 1:] - 1).tolist(), strict=True)]
    ones = np.zeros(64, dtype=np.int64)
    raw = np.array(hashes, dtype="<u8")
    for i in range(0, len(raw), CHUNK):
        part = raw[i:i + CHUNK]
        ones += np.unpackbits(part.view(np.uint8).reshape(len(part), 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits((2 * ones > len(raw)).astype(np.uint8), bitorder="little")
    return int(bits.view("<i8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, fp long)`` for every row, no shuffle."""
    return map_texts(id_and_text(docs, id_col, text_col), lambda t: (simhash(t, shingle),),
                     [("fp", pa.int64(), "long")])


def _postings(max_bits: int) -> list[int]:
    """The byte masks (as signed longs) of every set of ``8 - max_bits`` positions."""
    masks = []
    for open_bytes in combinations(range(8), max_bits):
        mask = sum(0xFF << (8 * p) for p in range(8) if p not in open_bytes)
        masks.append(mask - (1 << 64) if mask >> 63 else mask)
    return masks


def _flips(mask: int, max_bits: int) -> np.ndarray:
    """Every way to flip 1 to ``max_bits`` of the bits that the mask leaves open."""
    free = [b for b in range(64) if not (mask >> b) & 1]
    return np.array([sum(1 << b for b in c) for n in range(1, max_bits + 1) for c in combinations(free, n)],
                    dtype=np.uint64)


def _stars(fps: np.ndarray, flips: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links ``(member, smallest member)`` of the groups within one posting.

    Every fingerprint looks its possible partners up among the sorted
    fingerprints; the smallest label is then passed along until it rests.
    """
    fps = np.unique(fps)
    n = len(fps)
    src, dst = [], []
    # look up whichever is fewer: the flips of each one, or each one's differences to all
    if n <= len(flips):
        for i in range(n - 1):
            hit = np.nonzero(np.bitwise_count(fps[i + 1:] ^ fps[i]) <= max_bits)[0] + i + 1
            src.append(np.full(len(hit), i))
            dst.append(hit)
    else:
        for f in flips:
            want = fps ^ f
            at = np.minimum(np.searchsorted(fps, want), n - 1)
            hit = np.nonzero((fps[at] == want) & (at > np.arange(n)))[0]
            src.append(hit)
            dst.append(at[hit])
    a, b = np.concatenate(src or [np.empty(0, int)]), np.concatenate(dst or [np.empty(0, int)])
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        after = label.copy()
        np.minimum.at(after, a, low)
        np.minimum.at(after, b, low)
        after = after[after]
        if (after == label).all():
            break
        label = after
    own = np.nonzero(label != np.arange(n))[0]
    return fps[own], fps[label[own]]


def similar_links(distinct: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Links ``(a, b)`` whose components are those of all pairs within ``max_bits``.

    ``distinct(fp long)``: each fingerprint once.
    """
    if not 0 < max_bits < 8:
        raise ValueError("max_bits must be 1 to 7")
    masks = _postings(max_bits)
    keys = F.array(*[F.struct(F.lit(i).cast("short").alias("set"),
                              F.col("fp").bitwiseAND(F.lit(m).cast("long")).alias("bytes"))
                     for i, m in enumerate(masks)])
    posted = distinct.select("fp", F.explode(keys).alias("k")).select("k.set", "k.bytes", "fp")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The postings of a batch of rows ``(set, fps array)``."""
        made: dict[int, np.ndarray] = {}
        for batch in batches:
            out_a, out_b = [], []
            for s, fps in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if s not in made:
                    made[s] = _flips(masks[s] & ((1 << 64) - 1), max_bits)
                a, b = _stars(fps.values.to_numpy().view(np.uint64), made[s], max_bits)
                out_a.append(a)
                out_b.append(b)
            if out_a:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(x).view(np.int64)) for x in (out_a, out_b)], schema=schema)

    # a posting's array is bounded by 256 ** max_bits fingerprints; most hold one and end here
    grouped = posted.groupBy("set", "bytes").agg(F.collect_list("fp").alias("fps")) \
        .where(F.size("fps") > 1).select("set", "fps")
    return grouped.mapInArrow(link, "a long, b long")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, fingerprint, component_id)``: 16 hex digits, smallest doc_id reachable."""
    prints = stored(fingerprints(docs, shingle, id_col, text_col), "simhash-prints")
    # hot fingerprints are reduced within each task before they are shuffled
    nodes = compacted(prints.where(F.col("doc_id").isNotNull()).groupBy("fp").agg(F.min("doc_id").alias("first_id")),
                      "simhash-nodes")
    groups = connected_components(similar_links(nodes.select("fp"), max_bits))
    linked = compacted(groups.join(nodes, groups["node"] == nodes["fp"]).select("fp", "first_id", "component"),
                       "simhash-linked")
    smallest = compacted(linked.groupBy("component").agg(F.min("first_id").alias("component_id")), "simhash-smallest")
    moved = linked.join(smallest, "component").select(F.col("fp").alias("moved"), "component_id")
    named = compacted(nodes.join(moved, nodes["fp"] == moved["moved"], "left")
                      .select("fp", F.coalesce("component_id", "first_id").alias("component_id")), "simhash-named")
    joined = prints.join(named, "fp", "left")
    return joined.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
                         F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def first_of_each_group(docs: DataFrame, groups: DataFrame) -> DataFrame:
    """The documents that stay: of each group the row with the smallest id.

    Rows that repeat this id are one document: the one whose columns sort
    first stays.  Rows without id stand outside the groups and stay.
    """
    reps = groups.where(F.col("doc_id") == F.col("component_id")).select(F.col("doc_id").alias("__rep")).distinct()
    columns = list(docs.columns)
    with_id = docs.where(F.col("doc_id").isNotNull()).join(reps, F.col("doc_id") == F.col("__rep"), "left_semi")
    order = Window.partitionBy("doc_id").orderBy(*[F.col(f"`{c}`") for c in columns])
    kept = with_id.withColumn("__n", F.row_number().over(order)).where(F.col("__n") == 1).drop("__n")
    return kept.select(*[F.col(f"`{c}`") for c in columns]).unionByName(docs.where(F.col("doc_id").isNull()))
