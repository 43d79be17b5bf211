"""Hard negatives of anchor vectors, by filtering on segment summaries.

Components become integers; a row's score is its integer inner product with
the anchor.  Every vector is stored with the mean and the deviation (norm of
what the mean leaves) of its segments, at ``LEVELS`` segments a vector.  A
segment of ``w`` components contributes ``w * mean * mean`` to the inner
product, give or take the product of the deviations, so the sums over the
segments bound a score from both sides.  Candidates whose bounds cannot
reach an anchor's list are left at one segment, the others refined to more
and more segments; only what passes the finest level is scored exactly.

Two searches run this way: the anchor's best rows of its own label (its
positives), then for each of them the best rows of other labels that score
between ``FLOOR`` percent of the positive's score and that score.

Vectors lie in tiles of ``TILE_ROWS`` rows at most (fewer where vectors are
long).  Anchors are dealt into blocks of about ``BLOCK_ANCHORS``, tiles
into groups of about ``GROUP_TILES``; a task holds a block and lets a
group's tiles pass, keeping the best few of each list.  Only those few meet
in the window over all groups, so no group of rows is held whole.

Defined cases: rows whose id, label or vector is NULL, or that hold a NULL
or non-finite component (also once multiplied), take no part; rows that
share an id count once, with their smallest (label, vector); missing
components of shorter vectors count as 0; ties go to the smaller id; scores
beyond a long are its ends; a positive with a negative score has no
negatives; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

ANCHOR_EVERY = 100
POSITIVES = 5
NEGATIVES = 5
FLOOR = 80  # percent of the positive's score that a negative reaches
SCALE = 256
LEVELS = (1, 4, 16)  # segments a vector
TILE_ROWS = 1024
TILE_BYTES = 1 << 22
GROUP_TILES = 16
BLOCK_ANCHORS = 4096
TOGETHER = 256  # anchors of a block that meet a tile at a time
MAX_TASKS = 10_000
LONG = np.iinfo(np.int64)


def mining_rows(embeddings: DataFrame) -> DataFrame:
    """``(vec_id, label, vector array<double>)``: the rows that take part, labels shifted and components made whole."""
    e = F.col("embedding").cast("array<double>")
    finite = F.forall(e, lambda c: F.coalesce(F.abs(c * SCALE) < float("inf"), F.lit(False)))
    label, vec_id = F.col("label").cast("long"), F.col("vec_id").cast("long")
    rows = embeddings.where(vec_id.isNotNull() & label.isNotNull() & F.col("embedding").isNotNull() & finite).select(
        vec_id.alias("vec_id"), F.when(vec_id % 7 == 0, (label + 1) % 10).otherwise(label).alias("label"), e.alias("vector"))
    return rows.groupBy("vec_id").agg(F.min(F.struct("label", "vector")).alias("row")) \
        .select("vec_id", "row.label", "row.vector")


def matrix(vectors: pa.ListArray, width: int) -> np.ndarray:
    """Whole components ``floor(SCALE * x)``, shorter vectors filled with 0."""
    flat = vectors.flatten().to_numpy(zero_copy_only=False)
    sizes = vectors.value_lengths().to_numpy(zero_copy_only=False)
    x = np.zeros((len(sizes), width))
    x[np.arange(width) < sizes[:, None]] = np.floor(SCALE * flat)
    return x


def summaries(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Means and deviations of the segments of all levels, side by side."""
    means, deviations = [], []
    with np.errstate(over="ignore", invalid="ignore"):
        for n in LEVELS:
            parts = x.reshape(len(x), n, -1)
            mean = parts.mean(axis=2)
            means.append(mean)
            deviations.append(np.sqrt(((parts - mean[:, :, None]) ** 2).sum(axis=2)))
    return np.concatenate(means, axis=1), np.concatenate(deviations, axis=1)


@dataclass
class Vectors:
    """Rows of a tile or of an anchor block."""

    ids: np.ndarray
    labels: np.ndarray
    x: np.ndarray
    means: np.ndarray
    deviations: np.ndarray

    def take(self, at: np.ndarray | slice) -> Vectors:
        return Vectors(self.ids[at], self.labels[at], self.x[at], self.means[at], self.deviations[at])


def exact_scores(a: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Integer inner products as int64; beyond its range the nearest long."""
    largest = [float(np.abs(m).max(initial=0)) for m in (a, c)]
    if largest[0] * largest[1] * a.shape[1] < 2.0**53:
        return (a @ c.T).astype(np.int64)
    wide = [np.array([[int(v) for v in row] for row in m], dtype=object).reshape(m.shape) for m in (a, c)]
    return np.clip(wide[0] @ wide[1].T, LONG.min, LONG.max).astype(np.int64)


def survivors(a: Vectors, c: Vectors, wanted: np.ndarray,
              open_to: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The columns of ``c`` left after all levels, and which (anchor, column) pairs are.

    ``open_to(upper, lower)`` tells which pairs can still enter a list; bounds come with
    a margin for rounding, and pairs whose bounds overflow stay.
    """
    cols = np.flatnonzero(wanted.any(axis=0))
    left, at = wanted[:, cols], 0
    with np.errstate(over="ignore", invalid="ignore"):
        norms = [np.sqrt(np.square(v.x).sum(axis=1)) for v in (a, c)]
        for n in LEVELS:
            if not len(cols):
                break
            level, at = slice(at, at + n), at + n
            middle = (a.x.shape[1] // n) * (a.means[:, level] @ c.means[cols, level].T)
            spread = a.deviations[:, level] @ c.deviations[cols, level].T
            spread += 0.5 + 1e-9 * norms[0][:, None] * norms[1][cols]
            left &= open_to(np.clip(middle + spread, -2.0**63, 2.0**63), np.clip(middle - spread, -2.0**63, 2.0**63))
            keep = left.any(axis=0)
            cols, left = cols[keep], left[:, keep]
    return cols, left


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` highest scores, ties by the smaller id."""
    if len(scores) > 8 * k:
        near = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
        return near[np.lexsort((ids[near], ~scores[near]))[:k]]
    return np.lexsort((ids, ~scores))[:k]


class Lists:
    """The best ``k`` (score, id) found so far of every list: ``low <= score <= high`` of its anchor's row."""

    def __init__(self, anchor: np.ndarray, low: np.ndarray, high: np.ndarray, k: int):
        self.anchor, self.low, self.high, self.k = anchor, low, high, k
        self.reach = low.copy()  # what a newcomer has to score
        self.found: list[tuple[np.ndarray, np.ndarray]] = [(np.empty(0, np.int64), np.empty(0, np.int64))] * len(anchor)

    def offer(self, n: int, scores: np.ndarray, ids: np.ndarray) -> None:
        fits = (scores >= self.reach[n]) & (scores <= self.high[n])
        if not fits.any():
            return
        s, i = (np.concatenate(p) for p in zip(self.found[n], (scores[fits], ids[fits]), strict=True))
        top = best(s, i, self.k)
        self.found[n] = s[top], i[top]
        if len(top) == self.k:
            self.reach[n] = s[top[-1]]


def search(anchors: Vectors, tiles: Iterator[Vectors], lists: Lists, same_label: bool) -> int:
    """Fills the lists, sorted by anchor row; returns the number of pairs scored exactly."""
    exact = 0
    parts = [slice(i, i + TOGETHER) for i in range(0, len(anchors.ids), TOGETHER)]
    blocks = [(anchors.take(p), *np.searchsorted(lists.anchor, (p.start, p.stop))) for p in parts]
    for tile in tiles:
        for part, (a, first, end) in zip(parts, blocks, strict=True):
            if first == end:
                continue
            rows = lists.anchor[first:end] - part.start

            def open_to(upper: np.ndarray, lower: np.ndarray, rows=rows, first=first, end=end) -> np.ndarray:
                shut = np.ones(upper.shape, dtype=bool)
                reach, high = lists.reach[first:end].astype(np.float64), lists.high[first:end].astype(np.float64)
                for n, r in enumerate(rows):
                    shut[r] &= (upper[r] < reach[n]) | (lower[r] > high[n])
                return ~shut

            wanted = (a.labels[:, None] == tile.labels) == same_label
            wanted &= a.ids[:, None] != tile.ids
            cols, left = survivors(a, tile, wanted, open_to)
            if not len(cols):
                continue
            scores, ids = exact_scores(a.x, tile.x[cols]), tile.ids[cols]
            exact += left.sum()
            for n, r in enumerate(rows):
                if left[r].any():
                    lists.offer(first + n, scores[r, left[r]], ids[left[r]])
    return exact


def tiles_of(rows: DataFrame, width: int) -> DataFrame:
    """``(tile, ids, labels, x, means, deviations)``: vectors in tiles, each array as bytes."""
    size = max(1, min(TILE_ROWS, TILE_BYTES // (8 * width)))
    schema = pa.schema([("tile", pa.int64())] + [(n, pa.binary()) for n in ("ids", "labels", "x", "means", "deviations")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, size):
                part = batch.slice(at, size)
                ids, labels = (part.column(i).to_numpy(zero_copy_only=False).astype("<i8") for i in (0, 1))
                x = matrix(part.column(2), width)
                arrays = (ids, labels, x, *summaries(x))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([int(ids.min())]), *[pa.array([a.tobytes()], type=pa.binary()) for a in arrays]], schema=schema)

    return rows.select("vec_id", "label", "vector").mapInArrow(
        run, "tile long, ids binary, labels binary, x binary, means binary, deviations binary")


def read_tile(row: dict, width: int) -> Vectors:
    of = lambda c, dtype="<f8": np.frombuffer(row[c], dtype=dtype)
    segments = sum(LEVELS)
    return Vectors(of("ids", "<i8"), of("labels", "<i8"), of("x").reshape(-1, width),
                   of("means").reshape(-1, segments), of("deviations").reshape(-1, segments))


def lists_of(bands: pa.ListArray, same_label: bool) -> tuple[Lists, list[int]]:
    """One list for each anchor and band ``(positive_id, positive_score)``; the positives' search has one open band."""
    anchor, low, high, ids = [], [], [], []
    for row, found in enumerate(bands.to_pylist()):
        for band in found:
            score = band["positive_score"]
            anchor.append(row)
            ids.append(band["positive_id"])
            low.append(LONG.min if same_label else max(LONG.min, -(-FLOOR * score // 100)))
            high.append(LONG.max if same_label else score)
    arrays = (np.array(a, dtype=np.int64) for a in (anchor, low, high))
    return Lists(*arrays, POSITIVES if same_label else NEGATIVES), ids


def _meet(anchors: DataFrame, tiles: DataFrame, width: int, same_label: bool) -> DataFrame:
    """``(anchor_id, positive_id, vec_id, score)``: the best of every tile group for each list.

    ``anchors(vec_id, label, vector, bands)``; the rows of a cell come anchors first.
    """
    blocks = max(1, -(-anchors.count() // BLOCK_ANCHORS))
    groups = max(1, -(-tiles.count() // GROUP_TILES))
    cell = (F.col("block") * groups + F.col("group")).alias("cell")
    asked = anchors.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks))) \
        .withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))) \
        .select(cell, F.lit(0).alias("kind"), "vec_id", "label", "vector", "bands")
    passing = tiles.withColumn("group", F.pmod(F.xxhash64("tile"), F.lit(groups))) \
        .withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))) \
        .select(cell, F.lit(1).alias("kind"), "ids", "labels", "x", "means", "deviations")
    schema = pa.schema([(n, pa.int64()) for n in ("anchor_id", "positive_id", "vec_id", "score")])

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, pa.RecordBatch]]:
        for batch in batches:
            cells, kinds = (batch.column(n).to_numpy() for n in ("cell", "kind"))
            cuts = np.flatnonzero((np.diff(cells) != 0) | (np.diff(kinds) != 0)) + 1
            for low, high in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
                if low < high:
                    yield int(cells[low]), int(kinds[low]), batch.slice(low, high - low)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, lists, positives, held, now = None, None, [], [], None

        def done() -> Iterator[pa.RecordBatch]:
            for n, (scores, ids) in enumerate(lists.found):
                if len(ids):
                    one = np.ones(len(ids), dtype=np.int64)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(v) for v in (one * block.ids[lists.anchor[n]], one * positives[n], ids, scores)], schema=schema)

        for cell, kind, rows in runs(batches):
            if cell != now:
                if lists:
                    yield from done()
                block, lists, held, now = None, None, [], cell
            if kind == 0:
                held.append(rows.select(["vec_id", "label", "vector", "bands"]))
                continue
            if lists is None:
                if not held:
                    continue  # a block without anchors
                table = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                x = matrix(table.column(2), width)
                block = Vectors(table.column(0).to_numpy(), table.column(1).to_numpy(), x, *summaries(x))
                lists, positives = lists_of(table.column(3), same_label)
            each = (read_tile(row, width) for i in range(rows.num_rows) for row in rows.slice(i, 1).to_pylist())
            search(block, each, lists, same_label)
        if lists:
            yield from done()

    return asked.unionByName(passing, allowMissingColumns=True).repartition(min(MAX_TASKS, blocks * groups), "cell") \
        .sortWithinPartitions("cell", "kind").mapInArrow(run, "anchor_id long, positive_id long, vec_id long, score long")


def _first(found: DataFrame, keys: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def hard_negatives(embeddings: DataFrame, anchor_every: int = ANCHOR_EVERY) -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)``."""
    rows = stored(mining_rows(embeddings), "negatives-rows")
    longest = rows.agg(F.max(F.size("vector")).alias("n")).first()["n"] or 1
    width = -(-longest // LEVELS[-1]) * LEVELS[-1]
    tiles = stored(tiles_of(rows, width), "negatives-tiles")
    open_band = F.array(F.struct(F.lit(0).cast("long").alias("positive_id"), F.lit(0).cast("long").alias("positive_score")))
    anchors = rows.where(F.col("vec_id") % anchor_every == 0)
    near = _meet(anchors.withColumn("bands", open_band), tiles, width, same_label=True)
    positives = stored(_first(near, ["anchor_id"], POSITIVES), "negatives-positives")
    bands = positives.groupBy(F.col("anchor_id").alias("vec_id")).agg(F.collect_list(F.struct(
        F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))).alias("bands"))
    banded = stored(anchors.join(bands, "vec_id"), "negatives-anchors")
    found = _first(_meet(banded, tiles, width, same_label=False), ["anchor_id", "positive_id"], NEGATIVES)
    scores = positives.select("anchor_id", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    return found.join(scores, ["anchor_id", "positive_id"]).select(
        "anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score",
        F.col("score").alias("negative_score"))
