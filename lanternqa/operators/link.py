"""F1-F8: spans -> mentions -> ranked entity candidates -> fused entities.

Dense retrieval (F5) is exact inner-product top-k.  The catalogue is dealt
into tiles of bounded bytes, the mentions (the stated query set) into blocks
of bounded rows and bytes.  A task holds a block and streams a tile's vectors
past it in falling norm: a score matrix is never larger than ``SCORE_ROWS x
ENTITY_BLOCK``, no task holds a tile, and vectors too short to reach a
mention's running k-th score are skipped.  Products are taken in single
precision; what could reach the k-th score by its error bound is scored in
double precision.  A vector is moved once for each block, a mention once for
each tile, in the precision it is stored in.  The shuffle after it carries at
most ``tiles x k`` rows for a mention.  Nothing passes through the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.constants import EMPTY_PASSAGE, ENTITY_CANDIDATES
from ..functions.text import strip_whitespace
from .tokens import with_token_spans

MENTION_BLOCK = 16_384
MENTION_BYTES = 16 << 20
LEAST_MENTIONS = 1024  # a block isn't made smaller than this to have work for every core
SCORE_ROWS = 512
ENTITY_BLOCK = 8192
TILE_BYTES = 64 << 20
MAX_TASKS = 10_000
SCORE_DIGITS = 6


def occurrences(preds: DataFrame) -> DataFrame:
    """one row per (prediction, document occurrence), numbered per question."""
    occ = preds.select("query_id", F.col("rank").alias("pred_rank"), "span",
                       F.posexplode_outer(F.arrays_zip("docs", "start_idx", "end_idx")).alias("occ", "o")) \
        .where(F.col("o").isNotNull())
    w = Window.partitionBy("query_id").orderBy("pred_rank", "occ")
    return occ.select("query_id", "pred_rank", "occ", "span",
                      F.col("o.docs").alias("doc_key"),
                      F.col("o.start_idx").alias("start_idx"), F.col("o.end_idx").alias("end_idx"),
                      (F.row_number().over(w) - 1).cast("long").alias("mention_idx"))


def mention_spans(occ: DataFrame, questions: DataFrame, docs: DataFrame) -> DataFrame:
    """token positions of the pair encoding -> character span in the document.

    A passage token at sequence index ``t`` is document token
    ``t - len(question tokens) - 2``; its offsets come from B3.  Each
    document that is mentioned is tokenised once; of its tokens only the
    wanted ones meet the mentions, and the text joins last.  The placeholder
    passage is its own document; any other unknown key raises.
    """
    texts = docs.select(F.col("doc_id").cast("string").alias("doc_key"), "text") \
        .unionByName(questions.sparkSession.createDataFrame([(EMPTY_PASSAGE, EMPTY_PASSAGE)], "doc_key string, text string")) \
        .join(occ.select("doc_key").distinct(), "doc_key", "left_semi")
    spans = with_token_spans(texts)
    qlen = questions.select("query_id", F.size(F.regexp_extract_all(
        "question", F.lit(r"[\p{L}\p{N}\p{M}]+|[^\p{Z}\p{C}]"), 0)).alias("qlen"))
    at = occ.join(qlen, "query_id").select(
        "query_id", "mention_idx", "pred_rank", "span", "doc_key",
        (F.col("start_idx") - F.col("qlen") - 2).cast("int").alias("s"),
        (F.col("end_idx") - F.col("qlen") - 2).cast("int").alias("e"))
    wanted = at.groupBy("doc_key").agg(F.collect_set(F.struct("s", "e")).alias("w"))
    found = wanted.join(spans, "doc_key").select("doc_key", F.inline(F.transform("w", lambda p: F.struct(
        p["s"].alias("s"), p["e"].alias("e"),
        F.try_element_at("toks", p["s"] + 1)["start"].cast("long").alias("char_start"),
        F.try_element_at("toks", p["e"] + 1)["end"].cast("long").alias("char_end")))))
    missing = F.raise_error(F.concat(F.lit("no such document: "), F.col("doc_key")))
    return at.join(found, ["doc_key", "s", "e"], "left") \
        .join(texts.withColumn("_found", F.lit(True)), "doc_key", "left") \
        .select("query_id", "mention_idx", "pred_rank", "span", "doc_key",
                F.when(F.col("_found"), F.col("text")).otherwise(missing.cast("string")).alias("text"),
                "char_start", "char_end")


def mention_context(ms: DataFrame) -> DataFrame:
    """lower-cased left context / mention / right context + constant fields."""
    st, en = F.col("char_start"), F.col("char_end")
    return ms.select(
        "query_id", "mention_idx", "span",
        F.lit(0).cast("long").alias("id"), F.lit("unknown").alias("label"),
        F.lit(-1).cast("long").alias("label_id"),
        F.lower(F.substring("text", F.lit(1), st)).alias("context_left"),
        F.lower(F.substring("text", st + 1, en - st)).alias("mention"),
        F.lower(F.substring("text", en + 1, F.length("text"))).alias("context_right"))


def mention_mismatch(mentions: DataFrame) -> DataFrame:
    """mentions whose text differs from the span once whitespace is removed."""
    return mentions.where(strip_whitespace(F.col("span")) != strip_whitespace(F.col("mention"))) \
        .select("query_id", "mention_idx", "span", "mention")


_FOUND = pa.schema([("mention_id", pa.int64()), ("entity_id", pa.int64()), ("score", pa.float64())])
_NO_ID = np.iinfo(np.int64).max


def _rounded(scores: np.ndarray) -> np.ndarray:
    """To ``SCORE_DIGITS`` digits, halves away from zero.  The only rounding: cuts and ranks are by the same values."""
    unit = 10.0**SCORE_DIGITS
    return np.sign(scores) * np.floor(np.abs(scores) * unit + 0.5) / unit


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Each row's first k ``(scores, ids)``, ties by id, filled up with minus infinity."""
    n, k_here = len(scores), min(k, scores.shape[1])
    least = np.partition(scores, scores.shape[1] - k_here, axis=1)[:, scores.shape[1] - k_here]
    rows, cols = np.nonzero((scores >= least[:, None]) & np.isfinite(scores))
    found = ids[rows, cols] if ids.ndim == 2 else ids[cols]
    order = np.lexsort((found, -scores[rows, cols], rows))
    rows, cols, found = rows[order], cols[order], found[order]
    nth = np.arange(len(rows)) - np.searchsorted(rows, rows)
    first = nth < k
    best, best_ids = np.full((n, k), -np.inf), np.full((n, k), _NO_ID)
    best[rows[first], nth[first]] = scores[rows[first], cols[first]]
    best_ids[rows[first], nth[first]] = found[first]
    return best, best_ids


class MentionBlock:
    """A block of mentions that a tile's vectors pass, with each one's best k so far."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int, exclude_self: bool):
        self.ids, self.vectors, self.k, self.exclude_self = ids, vectors, k, exclude_self
        self.norms = np.sqrt(np.square(vectors).sum(axis=1))
        self.best, self.best_ids = np.full((len(ids), k), -np.inf), np.full((len(ids), k), _NO_ID)
        self.scored = 0

    def meet(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        """Vectors come in falling norm: what the first can't reach by the Cauchy-Schwarz bound, none can."""
        for at in range(0, len(ids), ENTITY_BLOCK):
            some, part = ids[at:at + ENTITY_BLOCK], vectors[at:at + ENTITY_BLOCK]
            largest = np.sqrt(np.square(part).sum(axis=1).max())
            bound = self.norms * largest * (1 + 1e-9) + 10.0**-SCORE_DIGITS
            open_rows = np.flatnonzero(bound >= self.best[:, -1])
            if not len(open_rows):
                return
            self.scored += len(open_rows) * len(some)
            within = self.norms.max() * largest < 1e30  # else (or not finite) single precision could overflow
            single = part.astype(np.float32) if within else None
            for low in range(0, len(open_rows), SCORE_ROWS):
                rows = open_rows[low:low + SCORE_ROWS]
                if single is not None:
                    rows = self._meet_few(rows, some, part, single, largest)
                if len(rows):
                    self._meet_all(rows, some, part)

    def _meet_few(self, rows: np.ndarray, some: np.ndarray, part: np.ndarray, single: np.ndarray, largest: float) -> np.ndarray:
        """Scores the vectors that could reach the k-th score; returns the rows for which these aren't few."""
        begun = np.isfinite(self.best[rows, -1])
        left, rows = rows[~begun], rows[begun]
        if not len(rows):
            return left
        error = (part.shape[1] + 8) * 2.0**-23 * self.norms[rows] * largest
        reach = self.best[rows, -1] - error - 10.0**-SCORE_DIGITS
        reach32 = np.nextafter(reach.astype(np.float32), np.float32(-np.inf))
        can = self.vectors[rows].astype(np.float32) @ single.T >= reach32[:, None]
        few = np.count_nonzero(can, axis=1) <= 4 * self.k
        left = np.concatenate((left, rows[~few]))
        can[~few] = False
        at, cols = np.nonzero(can)
        if not len(at):
            return left
        scores = _rounded(np.einsum("ij,ij->i", self.vectors[rows[at]], part[cols]))
        if self.exclude_self:
            scores[self.ids[rows[at]] == some[cols]] = -np.inf
        hit = np.unique(at)  # as a matrix, filled up with minus infinity
        nth = np.arange(len(at)) - np.searchsorted(at, at)
        new, new_ids = np.full((len(hit), nth.max() + 1), -np.inf), np.full((len(hit), nth.max() + 1), _NO_ID)
        new[np.searchsorted(hit, at), nth], new_ids[np.searchsorted(hit, at), nth] = scores, some[cols]
        self._merge(rows[hit], new, new_ids)
        return left

    def _meet_all(self, rows: np.ndarray, some: np.ndarray, part: np.ndarray) -> None:
        scores = _rounded(self.vectors[rows] @ part.T)
        if self.exclude_self:
            scores[self.ids[rows, None] == some] = -np.inf
        self._merge(rows, *_best(scores, some, self.k))

    def _merge(self, rows: np.ndarray, new: np.ndarray, new_ids: np.ndarray) -> None:
        self.best[rows], self.best_ids[rows] = _best(np.concatenate((self.best[rows], new), axis=1),
                                                     np.concatenate((self.best_ids[rows], new_ids), axis=1), self.k)

    def found(self) -> pa.RecordBatch:
        rows, cols = np.nonzero(np.isfinite(self.best))
        return pa.RecordBatch.from_arrays([pa.array(self.ids[rows]), pa.array(self.best_ids[rows, cols]),
                                           pa.array(self.best[rows, cols])], schema=_FOUND)


def _vectors(batch: pa.RecordBatch) -> np.ndarray:
    flat = batch.column("embedding").flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(batch.num_rows, -1).astype(np.float64)


def grid(catalogue_bytes: int, mentions: int, mention_bytes: int, cores: int, tile_bytes: int) -> tuple[int, int]:
    """``(tiles, blocks)``: a vector of the catalogue is moved ``blocks`` times, a mention ``tiles`` times."""
    tiles = max(1, -(-catalogue_bytes // tile_bytes))
    busy = min(-(-cores // tiles), -(-mentions // LEAST_MENTIONS))
    return tiles, max(1, -(-mentions // MENTION_BLOCK), -(-mention_bytes // MENTION_BYTES), busy)


def dense_topk(mentions: DataFrame, catalogue: DataFrame, k: int = ENTITY_CANDIDATES,
               exclude_self: bool = False, tile_bytes: int = TILE_BYTES) -> DataFrame:
    """``(mention_id, rank, entity_id, score)`` by exact inner product.

    ``mentions(mention_id, embedding)``, ``catalogue(vec_id, embedding)``.
    Scores are rounded to 6 digits before ranking; ties go to the lower id.
    The catalogue is dealt into tiles of about ``tile_bytes``, the mentions
    into blocks of at most about ``MENTION_BLOCK`` rows and ``MENTION_BYTES``,
    smaller ones where there would be fewer tasks than cores.  A task holds
    a block of mentions and lets a tile's vectors pass in falling norm; a
    mention whose k-th score no later vector can reach is left out of the
    products.
    """
    bytes_of = F.coalesce(F.sum(8 * F.size("embedding")), F.lit(0))
    size = catalogue.agg(bytes_of).first()[0]
    n, held = mentions.agg(F.count(F.lit(1)), bytes_of).first()
    tiles, blocks = grid(size, n, held, mentions.sparkSession.sparkContext.defaultParallelism, tile_bytes)
    cells = tiles * blocks
    tasks = min(MAX_TASKS, cells)
    stored = {dict(t.dtypes)["embedding"] for t in (mentions, catalogue)}
    vector = F.col("embedding").cast("array<float>" if stored == {"array<float>"} else "array<double>")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    cell = (F.col("block") * tiles + F.col("tile")).alias("cell")
    asked = mentions.select(F.pmod(F.xxhash64("mention_id"), F.lit(blocks)).alias("block"), every(tiles).alias("tile"),
                            F.col("mention_id").cast("long").alias("id"), vector.alias("embedding")) \
        .select(cell, F.lit(0).alias("kind"), F.lit(0.0).alias("norm"), "id", "embedding")
    square = F.aggregate(F.col("embedding").cast("array<double>"), F.lit(0.0), lambda a, x: a + x * x)
    rows = catalogue.select(F.pmod(F.xxhash64("vec_id"), F.lit(tiles)).alias("tile"),
                            F.col("vec_id").cast("long").alias("id"), vector.alias("embedding"), square.alias("norm")) \
        .select("tile", every(blocks).alias("block"), "id", "embedding", "norm") \
        .select(cell, F.lit(1).alias("kind"), "norm", "id", "embedding")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by cell, its mentions before the vectors."""
        now, held, block = None, [], None
        for batch in batches:
            cell_of, kind_of = batch.column("cell").to_numpy(), batch.column("kind").to_numpy()
            cuts = np.flatnonzero((np.diff(cell_of) != 0) | (np.diff(kind_of) != 0)) + 1
            for low, high in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
                if low == high:
                    continue
                if cell_of[low] != now:
                    if block:
                        yield block.found()
                    now, held, block = cell_of[low], [], None
                run = batch.slice(low, high - low)
                if kind_of[low] == 0:
                    held.append((run.column("id").to_numpy(), _vectors(run)))
                    continue
                if block is None:
                    if not held:
                        continue  # no mention fell into this block
                    block = MentionBlock(*(np.concatenate(c) for c in zip(*held, strict=True)), k, exclude_self)
                block.meet(run.column("id").to_numpy(), _vectors(run))
        if block:
            yield block.found()

    local = rows.unionByName(asked).repartitionById(tasks, (F.col("cell") % tasks).cast("int")) \
        .sortWithinPartitions("cell", "kind", F.desc("norm")).mapInArrow(search, "mention_id long, entity_id long, score double")
    w = Window.partitionBy("mention_id").orderBy(F.desc("score"), F.col("entity_id"))
    return local.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k) \
        .select("mention_id", "rank", "entity_id", "score")


def fuse_candidates(cands: DataFrame) -> DataFrame:
    """round-robin over a question's mentions: all rank-1s in mention
    order, then all rank-2s...; NULL and empty candidates are dropped."""
    kept = cands.where(F.col("entity_id").isNotNull() & (F.col("entity_id").cast("string") != ""))
    w = Window.partitionBy("query_id").orderBy("rank", "mention_idx")
    return kept.select("query_id", "mention_idx", "rank", "entity_id",
                       F.row_number().over(w).cast("long").alias("fused_rank"))


def map_entities(fused: DataFrame, index_map: DataFrame) -> DataFrame:
    """``index_map(key, value)`` applied to ``str(entity_id)``; a missing key raises."""
    keyed = fused.withColumn("key", F.col("entity_id").cast("string"))
    missing = F.raise_error(F.concat(F.lit("not in the index map: "), F.col("key")))
    return keyed.join(index_map.select("key", "value"), "key", "left") \
        .select("query_id", "fused_rank", F.coalesce("value", missing.cast("string")).alias("entity"))


def dedupe_entities(mapped: DataFrame) -> DataFrame:
    """F8: keep each entity at its first position, then close up the ranks."""
    first = mapped.groupBy("query_id", "entity").agg(F.min("fused_rank").alias("first"))
    w = Window.partitionBy("query_id").orderBy("first")
    return first.select("query_id", F.row_number().over(w).cast("long").alias("rank"), "entity")

