"""Approximate nearest neighbours by inner product over robust-pruned graphs.

Vectors are dealt by a hash of their id into shards.  Each shard builds a
directed graph in one task: vectors enter in growing batches, a greedy
search of the graph so far proposes each one's neighbours, and robust
pruning keeps an edge only if no kept neighbour is nearer to its end by
the factor ``ALPHA`` - so few, diverse edges remain; reverse edges are
pruned alike.  Queries beam-search every shard and the nearest found of
all shards are merged.

Largest inner product becomes smallest distance by one more coordinate
that lifts all vectors of a shard to the same length (queries have 0
there).  Equal vectors are one node of their shard that knows its
smallest ids, which is all a top-k list can name of them.  The scores
reported are inner products of the original vectors in double precision.

The number of shards grows with the root of the number of vectors: both
the shard a task holds (``MAX_SHARD`` vectors at most) and the shards a
query visits grow slowly.  A shard's graph is stored in chunks of rows;
search tasks read the chunks of a shard first and then stream its
queries, in blocks of ``QUERY_BLOCK``, so no task holds all queries.

Defined cases: vectors that are NULL, all zero, or hold a NULL or
non-finite component take no part, nor do those whose length isn't the
table's most frequent one; a query's own id is never its neighbour;
queries that share an id are one query (their smallest vector); fewer
candidates than ``k`` are all listed; ties go to the smaller id; an empty
table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

K = 20
DEGREE = 32
SLACK = 8  # edges a node may have beyond its degree before it is pruned again
BUILD_BEAM = 64
SEARCH_BEAM = 192
EXPAND = 4  # beam members expanded at a step
ALPHA = 1.2
FIRST = 256  # vectors that are linked by brute force before the graph grows
BATCH = 512
ROOT_UNIT = 1024  # shards = sqrt(vectors / ROOT_UNIT)
MAX_SHARD = 1 << 20
QUERY_BLOCK = 1 << 20
CHUNK = 4096  # nodes of a stored row


def _distances(q: np.ndarray, x: np.ndarray, ids: np.ndarray, norms: np.ndarray) -> np.ndarray:
    """Squared distances less the query's own square, infinite where ``ids`` is -1; all ``(B, m)``."""
    dots = np.matmul(x[np.maximum(ids, 0)], q[:, :, None])[:, :, 0]
    return np.where(ids < 0, np.inf, norms[np.maximum(ids, 0)] - 2 * dots)


def beam_search(q: np.ndarray, x: np.ndarray, norms: np.ndarray, edges: np.ndarray, entry: int,
                beam: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``beam`` nearest nodes found for each query, ``(ids, distances)`` by distance; -1 where fewer.

    All queries of the batch step together: each expands its ``EXPAND``
    nearest unexpanded beam members until it has none.
    """
    n_q = len(q)
    ids = np.full((n_q, beam), -1, dtype=np.int32)
    dist = np.full((n_q, beam), np.inf, dtype=np.float32)
    done = np.ones((n_q, beam), dtype=bool)
    ids[:, 0], done[:, 0] = entry, False
    dist[:, 0] = _distances(q, x, ids[:, :1], norms)[:, 0]
    active = np.arange(n_q)
    while len(active):
        b_ids, b_dist, b_done = ids[active], dist[active], done[active]
        # the first EXPAND unexpanded members of each beam (beams are in order of distance)
        order = np.argsort(b_done, axis=1, kind="stable")[:, :EXPAND]
        fresh = ~np.take_along_axis(b_done, order, 1)
        nodes = np.where(fresh, np.take_along_axis(b_ids, order, 1), -1)
        np.put_along_axis(b_done, order, True, 1)
        near = np.where(nodes[:, :, None] < 0, -1, edges[np.maximum(nodes, 0)]).reshape(len(active), -1)
        # once each, and none that the beam holds
        near.sort(axis=1)
        near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
        held = np.sort(b_ids, axis=1)
        offset = np.arange(len(active), dtype=np.int64)[:, None] * (len(x) + 2)
        flat = (held + 1 + offset).ravel()
        want = (near + 1 + offset).ravel()
        at = np.minimum(np.searchsorted(flat, want), len(flat) - 1)
        near[(flat[at] == want).reshape(near.shape)] = -1
        d = _distances(q[active], x, near, norms).astype(np.float32)
        all_d = np.concatenate((b_dist, d), axis=1)
        best = np.argsort(all_d, axis=1, kind="stable")[:, :beam]
        b_dist = np.take_along_axis(all_d, best, 1)
        b_ids = np.where(np.isinf(b_dist), -1, np.take_along_axis(np.concatenate((b_ids, near), axis=1), best, 1))
        b_done = np.take_along_axis(np.concatenate((b_done, np.zeros(near.shape, dtype=bool)), axis=1), best, 1) | (b_ids < 0)
        ids[active], dist[active], done[active] = b_ids, b_dist, b_done
        active = active[~b_done.all(axis=1)]
    return ids, dist


def robust_prune(own: np.ndarray, cand: np.ndarray, x: np.ndarray, norms: np.ndarray,
                 degree: int = DEGREE, alpha: float = ALPHA) -> np.ndarray:
    """Diverse neighbours ``(B, degree)`` of nodes ``own`` out of candidates ``(B, m)``; -1 pads.

    Candidates are taken nearest first; one taken drops all that lie nearer
    to it, by the factor ``alpha``, than to the node itself.
    """
    cand = np.where(cand == own[:, None], -1, cand)
    points = x[np.maximum(cand, 0)]
    d = np.where(cand < 0, np.inf,
                 norms[own][:, None] + norms[np.maximum(cand, 0)] - 2 * np.matmul(points, x[own][:, :, None])[:, :, 0])
    order = np.argsort(d, axis=1, kind="stable")
    cand, d = np.take_along_axis(cand, order, 1), np.take_along_axis(d, order, 1)
    points = x[np.maximum(cand, 0)]
    square = norms[np.maximum(cand, 0)]
    between = square[:, :, None] + square[:, None, :] - 2 * np.matmul(points, points.transpose(0, 2, 1))
    alive = np.isfinite(d)
    kept = np.full((len(own), degree), -1, dtype=np.int32)
    n_kept = np.zeros(len(own), dtype=np.int64)
    for i in range(cand.shape[1]):
        take = np.flatnonzero(alive[:, i] & (n_kept < degree))
        if not len(take):
            continue
        kept[take, n_kept[take]] = cand[take, i]
        n_kept[take] += 1
        alive[take] &= alpha * alpha * between[take, i] > d[take]
        alive[take, i] = False
    return kept


def _add_reverse(edges: np.ndarray, source: np.ndarray, target: np.ndarray, x: np.ndarray, norms: np.ndarray) -> None:
    """Adds edges ``source -> target``; nodes that run out of room are pruned over all they would have."""
    order = np.argsort(source, kind="stable")
    source, target = source[order], target[order]
    nodes, first, count = np.unique(source, return_index=True, return_counts=True)
    have = (edges[nodes] >= 0).sum(axis=1)
    roomy = have + count <= edges.shape[1]
    within = np.arange(len(source)) - np.repeat(first, count)
    easy = np.repeat(roomy, count)
    edges[source[easy], (np.repeat(have, count) + within)[easy]] = target[easy]
    full = np.flatnonzero(~roomy)
    full = full[np.argsort(count[full], kind="stable")]
    while len(full):
        # candidates are compared with each other: fewer nodes at a time where they have many
        width = edges.shape[1] + int(count[full[:BATCH]].max())
        part = full[:max(1, min(BATCH, (1 << 22) // width ** 2))]
        full = full[len(part):]
        wanted = np.full((len(part), int(count[part].max())), -1, dtype=np.int32)
        for row, f in enumerate(part):
            wanted[row, :count[f]] = target[first[f]:first[f] + count[f]]
        kept = robust_prune(nodes[part], np.concatenate((edges[nodes[part]], wanted), axis=1), x, norms)
        edges[nodes[part]] = -1
        edges[nodes[part], :DEGREE] = kept


def build_graph(x: np.ndarray, seed: int = 0) -> tuple[np.ndarray, int]:
    """``(edges (n, DEGREE + SLACK), entry)`` over the rows of ``x``; -1 pads."""
    n = len(x)
    norms = (x * x).sum(axis=1)
    edges = np.full((n, DEGREE + SLACK), -1, dtype=np.int32)
    mean = x.mean(axis=0)
    entry = int(np.argmin(norms - 2 * x @ mean))
    order = np.random.default_rng(seed).permutation(n)
    order = np.concatenate(([entry], order[order != entry])).astype(np.int32)
    start = order[:FIRST]
    kept = robust_prune(start, np.broadcast_to(start, (len(start), len(start))), x, norms)
    edges[start, :DEGREE] = kept
    _add_reverse(edges, kept[kept >= 0], np.repeat(start, (kept >= 0).sum(axis=1)), x, norms)
    done = len(start)
    while done < n:
        batch = order[done:done + min(BATCH, done)]
        near, _ = beam_search(x[batch], x, norms, edges, entry, BUILD_BEAM)
        kept = robust_prune(batch, near, x, norms)
        edges[batch, :DEGREE] = kept
        filled = kept >= 0
        _add_reverse(edges, kept[filled], np.repeat(batch, filled.sum(axis=1)), x, norms)
        done += len(batch)
    return edges, entry


def lifted(x: np.ndarray) -> np.ndarray:
    """float32 rows with one more coordinate that makes them equally long."""
    square = (x * x).sum(axis=1)
    return np.concatenate((x, np.sqrt(np.maximum(square.max(initial=0) - square, 0))[:, None]), axis=1).astype(np.float32)


def inner_products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Row by row in extended precision, rounded to double: equal vectors score equally everywhere."""
    return (q.astype(np.longdouble) * x.astype(np.longdouble)).sum(axis=-1).astype(np.float64)


def usable(embedding: str) -> Column:
    """Not NULL, every component finite, not all zero."""
    e = F.col(embedding).cast("array<double>")
    finite = F.forall(e, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False)))
    return F.col(embedding).isNotNull() & finite & F.exists(e, lambda c: c != 0)


def shard_graphs(vectors: DataFrame, k: int) -> DataFrame:
    """The graph of every shard of ``vectors(shard, vec_id, embedding)``, in rows of ``CHUNK`` nodes.

    ``members`` are (node, vec_id) pairs: the ``k + 1`` smallest ids of each node.
    """
    schema = pa.schema([("shard", pa.int32()), ("chunk", pa.int32()), ("entry", pa.int32()),
                        ("members", pa.binary()), ("vectors", pa.binary()), ("edges", pa.binary())])

    def build(table: pa.Table) -> pa.Table:
        shard = table["shard"][0].as_py()
        ids = table["vec_id"].to_numpy()
        flat = table["embedding"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
        x = np.ascontiguousarray(flat.reshape(len(ids), -1))
        order = np.argsort(ids, kind="stable")  # whatever order the rows came in
        ids, x = ids[order], x[order]
        _, first, node = np.unique(x.view(np.dtype((np.void, x.dtype.itemsize * x.shape[1]))).ravel(),
                                   return_index=True, return_inverse=True)
        nodes = x[first]
        edges, entry = build_graph(lifted(nodes.astype(np.float64)), seed=shard) if len(nodes) > SEARCH_BEAM \
            else (np.empty((len(nodes), 0), dtype=np.int32), 0)  # the beam holds them all
        node, ids = np.unique(np.stack((node.ravel(), ids), axis=1), axis=0).T  # by node, then id, repeated rows once
        nth = np.arange(len(node)) - np.searchsorted(node, node)
        node, ids = node[nth <= k], ids[nth <= k]
        rows = []
        for c, at in enumerate(range(0, len(nodes), CHUNK)):
            low, high = np.searchsorted(node, (at, at + CHUNK))
            members = np.stack((node[low:high], ids[low:high]), axis=1).astype("<i8")
            rows.append({"shard": shard, "chunk": c, "entry": entry, "members": members.tobytes(),
                         "vectors": nodes[at:at + CHUNK].astype("<f8").tobytes(),
                         "edges": edges[at:at + CHUNK].astype("<i4").tobytes()})
        return pa.Table.from_pylist(rows, schema=schema)

    return vectors.groupBy("shard").applyInArrow(
        build, "shard int, chunk int, entry int, members binary, vectors binary, edges binary")


class Shard:
    """A shard's graph, put together from its chunks."""

    def __init__(self, rows: list[dict], dim: int):
        rows.sort(key=lambda r: r["chunk"])
        self.vectors = np.frombuffer(b"".join(r["vectors"] for r in rows), dtype="<f8").reshape(-1, dim)
        members = np.frombuffer(b"".join(r["members"] for r in rows), dtype="<i8").reshape(-1, 2)
        self.ids = members[:, 1]
        self.start = np.searchsorted(members[:, 0], np.arange(len(self.vectors) + 1))
        self.entry = rows[0]["entry"]
        self.edges = np.frombuffer(b"".join(r["edges"] for r in rows), dtype="<i4").reshape(len(self.vectors), -1)
        self.x = lifted(self.vectors)
        self.norms = (self.x * self.x).sum(axis=1)

    def search(self, query_ids: np.ndarray, q: np.ndarray, k: int, beam: int) -> tuple[np.ndarray, ...]:
        """``(query_id, vec_id, score)`` of up to ``k`` nearest ids for each query."""
        lifted_q = np.concatenate((q, np.zeros((len(q), 1))), axis=1).astype(np.float32)
        if self.edges.shape[1]:
            near, _ = beam_search(lifted_q, self.x, self.norms, self.edges, self.entry, beam)
        else:
            m = min(beam, len(self.x))
            d = self.norms[None, :] - 2 * lifted_q @ self.x.T
            near = np.argpartition(d, m - 1, axis=1)[:, :m] if m < len(self.x) else np.tile(np.arange(m), (len(q), 1))
        out: tuple[list, list, list] = ([], [], [])
        scores = inner_products(q[:, None, :], self.vectors[np.maximum(near, 0)])
        for i in range(len(q)):
            nodes = near[i][near[i] >= 0]
            sizes = self.start[nodes + 1] - self.start[nodes]
            ids = np.concatenate([self.ids[self.start[v]:self.start[v + 1]] for v in nodes])
            s = np.repeat(scores[i][near[i] >= 0], sizes)
            other = ids != query_ids[i]
            ids, s = ids[other], s[other]
            best = np.lexsort((ids, -s))[:k]
            for column, value in zip(out, (np.full(len(best), query_ids[i]), ids[best], s[best]), strict=True):
                column.append(value)
        return tuple(np.concatenate(c) for c in out)


def nearest_neighbours(vectors: DataFrame, queries: DataFrame, k: int = K, beam: int = SEARCH_BEAM,
                       id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``k`` nearest found of each query.

    ``queries`` has the columns of ``vectors``; a candidate with the query's id is left out.
    """
    def part(df: DataFrame) -> DataFrame:
        return df.where(usable(vec_col) & F.col(id_col).isNotNull()).select(
            F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("embedding"))

    # one row per vector length; the most frequent length holds
    lengths = part(vectors).groupBy(F.size("embedding").alias("dim")).agg(F.count(F.lit(1)).alias("n")) \
        .orderBy(F.desc("n"), "dim").limit(1).collect()
    dim, n = (lengths[0]["dim"], lengths[0]["n"]) if lengths else (1, 0)
    fits = F.size("embedding") == dim
    shards = max(1, math.ceil(math.sqrt(n / ROOT_UNIT)), math.ceil(n / MAX_SHARD))
    asked = part(queries).where(fits).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    dealt = part(vectors).where(fits).withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int"))
    graphs = stored(shard_graphs(dealt, k), "ann-graphs")
    blocks = max(1, -(-asked.count() // QUERY_BLOCK))
    all_blocks = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    all_shards = F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))
    null = lambda kind: F.lit(None).cast(kind)
    graph_rows = graphs.select("*", all_blocks.alias("block")).select(
        (F.col("block") * shards + F.col("shard")).cast("int").alias("cell"), F.lit(0).alias("kind"), "chunk", "entry",
        "members", "vectors", "edges", null("long").alias("query_id"), null("array<double>").alias("q"))
    query_rows = asked.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks))) \
        .select("*", all_shards.alias("shard")).select(
            (F.col("block") * shards + F.col("shard")).cast("int").alias("cell"), F.lit(1).alias("kind"),
            null("int").alias("chunk"), null("int").alias("entry"), null("binary").alias("members"),
            null("binary").alias("vectors"), null("binary").alias("edges"), F.col("vec_id").alias("query_id"),
            F.col("embedding").alias("q"))
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by cell, the graph's chunks before the queries."""
        cell, rows, shard = None, [], None
        for batch in batches:
            cells = batch.column("cell").to_numpy()
            kinds = batch.column("kind").to_numpy()
            cuts = np.flatnonzero((np.diff(cells) != 0) | (np.diff(kinds) != 0)) + 1
            for low, high in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
                if low == high:
                    continue
                if cells[low] != cell:
                    cell, rows, shard = cells[low], [], None
                run = batch.slice(low, high - low)
                if kinds[low] == 0:
                    rows += run.select(["chunk", "entry", "members", "vectors", "edges"]).to_pylist()
                    continue
                if shard is None:
                    if not rows:
                        continue  # a shard without vectors
                    shard, rows = Shard(rows, dim), []
                ids = run.column("query_id").to_numpy()
                q = run.column("q").flatten().to_numpy(zero_copy_only=False).reshape(len(ids), dim)
                for i in range(0, len(ids), BATCH):
                    found = shard.search(ids[i:i + BATCH], q[i:i + BATCH], k, beam)
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in found], schema=schema)

    found = graph_rows.unionByName(query_rows).repartition(max(shards * blocks, 1), "cell") \
        .sortWithinPartitions("cell", "kind").mapInArrow(search, "query_id long, vec_id long, score double")
    # a repeated row is one candidate; a shard lists k at most, so groups stay small
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.distinct().withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k) \
        .select("query_id", "rank", "vec_id", "score")
