"""Prefix trie of conversations from vertical bitmaps.

Conversations are dealt by ranges of their id.  A task cuts its sorted rows
into shards of at most ``SHARD_CONVERSATIONS`` and files them under
(position, turn): a posting is a bitset with one bit a conversation.  A
node is the bitset of its members; the postings of the next position that
meet it, intersected with it, are its children.  The depth-first walk gives
each node's members, popcount and end list.  Nodes of different shards meet
under their path's key, the 128-bit exclusive or of its (position, turn)
hashes.

Sums over subtrees need no walk of the merged trie.  The nodes whose
smallest member is conversation ``c`` form one chain down to ``c``'s end.
With ``T(c)`` the chain's sum, a node's subtree holds ``T`` of all its
members less the part of its own chain above it; nodes of one member have
one leaf and nothing saved.

Long conversations are cut into blocks of ``BLOCK`` positions that start at
the key of what precedes them, so a shard is bounded in positions too and
blocks are walked side by side.  Turns are put in order in spans of
``SPAN`` turn numbers, each in its own group.  Only ids, hashes and lengths
are shuffled, never texts.  The ids of an end list are hashed in a stream,
as SHA-256 asks, in pieces of one list a shard.

Defined cases: rows without conv_id take no part; NULL role or text is
empty; turns of one number come in the order of the MD5 of role and text;
repeated rows are turns as often as they occur; conversations left without
a turn end at the root; an empty table has no node; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

GROUP = 100  # a conversation's first turns come from the first of its hundred
LEADS = 6  # up to LEADS - 1 of them
SPAN = 1024
BLOCK = 64
SHARD_CONVERSATIONS = 2048

KEY = ("depth", "k1", "k2")
_NODE = pa.schema([("depth", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("p1", pa.int64()),
                   ("p2", pa.int64()), ("chars", pa.int64()), ("members", pa.list_(pa.int64())),
                   ("ends", pa.list_(pa.int64()))])
_NODE_DDL = "depth long, k1 long, k2 long, p1 long, p2 long, chars long, members array<long>, ends array<long>"


def turn_hash(role: Column, text: Column) -> Column:
    return F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """``(conv_id, position from 1, turn_key, chars)`` of every original turn."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    turn = F.col("turn").cast("long")
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), turn.alias("turn"),
        F.coalesce(F.floor(turn / SPAN), F.lit(-2**63)).alias("span"),
        turn_hash(role, text).alias("turn_key"), F.length(text).cast("long").alias("chars")) \
        .where(F.col("conv_id").isNotNull()) \
        .groupBy("conv_id", "span", "turn", "turn_key").agg(F.count("*").alias("copies"), F.max("chars").alias("chars"))
    rows = stored(rows, "trie-turns")
    earlier = Window.partitionBy("conv_id").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    spans = rows.groupBy("conv_id", "span").agg(F.sum("copies").alias("n")) \
        .withColumn("before", F.sum("n").over(earlier)).where(F.col("before") > 0).select("conv_id", "span", "before")
    upto = Window.partitionBy("conv_id", "span").orderBy(F.col("turn").asc_nulls_first(), "turn_key") \
        .rowsBetween(Window.unboundedPreceding, 0)
    counted = rows.withColumn("upto", F.sum("copies").over(upto)).join(spans, ["conv_id", "span"], "left")
    last = F.col("upto") + F.coalesce("before", F.lit(0))
    return counted.select("conv_id", F.explode(F.sequence(last - F.col("copies") + 1, last)).alias("position"),
                          "turn_key", "chars")


def rebuilt_turns(conversations: DataFrame) -> DataFrame:
    """``(conv_id, position, h1, h2, chars, ends)`` of the rebuilt conversations, with a row at position 0 for each.

    The first ``h`` turns are those of the first conversation of the
    hundred, ``h`` the CRC-32 of the id's decimal form modulo ``LEADS``.
    """
    turns = stored(ordered_turns(conversations), "trie-ordered")
    sizes = turns.groupBy("conv_id").agg(F.max("position").alias("n"))
    convs = sizes.select("conv_id", "n", (F.col("conv_id") - F.col("conv_id") % GROUP).alias("base"),
                         (F.crc32(F.col("conv_id").cast("string").cast("binary")) % LEADS).alias("h"))
    convs = convs.join(sizes.select(F.col("conv_id").alias("base"), F.col("n").alias("n_base")), "base", "left") \
        .withColumn("lead", F.least("h", F.coalesce("n_base", F.lit(0))))
    convs = stored(convs.select("conv_id", "base", "h", "lead",
                                (F.col("lead") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length")),
                   "trie-conversations")
    own = turns.join(convs, "conv_id").where(F.col("position") > F.col("h")) \
        .select("conv_id", (F.col("position") - F.col("h") + F.col("lead")).alias("position"), "turn_key", "chars", "length")
    leads = turns.where((F.col("conv_id") % GROUP == 0) & (F.col("position") < LEADS)) \
        .select(F.col("conv_id").alias("base"), "position", "turn_key", "chars") \
        .join(convs, "base").where(F.col("position") <= F.col("lead")) \
        .select("conv_id", "position", "turn_key", "chars", "length")
    roots = convs.select("conv_id", F.lit(0).cast("long").alias("position"), F.lit("").alias("turn_key"),
                         F.lit(0).cast("long").alias("chars"), "length")
    at = F.col("position")
    return own.unionByName(leads).unionByName(roots).select(
        "conv_id", at, F.floor(F.greatest(at - 1, F.lit(0)) / BLOCK).alias("block"),
        F.when(at > 0, F.xxhash64(at, "turn_key")).otherwise(0).alias("h1"),
        F.when(at > 0, F.xxhash64("turn_key", F.lit("second"), at)).otherwise(0).alias("h2"),
        "chars", (at == F.col("length")).alias("ends"))


def _with_block_starts(rows: DataFrame) -> DataFrame:
    """Adds ``s1, s2``: the path key at the position before the row's block."""
    earlier = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("conv_id", "block").agg(F.bit_xor("h1").alias("x1"), F.bit_xor("h2").alias("x2")) \
        .select("conv_id", "block", F.bit_xor("x1").over(earlier).alias("s1"), F.bit_xor("x2").over(earlier).alias("s2")) \
        .where(F.col("block") > 0)
    return rows.join(starts, ["conv_id", "block"], "left").fillna(0, ["s1", "s2"])


def _bits(bitset: int) -> Iterator[int]:
    while bitset:
        low = bitset & -bitset
        yield low.bit_length() - 1
        bitset ^= low


def walk_shard(conv: list[int], block: list[int], position: list[int], h1: list[int], h2: list[int],
               chars: list[int], ends: list[bool], s1: list[int], s2: list[int]) -> list[tuple]:
    """The nodes ``(depth, k1, k2, p1, p2, chars, members, ends)`` of one shard's trie.

    Rows are sorted by (conv, block, position); a run of equal (conv, block)
    is one bit of the shard's bitsets.
    """
    first_row: list[int] = []  # of each bit
    posting: dict[tuple[int, int, int], int] = {}
    start: dict[tuple[int, int, int], int] = {}
    for r, c in enumerate(conv):
        if not r or c != conv[r - 1] or block[r] != block[r - 1]:
            bit = 1 << len(first_row)
            first_row.append(r)
            group = (block[r] * BLOCK, s1[r], s2[r])
            start[group] = start.get(group, 0) | bit
        turn = (position[r], h1[r], h2[r])
        posting[turn] = posting.get(turn, 0) | bit
    ids = [conv[r] for r in first_row]
    stop = [*first_row[1:], len(conv)]
    nodes: list[tuple] = []
    stack: list[tuple[int, int, int, int]] = []
    for (depth, k1, k2), members in start.items():
        if depth == 0:
            at = list(_bits(members))
            nodes.append((0, 0, 0, None, None, 0, [ids[i] for i in at], [ids[i] for i in at if ends[first_row[i]]]))
        stack.append((members, depth, k1, k2))
    while stack:
        members, depth, k1, k2 = stack.pop()
        remaining = members
        while remaining:
            i = (remaining & -remaining).bit_length() - 1
            row = first_row[i] + depth % BLOCK + (depth < BLOCK)  # block 0 starts with the root's row
            if row >= stop[i]:
                remaining &= remaining - 1
                continue
            met = members & posting[position[row], h1[row], h2[row]]
            remaining &= ~met
            node = (met, depth + 1, k1 ^ h1[row], k2 ^ h2[row])
            found = [i] if met & (met - 1) == 0 else list(_bits(met))
            here = row - first_row[i]
            nodes.append((depth + 1, node[2], node[3], k1, k2, chars[row], [ids[j] for j in found],
                          [ids[j] for j in found if ends[first_row[j] + here]]))
            if (depth + 1) % BLOCK:
                stack.append(node)
    return nodes


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Sorted rows in tables of whole (conv_id, block) runs, at most ``SHARD_CONVERSATIONS`` of them."""
    held: list[pa.RecordBatch] = []
    runs, last = 0, None
    for batch in batches:
        if not batch.num_rows:
            continue
        conv, block = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        new = np.flatnonzero((np.diff(conv) != 0) | (np.diff(block) != 0)) + 1
        opens = [0, *new] if last is not None and (conv[0], block[0]) != last else list(new)
        cut = 0
        for at in opens:
            runs += 1
            if runs == SHARD_CONVERSATIONS:
                held.append(batch.slice(cut, at - cut))
                yield pa.Table.from_batches(held)
                held, runs, cut = [], 0, at
        held.append(batch.slice(cut))
        last = (conv[-1], block[-1])
    if held:
        yield pa.Table.from_batches(held)


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for shard in _shards(batches):
        nodes = walk_shard(*(shard.column(i).to_pylist() for i in range(shard.num_columns)))
        columns = list(zip(*nodes, strict=True)) or [()] * len(_NODE)
        yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, _NODE, strict=True)],
                                         schema=_NODE)


def shard_nodes(rows: DataFrame) -> DataFrame:
    """Every shard's nodes: path key, parent's key, last turn's length, members and ends in ascending order."""
    dealt = _with_block_starts(rows).select("conv_id", "block", "position", "h1", "h2", "chars", "ends", "s1", "s2")
    return dealt.repartitionByRange("conv_id", "block").sortWithinPartitions("conv_id", "block", "position") \
        .mapInArrow(_walk, _NODE_DDL)


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each node's ids; pieces of a node follow each other in ascending order."""
    schema = pa.schema([(k, pa.int64()) for k in KEY] + [("ends_sha256", pa.string())])
    key, state = None, None
    for batch in batches:
        done = []
        keys = zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True)
        for k, ids in zip(keys, batch.column(3), strict=True):
            if k != key:
                if state:
                    done.append((*key, state.hexdigest()))
                key, state = k, hashlib.sha256()
            else:
                state.update(b",")
            state.update(",".join(map(str, ids.values.to_pylist())).encode())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done, strict=True)], schema=schema)
    if state:
        yield pa.RecordBatch.from_arrays([pa.array([c]) for c in (*key, state.hexdigest())], schema=schema)


def _ends(local: DataFrame) -> DataFrame:
    listed = local.where(F.size("ends") > 0).select(*KEY, "ends", F.col("ends")[0].alias("first"))
    return listed.repartition(*KEY).sortWithinPartitions(*KEY, "first").select(*KEY, "ends") \
        .mapInArrow(_digest, "depth long, k1 long, k2 long, ends_sha256 string")


def _meet(first: DataFrame, *others: DataFrame) -> DataFrame:
    """Rows of equal node key as one: the only value of each column."""
    every = first
    for other in others:
        every = every.unionByName(other, allowMissingColumns=True)
    return every.groupBy(*KEY).agg(*[F.max(c).alias(c) for c in every.columns if c not in KEY])


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """One row per node: ``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256``."""
    rows = stored(rebuilt_turns(conversations), "trie-rebuilt")
    local = stored(shard_nodes(rows), "trie-shards")
    merged = stored(local.groupBy(*KEY).agg(
        F.sum(F.size("members")).alias("n_convs"), F.min(F.col("members")[0]).alias("conv_id"),
        F.max("p1").alias("p1"), F.max("p2").alias("p2"), F.max("chars").alias("chars")), "trie-merged")
    children = merged.where(F.col("depth") > 0) \
        .groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("k1"), F.col("p2").alias("k2")) \
        .agg(F.count("*").alias("n_children"))
    saved = (F.col("n_convs") - 1) * F.col("chars")
    nodes = stored(_meet(merged, children).fillna(0, ["n_children"]).withColumn("saved", saved), "trie-nodes")

    shared = nodes.where(F.col("n_convs") > 1)
    chains = nodes.groupBy("conv_id").agg(
        F.sum("saved").alias("t_saved"), F.sum((F.col("n_children") == 0).cast("long")).alias("t_leaves"))
    members = local.join(shared.select(*KEY), list(KEY), "left_semi") \
        .select(*KEY, F.explode("members").alias("conv_id"))
    totals = members.join(chains, "conv_id").groupBy(*KEY) \
        .agg(F.sum("t_saved").alias("t_saved"), F.sum("t_leaves").alias("t_leaves"))
    above = Window.partitionBy("conv_id").orderBy("depth").rowsBetween(Window.unboundedPreceding, -1)
    before = shared.select(*KEY, F.sum("saved").over(above).alias("above"))

    whole = _meet(nodes, totals, before, _ends(local))
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("p1"), F.col("k2").alias("p2"),
                           F.col("conv_id").alias("parent_conv_id"))
    whole = stored(whole, "trie-whole").join(parents, ["depth", "p1", "p2"], "left")
    none = hashlib.sha256(b"").hexdigest()
    return whole.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children",
        F.coalesce("t_leaves", F.lit(1)).alias("n_leaves"),
        (F.coalesce("t_saved", F.lit(0)) - F.coalesce("above", F.lit(0))).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"))
