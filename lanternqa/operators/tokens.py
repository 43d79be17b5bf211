"""Token tables with character offsets.

Generators over computed arrays use the ``_outer`` forms plus a NULL
filter: for a plain ``explode`` Spark infers ``size(array) > 0`` and pushes
it below the projections, re-computing the whole array chain there.

A document's tokens stay in its row as ``array<struct<token, start, end>>``
(offsets in code points, end exclusive), so offsets, untokenising and
entity groups need no shuffle.  Offsets come from tiling the text with
token and gap segments and summing the segment lengths (one vectorised
cumulative sum per Arrow batch).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, StringType, StructField, StructType

from ..functions import arrow
from ..functions.constants import SEGMENT_PATTERN, SPACED_TOKEN_PATTERN
from ..functions.text import strip_edges
from .packed import deal

TOKEN_STRUCT = "array<struct<token:string,start:int,end:int>>"


def with_token_spans(df: DataFrame, text_col: str = "text", out: str = "toks") -> DataFrame:
    """Add ``out`` = tokens with ``[start, end)`` offsets for ``text_col``."""
    cols = df.columns
    seg = df.withColumn("_segs", F.regexp_extract_all(F.col(text_col), F.lit(SEGMENT_PATTERN), 0))
    seg = seg.withColumn("_starts", arrow.segment_starts(F.col("_segs")))
    zipped = seg.select(*cols, F.arrays_zip("_segs", "_starts").alias("_z"))
    kept = zipped.select(*cols, F.filter("_z", lambda z: ~z["_segs"].rlike(r"^[\p{Z}\p{C}]")).alias("_k"))
    return kept.select(*cols, F.transform("_k", lambda z: F.struct(
        z["_segs"].alias("token"),
        z["_starts"].alias("start"),
        (z["_starts"] + F.length(z["_segs"])).cast("int").alias("end"))).alias(out))


def token_offsets(df: DataFrame, key_cols: tuple[str, ...] = ("doc_id",),
                  text_col: str = "text") -> DataFrame:
    """``(keys..., pos, token, start, end)``, one row per token."""
    spans = with_token_spans(df.select(*key_cols, text_col), text_col)
    return spans.select(*key_cols, F.posexplode_outer("toks").alias("pos", "t")) \
        .where(F.col("t").isNotNull()) \
        .select(*key_cols, F.col("pos").cast("long").alias("pos"), "t.token",
                F.col("t.start").cast("long").alias("start"),
                F.col("t.end").cast("long").alias("end"))


def untokenize(text: Column, toks: Column, lo: Column, hi: Column) -> Column:
    """Text of tokens ``[lo, hi)`` (0-based) with the inner whitespace kept.

    Each token owns the text up to the next token's start; the last token
    of the document owns only itself.  The result is stripped.
    """
    n = F.size(toks)
    lo_c = F.least(F.greatest(lo, F.lit(0)), n)
    hi_c = F.least(F.greatest(hi, F.lit(0)), n)
    first = F.try_element_at(toks, lo_c + 1)["start"]
    stop = F.when(hi_c < n, F.try_element_at(toks, hi_c + 1)["start"]) \
        .otherwise(F.try_element_at(toks, n)["end"])
    piece = F.substring(text, first + 1, stop - first)
    return F.when(hi_c > lo_c, strip_edges(piece)).otherwise(F.lit(""))


def annotations(toks: Column, tagger) -> Column:
    """B15 re-aimed: per-token tags from a Column -> Column tagger (NULL if none)."""
    if tagger is None:
        return F.lit(None).cast("array<string>")
    return F.transform(toks, lambda t: tagger(t["token"]))


ANNOTATIONS = ("pos", "lemma", "ner")


def stored_annotations(df: DataFrame, text_col: str = "text", kinds: tuple[str, ...] = ANNOTATIONS) -> DataFrame:
    """B15 from stored columns: ``df`` plus ``pos_tags``, ``lemma_tags``, ``ner_tags``.

    ``df`` may hold an array column per kind (``pos``, ``lemma``, ``ner``),
    one value per token of the text.  A kind without a column gives NULL; an
    array that is not as long as the tokens raises.
    """
    n = F.size(F.filter(F.regexp_extract_all(text_col, F.lit(SEGMENT_PATTERN), 0),
                        lambda s: ~s.rlike(r"^[\p{Z}\p{C}]")))

    def tags(kind: str) -> Column:
        if kind not in df.columns:
            return F.lit(None).cast("array<string>")
        wrong = F.raise_error(F.concat(F.lit(f"{kind}: not one value per token: "), F.size(kind).cast("string")))
        return F.when(F.col(kind).isNull() | (F.size(kind) == n), F.col(kind)).otherwise(wrong.cast("array<string>"))

    return df.select("*", *[tags(k).alias(f"{k}_tags") for k in kinds])


def entity_groups(df: DataFrame, tagger=None, key_cols: tuple[str, ...] = ("doc_id",),
                  text_col: str = "text", non_ent: str = "O", tags_col: str | None = None) -> DataFrame:
    """Runs of equal tags other than ``non_ent`` -> ``(keys, group_idx, text, tag)``.

    Tags come from ``tagger`` or from the stored array ``tags_col`` (a
    document without tags has no groups).  Run boundaries are found in-row
    (a tag differs from its predecessor); each run spans up to the next
    boundary.  The text is untokenised.
    """
    held = [tags_col] if tags_col else []
    spans = with_token_spans(df.select(*key_cols, text_col, *held), text_col)
    tags = F.coalesce(F.col(tags_col), F.array().cast("array<string>")) if tags_col \
        else annotations(F.col("toks"), tagger)
    tagged = spans.select(*key_cols, text_col, "toks", tags.alias("_tags"))
    tagged = tagged.select("*", F.size("_tags").alias("_n"))
    bounds = tagged.select("*", F.filter(
        F.sequence(F.lit(1), F.greatest(F.col("_n"), F.lit(1))),
        lambda i: (i <= F.col("_n")) & (
            (i == 1) | (F.element_at("_tags", i) != F.element_at("_tags", F.greatest(i - 1, F.lit(1)))))
    ).alias("_b"))
    runs = bounds.select(*key_cols, text_col, "toks", F.filter(F.transform(
        "_b", lambda p, j: F.struct(
            (p - 1).alias("lo"),
            (F.coalesce(F.try_element_at("_b", j + 2), F.col("_n") + 1) - 1).alias("hi"),
            F.element_at("_tags", p).alias("tag"))),
        lambda r: r["tag"] != F.lit(non_ent)).alias("_runs"))
    exploded = runs.select(*key_cols, text_col, "toks", F.posexplode_outer("_runs").alias("group_idx", "r")) \
        .where(F.col("r").isNotNull())
    return exploded.select(
        *key_cols, F.col("group_idx").cast("long").alias("group_idx"),
        untokenize(F.col(text_col), F.col("toks"), F.col("r.lo"), F.col("r.hi")).alias("text"),
        F.col("r.tag").alias("tag"))


#: Tokens of a document that one window orders; longer documents are parted and their runs joined at the borders.
TOKEN_BLOCK = 4096


def token_table(df: DataFrame, taggers: dict, key: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The long form of annotated tokens: ``(key, pos, token, text_ws, <kind>...)``, a row for each token.

    ``taggers`` has a Column -> Column function of the token for each kind;
    ``text_ws`` reaches to the next token's start.  A token's row is cut from
    its own piece of the text: what is carried per token doesn't grow with
    the document.
    """
    pieces = df.select(key, F.regexp_extract_all(F.col(text_col), F.lit(SPACED_TOKEN_PATTERN), 0).alias("_p"))
    rows = pieces.select(key, F.size("_p").alias("_n"), "_p").select(key, "_n", F.posexplode_outer("_p").alias("pos", "_ws")) \
        .where(F.col("_ws").isNotNull())
    token = F.regexp_replace("_ws", r"[\p{Z}\p{C}]+$", "")
    cut = rows.select(key, F.col("pos").cast("long").alias("pos"), token.alias("token"),
                      F.when(F.col("pos") + 1 < F.col("_n"), F.col("_ws")).otherwise(token).alias("text_ws"))
    return cut.select(key, "pos", "token", "text_ws", *[tagger(F.col("token")).alias(kind) for kind, tagger in taggers.items()])


#: Rows of a token table that a task gathers, about.
TOKENS_PER_TASK = 1_000_000


def _tasks(tokens: DataFrame) -> int:
    return max(tokens.sparkSession.sparkContext.defaultParallelism, -(-tokens.count() // TOKENS_PER_TASK))


def _in_order(rows: pa.Table) -> tuple[pa.Table, np.ndarray]:
    """Rows ``(key, pos, ...)`` ordered by them, and by the other columns in turn where they tie; a number for each row's key."""
    rows = rows.combine_chunks()
    coded = rows.column(0).combine_chunks().dictionary_encode()
    key = coded.indices.fill_null(len(coded.dictionary)).to_numpy(zero_copy_only=False).astype(np.int64)
    pos = rows.column(1).combine_chunks().cast(pa.int64())
    known = pos.is_valid().cast(pa.int8()).to_numpy(zero_copy_only=False)  # a token without a place comes first
    pos = pos.fill_null(0).to_numpy(zero_copy_only=False)
    order = np.lexsort((pos, known, key))
    new = np.append(True, np.any([np.diff(x[order]) != 0 for x in (pos, known, key)], axis=0))
    if not new.all():
        tied = ~new
        tied[:-1] |= ~new[1:]
        at = np.flatnonzero(tied)
        names = [f"c{i}" for i in range(2, rows.num_columns)]
        ties = rows.select(range(2, rows.num_columns)).take(pa.array(order[at])).rename_columns(names) \
            .append_column("place", pa.array(np.cumsum(new)[at]))
        by = pc.sort_indices(ties, sort_keys=[(n, "ascending") for n in ("place", *names)], null_placement="at_start")
        order[at] = order[at][by.to_numpy()]
    return rows.take(pa.array(order)), key[order]


#: Rows of a batch that a task hands back.
DOCS_PER_BATCH = 256


def annotations_of_table(tokens: DataFrame, kinds: tuple[str, ...] = ANNOTATIONS, key: str = "doc_id") -> DataFrame:
    """B15 over the long form: ``(key, tokens, <kind>...)``, an array for each kind in the order of the tokens.

    ``tokens`` is read twice, so it should be stored.
    """
    def arrays(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        rows, coded = _in_order(rows)
        first = np.flatnonzero(np.diff(coded, prepend=-1))
        offsets = np.append(first, len(coded)).astype(np.int32)
        values = [rows.column(i).combine_chunks() for i in range(2, rows.num_columns)]
        keys = rows.column(0).combine_chunks().take(pa.array(first))
        for low in range(0, len(first), DOCS_PER_BATCH):
            here = pa.array(offsets[low:low + DOCS_PER_BATCH + 1])
            yield pa.RecordBatch.from_arrays([keys.slice(low, DOCS_PER_BATCH), *[pa.ListArray.from_arrays(here, v) for v in values]],
                                             names=[key, "tokens", *kinds])

    rows = tokens.select(key, "pos", "token", *kinds)
    types = {f.name: f.dataType for f in rows.schema}
    schema = StructType([StructField(key, types[key])] + [
        StructField(out, ArrayType(types[column])) for out, column in (("tokens", "token"), *zip(kinds, kinds, strict=True))])
    return deal(rows, _tasks(tokens), key, work=arrays, schema=schema)


def entity_groups_of_table(tokens: DataFrame, kind: str = "ner", non_ent: str = "O", key: str = "doc_id",
                           block: int = TOKEN_BLOCK) -> DataFrame:
    """B16 over the long form: ``(key, group_idx, text, tag)``, as ``entity_groups`` has it.

    A tag that differs from its predecessor's begins a run.  Tokens are
    dealt out by key and block of ``block`` tokens, without the text and tag of those that are in
    no run; the runs within a block are found there, a row a block.  What passes a
    border - the last tag, the runs so far - is added up over these rows, and
    the parts of a run are joined.  ``tokens`` is read twice, so it should be stored.
    """
    tag, at = F.col(kind), F.floor(F.col("pos") / block)
    entity = tag != non_ent
    rows = tokens.where(F.col(key).isNotNull() & F.col("pos").isNotNull()) \
        .select(key, "pos", F.when(entity, F.coalesce("text_ws", F.lit(""))).alias("text_ws"), F.when(entity, tag).alias("tag"),
                at.alias("block"))

    def runs(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        rows, coded = _in_order(rows)
        blocks = rows.column("block").to_numpy()
        new = np.append(True, (np.diff(coded) != 0) | (np.diff(blocks) != 0))
        tags, texts = (rows.column(n).combine_chunks() for n in ("tag", "text_ws"))
        entity = tags.is_valid().to_numpy(zero_copy_only=False)
        label = tags.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
        begins = entity & (new | np.append(True, np.diff(label) != 0))
        held = np.flatnonzero(entity)
        start = np.flatnonzero(begins[held])  # of each run, among the tokens that are in one
        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(np.append(start, len(held)).astype(np.int32)), texts.take(pa.array(held))), "")
        tagged = tags.take(pa.array(held[start]))
        first = np.flatnonzero(new)
        offsets = np.append(0, np.cumsum(begins))[np.append(first, len(new))].astype(np.int32)
        last = np.append(first[1:], len(new)) - 1
        opens, closes = pa.array(entity[first]), pa.array(entity[last])
        columns = [rows.column(0).combine_chunks().take(pa.array(first)), pa.array(blocks[first]), opens, closes]
        for low in range(0, len(first), DOCS_PER_BATCH):
            here = pa.array(offsets[low:low + DOCS_PER_BATCH + 1])
            lists = [pa.ListArray.from_arrays(here, v) for v in (tagged, joined)]
            yield pa.RecordBatch.from_arrays([*[c.slice(low, DOCS_PER_BATCH) for c in columns], *lists],
                                             names=[key, "block", "opens", "closes", "tags", "texts"])

    types = {f.name: f.dataType for f in rows.schema}
    schema = StructType([StructField(key, types[key]), StructField("block", types["block"]), StructField("opens", BooleanType()),
                         StructField("closes", BooleanType()), StructField("tags", ArrayType(types["tag"])),
                         StructField("texts", ArrayType(StringType()))])
    found = deal(rows, _tasks(tokens), key, "block", work=runs, schema=schema)
    blocks = Window.partitionBy(key).orderBy("block")
    earlier = blocks.rowsBetween(Window.unboundedPreceding, -1)
    last = F.when(F.col("closes"), F.element_at("tags", -1))
    goes_on = F.coalesce(F.col("opens") & (F.lag(last).over(blocks) == F.get("tags", F.lit(0))), F.lit(False)).cast("long")
    counted = found.withColumn("goes_on", goes_on) \
        .withColumn("so_far", F.coalesce(F.sum(F.size("tags") - F.col("goes_on")).over(earlier), F.lit(0)) - F.col("goes_on"))
    parts = counted.select(key, "block", "so_far", F.posexplode_outer(F.arrays_zip("tags", "texts")).alias("i", "run")) \
        .where(F.col("run").isNotNull())
    pieces = F.array_sort(F.collect_list(F.struct("block", "run.texts")))
    return parts.groupBy(key, (F.col("so_far") + F.col("i")).alias("group_idx")).agg(
        strip_edges(F.array_join(F.transform(pieces, lambda t: t["texts"]), "")).alias("text"), F.first("run.tags").alias("tag"))
