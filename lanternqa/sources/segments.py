"""A10: a term index in segments, added to and deleted from, one version at a time.

``segments/seg=<id>/part=<p>`` holds a segment's posting blocks: a row for
each term and range of documents, with the documents, counts and lengths as
arrays, the largest count and the smallest length.  Terms are dealt into
parts by their hash, so a question's parts are found without a look at the
others; a hot term's blocks are dealt on into as many tasks as there are
slabs of ranges.  A range is the next documents of a partition of the input,
so its blocks are made where its documents are read: no posting is moved,
only blocks, as compressed pieces, and texts only where a few partitions hold
most of them.  Where a ``doc_id`` comes again ranges are by its hash, as what
is added up for a document must be in one range; texts are moved then.
A mark that no token can be stands for a term of every document: its blocks
(part -1) list all documents with their lengths, so one pass over the texts
leaves postings, lengths and empty documents alike.
``terms/seg=<id>`` has the document frequencies.

A deletion writes the documents (``deletes/id=<id>``) with their segments
and ranges, and the frequencies they take away (``gone/id=<id>``).  Up to
``GONE_MAX_BYTES`` of deleted documents are sent to the blocks, more meet
them by range.  ``manifest/v=<n>``
is written last, by a rename that fails where the version exists: readers
see the version they opened, whole, and of two writers one gets an error.
Frequencies, number of documents and their total length add up over
segments less deletions, so weights are those of an index built anew.
"""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.constants import BM25_B, BM25_K1
from ..operators.index import TermIndex, document_terms
from ..operators.joins import ROW_OVERHEAD, fits_broadcast
from ..operators.packed import deal
from ..session import shuffles_released

DOCUMENT = "\x01"  # the mark that counts as a term of every document
DOCUMENTS_PART = -1
RANGE_DOCS = 256
SLAB_RANGES = 1024
MAX_PARTS = 4096
DOCS_PER_PART = 256
DOCS_PER_TASK = 2048
LEAST_TASKS = 8
GONE_MAX_BYTES = 64 << 20  # of a deletion's ids, as the workers hold them
GONE_ROW = 8  # bytes of an id among them

#: How blocks are stored: a range's ids lie close, so they are stored as differences; the rest by dictionaries.
STORED_BLOCKS = {"compression": "zstd", "parquet.writer.version": "v2", "parquet.enable.dictionary#docs.list.element": "false",
                 "parquet.dictionary.page.size": str(8 << 20), "parquet.page.size": str(8 << 20),
                 "parquet.page.row.count.limit": str(1 << 20)}


def part_of(term: Column, parts: int) -> Column:
    return F.when(term == DOCUMENT, F.lit(DOCUMENTS_PART)).otherwise(F.pmod(F.xxhash64(term), F.lit(parts)).cast("int"))


_BLOCK = ("term", "range", "docs", "tfs", "dls")


def _range_blocks(docs: pa.Table, number: int) -> pa.RecordBatch:
    """The blocks of one range's documents ``(doc_id, terms)``: counted by one sort of numbers."""
    docs = docs.combine_chunks()
    lists = docs.column("terms").chunk(0)
    dl = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    coded = pc.list_flatten(lists).dictionary_encode()
    n, mark = docs.num_rows, len(coded.dictionary)
    row = np.arange(n)
    key = np.concatenate((coded.indices.to_numpy(zero_copy_only=False).astype(np.int64) * n + np.repeat(row, dl), mark * n + row))
    key.sort()
    new = np.flatnonzero(np.diff(key, prepend=-1))
    tf = np.diff(new, append=len(key))
    word, row = np.divmod(key[new], n)
    first = np.flatnonzero(np.diff(word, prepend=-1))
    offsets = pa.array(np.append(first, len(word)).astype(np.int32))
    lists = [pa.ListArray.from_arrays(offsets, values) for values in
             (docs.column("doc_id").chunk(0).take(pa.array(row)), pa.array(tf), pa.array(dl[row]))]
    term = pa.concat_arrays([coded.dictionary, pa.array([DOCUMENT], pa.string())]).take(pa.array(word[first]))
    ranges = pa.array(np.full(len(first), number, dtype=np.int64))
    return pa.RecordBatch.from_arrays([term, ranges, *lists], names=_BLOCK)


def _document_blocks(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """A partition's documents as blocks, a range of ``most`` at a time; ranges are numbered within the partition."""
    number = TaskContext.get().partitionId() << 32
    held: list[pa.RecordBatch] = []
    for batch in batches:
        low = 0
        while low < batch.num_rows:
            held.append(batch.slice(low, most - sum(b.num_rows for b in held)))
            low += held[-1].num_rows
            if sum(b.num_rows for b in held) == most:
                yield _range_blocks(pa.Table.from_batches(held), number)
                held, number = [], number + 1
    if held:
        yield _range_blocks(pa.Table.from_batches(held), number)


def _ranged_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents by range as blocks, a range at a time; one may go on in the next batch."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        ranges = batch.column("range").to_numpy()
        cuts = np.flatnonzero(np.diff(ranges)) + 1
        for low, high in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
            if low < high and held and held[-1].column("range")[0].as_py() != ranges[low]:
                yield _range_blocks(pa.Table.from_batches(held), held[-1].column("range")[0].as_py())
                held = []
            if low < high:
                held.append(batch.slice(low, high - low))
    if held:
        yield _range_blocks(pa.Table.from_batches(held), held[-1].column("range")[0].as_py())


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Postings sorted by (range, term) as one row for each; a run may go on in the next batch."""
    held: pa.Table | None = None

    def closed(rows: pa.Table, last: bool) -> tuple[pa.RecordBatch | None, pa.Table]:
        term, rng = (rows.column(n).combine_chunks() for n in ("term", "range"))
        changed = np.zeros(rows.num_rows, dtype=bool)
        changed[0] = True
        for column in (term, rng):
            changed[1:] |= pc.not_equal(column[1:], column[:-1]).to_numpy(zero_copy_only=False)
        first = np.flatnonzero(changed)
        end = rows.num_rows if last else first[-1]
        first = first[first < end]
        if not len(first):
            return None, rows
        offsets = pa.array(np.append(first, end).astype(np.int32))
        lists = [pa.ListArray.from_arrays(offsets, rows.column(n).combine_chunks()[:end]) for n in ("doc_id", "tf", "dl")]
        return pa.RecordBatch.from_arrays([term.take(first), rng.take(first), *lists], names=_BLOCK), rows.slice(end)

    for batch in batches:
        if batch.num_rows:
            rows = pa.Table.from_batches([batch])
            held = rows if held is None else pa.concat_tables([held, rows])
            found, held = closed(held, last=False)
            if found is not None:
                yield found
    if held is not None and held.num_rows:
        found, _ = closed(held, last=True)
        if found is not None:
            yield found


def _without(blocks: pa.Table, held: pa.Array) -> pa.Table:
    """Blocks with those of their documents that are ``held``."""
    lists = {n: blocks.column(n).chunk(0) for n in ("docs", "tfs", "dls") if n in blocks.column_names}
    docs = lists["docs"]
    before = np.concatenate(([0], np.cumsum(held.to_numpy(zero_copy_only=False))))
    offsets = pa.array(before[docs.offsets.to_numpy() - docs.offsets[0].as_py()].astype(np.int32))
    for name, held_list in lists.items():
        left = pa.ListArray.from_arrays(offsets, held_list.flatten().filter(held)).cast(blocks.schema.field(name).type)
        blocks = blocks.set_column(blocks.column_names.index(name), blocks.schema.field(name), left)
    return blocks


def _without_gone(blocks: pa.Table, gone: pa.Table) -> pa.Table:
    """A range's blocks without its deleted documents."""
    if not blocks.num_rows or not gone.num_rows:
        return blocks
    blocks = blocks.combine_chunks()
    docs = blocks.column("docs").chunk(0)
    return _without(blocks, pc.invert(pc.is_in(docs.flatten(), value_set=gone.column("doc_id").combine_chunks().drop_null())))


def _among(ids: pa.Array) -> Callable[[pa.Array], np.ndarray]:
    """Whether documents are among ``ids``; whole numbers that lie close are looked up by their place."""
    if pa.types.is_integer(ids.type) and len(ids):
        low, high = (x.as_py() for x in pc.min_max(ids).values())
        if high - low < 16 * len(ids):
            there = np.zeros(high - low + 3, dtype=bool)  # what is out of bounds meets an empty end
            there[ids.to_numpy() - low + 1] = True
            return lambda docs: there[np.clip(docs.fill_null(low - 1).to_numpy(zero_copy_only=False), low - 1, high + 1) - (low - 1)]
    return lambda docs: pc.is_in(docs, value_set=ids).to_numpy(zero_copy_only=False)


def _from_manifest(name: str) -> property:
    return property(lambda self: self.manifest[name])


@dataclass(frozen=True)
class SegmentIndex:
    """One version of a stored index."""

    spark: SparkSession
    path: str
    version: int
    manifest: dict = field(repr=False)

    ngram, mode, unicode_form, k1, b, parts, doc_type, n, total = map(_from_manifest, (
        "ngram", "mode", "unicode_form", "k1", "b", "parts", "doc_type", "n_docs", "total_terms"))
    hash_size = None  # terms are strings

    def _read(self, kind: str, ids: list[str], key: str, ddl: str) -> DataFrame:
        if not ids:
            return self.spark.createDataFrame([], f"{ddl}, {key} string")
        return self.spark.read.schema(f"{ddl}, {key} string").option("basePath", f"{self.path}/{kind}") \
            .parquet(*[f"{self.path}/{kind}/{key}={i}" for i in ids])

    @cached_property
    def blocks(self) -> DataFrame:
        """``(seg, part, term, range, n, max_tf, min_dl, docs, tfs, dls)`` of all segments, deleted documents included."""
        ddl = (f"term string, range long, n long, max_tf long, min_dl long, docs array<{self.doc_type}>, "
               "tfs array<long>, dls array<long>, part int")
        return self._read("segments", self.manifest["segments"], "seg", ddl)

    @cached_property
    def deleted(self) -> DataFrame:
        """``(seg, range, doc_id, dl)``."""
        ddl = f"seg string, range long, doc_id {self.doc_type}, dl long"
        return self._read("deletes", self.manifest["deletes"], "id", ddl).drop("id")

    def _rest(self, blocks: DataFrame) -> DataFrame:
        """Blocks without deleted documents: the documents are sent to the blocks or, if there are too many, both are dealt by range."""
        gone = self.deleted.select("doc_id")
        return self._unmoved(blocks) if fits_broadcast(gone, GONE_MAX_BYTES // GONE_ROW * (ROW_OVERHEAD + 16)) else self._met(blocks)

    def _unmoved(self, blocks: DataFrame) -> DataFrame:
        """Blocks, where they lie, without deleted documents."""
        segs = [r.seg for r in self.deleted.select("seg").distinct().collect()]
        tables = {s: self.deleted.where(F.col("seg") == s).select("doc_id").where("doc_id IS NOT NULL").toArrow() for s in segs}
        sent = self.spark.sparkContext.broadcast({s: t.column(0).combine_chunks() for s, t in tables.items()})

        def left(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found: dict[str, Callable] = {}
            for batch in batches:
                seg = batch.column("seg").dictionary_encode()
                for code, name in enumerate(seg.dictionary.to_pylist()):
                    rows = pa.Table.from_batches([batch if len(seg.dictionary) == 1 else batch.filter(pc.equal(seg.indices, code))])
                    if name in sent.value:
                        if name not in found:
                            found[name] = _among(sent.value[name])
                        rows = rows.combine_chunks()
                        rows = _without(rows, pa.array(~found[name](rows.column("docs").chunk(0).flatten())))
                    yield from rows.to_batches()

        return blocks.mapInArrow(left, blocks.schema)

    def _met(self, blocks: DataFrame) -> DataFrame:
        """Blocks without deleted documents, both dealt by range: no row for a posting is moved."""
        tasks = self._tasks(self.n)
        both = [rows.repartition(tasks, "seg", "range").groupBy("seg", "range")
                for rows in (blocks, self.deleted.select("seg", "range", "doc_id"))]
        return both[0].cogroup(both[1]).applyInArrow(_without_gone, blocks.schema)

    def exploded(self, blocks: DataFrame, *keep: str) -> DataFrame:
        """Blocks as rows ``(*keep, doc_id, tf, dl)`` of documents that aren't deleted."""
        zipped = F.arrays_zip(F.col("docs").alias("doc_id"), F.col("tfs").alias("tf"), F.col("dls").alias("dl"))
        keep = ("seg", *[c for c in keep if c != "seg"])
        gone = self.deleted.select("seg", "doc_id")
        if not self.manifest["deletes"]:
            return blocks.select(*keep, F.inline(zipped))
        if fits_broadcast(gone):
            return blocks.select(*keep, F.inline(zipped)).join(F.broadcast(gone), ["seg", "doc_id"], "left_anti")
        needed = dict.fromkeys((*keep, "range", "docs", "tfs", "dls"))
        return self._rest(blocks.select(*needed)).select(*keep, F.inline(zipped))

    @property
    def postings(self) -> DataFrame:
        terms = self.blocks.where(F.col("part") != DOCUMENTS_PART)
        return self.exploded(terms, "term").select("doc_id", "term", "tf", "dl")

    @property
    def docs(self) -> DataFrame:
        """Every document with its length; only their part is read."""
        return self.exploded(self.blocks.where(F.col("part") == DOCUMENTS_PART)).select("doc_id", "dl")

    @property
    def terms(self) -> DataFrame:
        """``(term, df)`` over all segments, less what deletions took."""
        m = self.manifest
        if len(m["segments"]) == 1 and not m["deletes"]:
            return self._read("terms", m["segments"], "seg", "term string, df long").select("term", "df")
        plus = self._read("terms", m["segments"], "seg", "term string, df long").select("term", "df")
        minus = self._read("gone", m["deletes"], "id", "term string, df long").select("term", (-F.col("df")).alias("df"))
        return plus.unionByName(minus).groupBy("term").agg(F.sum("df").alias("df")).where(F.col("df") > 0)

    def as_term_index(self) -> TermIndex:
        """The same index for the operators over plain postings."""
        return TermIndex(self.postings, self.docs, self.ngram, self.mode, self.unicode_form, self.k1, self.b, None,
                         self.terms, self.n, self.total)

    # --- writing: each returns the next version ---

    def _commit(self, **changes) -> SegmentIndex:
        manifest = {**self.manifest, **changes}
        _write_manifest(self.spark, self.path, self.version + 1, manifest)
        return SegmentIndex(self.spark, self.path, self.version + 1, manifest)

    def append(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               counted: tuple[int, int] | None = None) -> SegmentIndex:
        """Adds documents (``counted`` if that was done) as one more segment.

        Their ids must not be among the live ones.
        """
        with shuffles_released(self.spark):
            return self._appended(docs.select(F.col(id_col).cast(self.doc_type).alias("doc_id"), F.col(text_col).alias("text")), counted)

    def _appended(self, rows: DataFrame, counted: tuple[int, int] | None) -> SegmentIndex:
        n_docs, most = _counted(rows) if counted is None else counted
        again = rows.groupBy("doc_id").count().where("count > 1").limit(1).count()
        blocks = self._by_id(rows, n_docs) if again else self._as_they_lie(rows, n_docs, most)
        return self._with_segment(blocks, n_docs, self.manifest["segments"], self.manifest["deletes"], self.n, self.total)

    def _as_they_lie(self, rows: DataFrame, n_docs: int, most: int) -> DataFrame:
        """Blocks of documents ``(doc_id, text)`` in ranges of each partition."""
        if most > max(DOCS_PER_TASK, 2 * n_docs / self.spark.sparkContext.defaultParallelism):
            rows = deal(rows, self._tasks(n_docs), "doc_id", "text")
        parsed = document_terms(rows, "doc_id", "text", self.ngram, self.mode, self.unicode_form)
        size = RANGE_DOCS
        return parsed.mapInArrow(lambda batches: _document_blocks(batches, size), self._block_ddl)

    def _by_id(self, rows: DataFrame, n_docs: int) -> DataFrame:
        """Blocks of documents in ranges by the hash of their id."""
        range_of = F.pmod(F.xxhash64("doc_id"), F.lit(max(1, math.ceil(n_docs / RANGE_DOCS))))
        rows = deal(rows.withColumn("range", range_of), self._tasks(n_docs), "range").sortWithinPartitions("range", "doc_id")
        parsed = document_terms(rows.drop("range"), "doc_id", "text", self.ngram, self.mode, self.unicode_form)
        return parsed.select(range_of.alias("range"), "doc_id", "terms").mapInArrow(_ranged_blocks, self._block_ddl)

    def compact(self) -> SegmentIndex:
        """All live documents in one segment; nothing is parsed again."""
        marks = self.docs.select("doc_id", F.lit(DOCUMENT).alias("term"), F.lit(1).cast("long").alias("tf"), "dl")
        range_of = F.pmod(F.xxhash64("doc_id"), F.lit(max(1, math.ceil(self.n / RANGE_DOCS))))
        rows = self.postings.unionByName(marks).select(range_of.alias("range"), "term", "doc_id", "tf", "dl") \
            .repartition(self._tasks(self.n), "range").sortWithinPartitions("range", "term", "doc_id")
        return self._with_segment(rows.mapInArrow(_blocks, self._block_ddl), self.n, [], [], 0, 0)

    @property
    def _block_ddl(self) -> str:
        return f"term string, range long, docs array<{self.doc_type}>, tfs array<long>, dls array<long>"

    def _tasks(self, n_docs: int) -> int:
        """The number of tasks for ``n_docs`` documents."""
        return max(LEAST_TASKS, self.spark.sparkContext.defaultParallelism, -(-n_docs // DOCS_PER_TASK))

    def _with_segment(self, blocks: DataFrame, n_docs: int, segments: list, deletes: list, n: int, total: int) -> SegmentIndex:
        with shuffles_released(self.spark):
            return self._stored(blocks, n_docs, segments, deletes, n, total)

    def _stored(self, blocks: DataFrame, n_docs: int, segments: list, deletes: list, n: int, total: int) -> SegmentIndex:
        seg = uuid.uuid4().hex[:12]
        slabs = max(1, math.ceil(n_docs / (RANGE_DOCS * SLAB_RANGES)))
        rows = blocks.select("*", part_of(F.col("term"), self.parts).alias("part"),
                             F.pmod(F.xxhash64("range"), F.lit(slabs)).alias("slab"))
        deal(rows, self._tasks(n_docs), "part", "slab").sortWithinPartitions("part", "range", "term") \
            .select("term", "range", F.size("docs").cast("long").alias("n"), F.array_max("tfs").alias("max_tf"),
                    F.array_min("dls").alias("min_dl"), "docs", "tfs", "dls", "part") \
            .write.options(**STORED_BLOCKS).partitionBy("part").parquet(f"{self.path}/segments/seg={seg}")
        written = SegmentIndex(self.spark, self.path, self.version, {**self.manifest, "segments": [seg], "deletes": []}).blocks
        written.where(F.col("part") != DOCUMENTS_PART).groupBy("term").agg(F.sum("n").alias("df")) \
            .write.options(compression="zstd").parquet(f"{self.path}/terms/seg={seg}")
        own = written.where(F.col("part") == DOCUMENTS_PART).agg(
            F.coalesce(F.sum("n"), F.lit(0)).alias("n"),
            F.coalesce(F.sum(F.aggregate("dls", F.lit(0).cast("long"), lambda a, x: a + x)), F.lit(0)).alias("total")).first()
        return self._commit(segments=[*segments, seg], deletes=deletes, n_docs=n + own["n"], total_terms=total + own["total"])

    def delete(self, ids: DataFrame, id_col: str = "doc_id") -> SegmentIndex:
        """Takes documents out; ids without a live document change nothing."""
        with shuffles_released(self.spark):
            return self._deleted(ids, id_col)

    def _deleted(self, ids: DataFrame, id_col: str) -> SegmentIndex:
        new = uuid.uuid4().hex[:12]
        wanted = ids.select(F.col(id_col).cast(self.doc_type).alias("doc_id")).distinct()
        here = self.exploded(self.blocks.where(F.col("part") == DOCUMENTS_PART), "range").select("seg", "range", "doc_id", "dl")
        here.join(wanted, "doc_id", "left_semi").select("seg", "range", "doc_id", "dl").write.parquet(f"{self.path}/deletes/id={new}")
        one = SegmentIndex(self.spark, self.path, self.version, {**self.manifest, "deletes": [new]})
        gone = one.deleted
        posted = self.blocks.where(F.col("part") != DOCUMENTS_PART)
        if fits_broadcast(gone.select("seg", "doc_id")):
            taken = self.exploded(posted, "term").join(F.broadcast(gone.select("seg", "doc_id")), ["seg", "doc_id"], "left_semi") \
                .groupBy("term").agg(F.count(F.lit(1)).alias("df"))
        else:  # what the deletion leaves of the blocks that are live now
            live = posted.select("seg", "range", "term", "docs")
            live = (self._rest(live) if self.manifest["deletes"] else live).withColumn("n", F.size("docs").cast("long"))
            taken = one._rest(live).select("term", (F.col("n") - F.size("docs")).alias("n")).where(F.col("n") > 0) \
                .groupBy("term").agg(F.sum("n").alias("df"))
        taken.write.options(compression="zstd").parquet(f"{self.path}/gone/id={new}")
        own = gone.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("total")).first()
        return self._commit(deletes=[*self.manifest["deletes"], new], n_docs=self.n - own["n"],
                            total_terms=self.total - own["total"])


def _file_system(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs
    where = hadoop.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop.Path


def _write_manifest(spark: SparkSession, path: str, version: int, manifest: dict) -> None:
    fs, at = _file_system(spark, path)
    target, draft = at(f"{path}/manifest/v={version:08d}"), at(f"{path}/manifest/.draft-{uuid.uuid4().hex}")
    out = fs.create(draft)
    out.write(bytearray(json.dumps(manifest).encode()))
    out.close()
    if fs.exists(target) or not fs.rename(draft, target):
        fs.delete(draft, False)
        raise RuntimeError(f"version {version} of the index was committed by another writer")


def _counted(docs: DataFrame) -> tuple[int, int]:
    """The number of documents, and of those in the partition that has most."""
    with shuffles_released(docs.sparkSession):
        counts = docs.groupBy(F.spark_partition_id().alias("at")).count().agg(F.sum("count"), F.max("count")).first()
    return counts[0] or 0, counts[1] or 0


def create_index(spark: SparkSession, path: str, parts: int, doc_type: str = "bigint", ngram: int = 1, mode: str = "any",
                 unicode_form: str | None = "NFD", k1: float = BM25_K1, b: float = BM25_B) -> SegmentIndex:
    """An index without documents, version 0."""
    manifest = {"ngram": ngram, "mode": mode, "unicode_form": unicode_form, "k1": k1, "b": b, "parts": parts,
                "doc_type": doc_type, "segments": [], "deletes": [], "n_docs": 0, "total_terms": 0}
    _write_manifest(spark, path, 0, manifest)
    return SegmentIndex(spark, path, 0, manifest)


def build_segments(docs: DataFrame, path: str, parts: int | None = None, id_col: str = "doc_id", text_col: str = "text",
                   **parameters) -> SegmentIndex:
    """An index of one segment.  The number of parts grows with the documents, to ``MAX_PARTS``."""
    counted = _counted(docs)
    parts = parts or min(MAX_PARTS, max(16, counted[0] // DOCS_PER_PART))
    doc_type = dict(docs.dtypes)[id_col]
    empty = create_index(docs.sparkSession, path, parts, doc_type, **parameters)
    return empty.append(docs, id_col, text_col, counted)


def open_index(spark: SparkSession, path: str, version: int | None = None) -> SegmentIndex:
    """The latest version, or an earlier one."""
    fs, at = _file_system(spark, path)
    versions = sorted(int(f.getPath().getName()[2:]) for f in fs.listStatus(at(f"{path}/manifest"))
                      if f.getPath().getName().startswith("v="))
    found = versions[-1] if version is None else version
    stream = fs.open(at(f"{path}/manifest/v={found:08d}"))
    try:
        manifest = json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()
    return SegmentIndex(spark, path, found, manifest)
