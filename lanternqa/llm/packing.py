"""Best-fit packing of tokenised documents into fixed-length sequences.

A document is its token ids and an end id.  Documents longer than a
sequence are cut into whole sequences and a rest; rests and short
documents are packed by bounded-space online best-fit: a fixed number of
bins is open, a bitset says which amounts of free space they have, a
piece goes where the least space is left over, and when too many bins are
open the fullest closes first.

Tokenising is one pass over the texts and leaves a narrow table of pieces;
that table is dealt evenly into groups of bounded size, each packed by one
task.  Within a group the longest pieces arrive first, equal ones in an
order fixed by the stored table: a lost task packs alike when run again.

Defined cases: a NULL or empty text is the end id alone; repeated rows and
equal ids are packed as rows of their own; a NULL id stays NULL; an empty
table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import os
import string
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_and_text, in_parts, stored

SEQUENCE = 2048
END_ID = 0
OPEN_BINS = 1 << 14
GROUP_PIECES = 1 << 15
CACHED_WORDS = 1 << 19  # of one task
SLICE_BYTES = 1 << 20  # of text tokenised at a time
CACHED_LETTERS = 64  # longer words aren't kept
MARKS = string.punctuation  # of ASCII
#: What keeps a text from being lower-cased beforehand.
UNLIKE = r"[^\x00-\x{ff}]|<\||[\x1c-\x1f\x{85}\x{a0}]"
VOCABULARY = "word_bpe_49k.json"


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers
    return str(public_tokenizers.path(name))


class WordTokenizer:
    """Token ids of texts, word by word.

    The vocabulary drops white space and never joins what it parts, so a
    text's ids are its words' ids one after the other.  Arrow parts the
    texts at ASCII white space and numbers the distinct words; each is
    tokenised once, the ids of up to ``CACHED_WORDS`` are kept for the next
    texts, and the texts' ids are gathered by word number.

    Latin-1 texts are lower-cased first, as the vocabulary does it letter by
    letter after composing them: in Latin-1 nothing composes and case has no
    context.  Texts beyond it, or with the strings of special tokens or
    other white space (``UNLIKE``), keep their case.  A word of Latin-1
    letters is one run that ends in one token marked so: such words are
    encoded many at a time and parted after those tokens.  ASCII marks after
    the letters are a run of their own.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.known: dict[str, bytes] = {"": b""}

    def _encode(self, words: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(words, add_special_tokens=False)
        return [np.array(e.ids, dtype="<u4").tobytes() for e in found]

    def _encode_letters(self, words: list[str]) -> list[bytes]:
        ids = np.array(self.tokenizer.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, dtype="<u4")
        cuts = (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
        if len(cuts) != len(words):  # letters that the vocabulary parts otherwise
            return self._encode(words)
        raw = ids.tobytes()
        return [raw[s:e] for s, e in zip([0, *cuts], cuts, strict=False)]

    def _learn(self, words: list[str]) -> None:
        known = self.known
        # in Latin-1 letters stay letters when they are composed and lower-cased
        plain = [w for w in words if w.isascii() or max(w) <= "\xff"]
        letters = list(filter(str.isalpha, plain))
        marked = [(w, head, w[len(head):]) for w in plain if (head := w.rstrip(MARKS)) != w and head.isalpha()]
        new = list({*letters, *[head for _, head, _ in marked if head not in known]})
        if new:
            known.update(zip(new, self._encode_letters(new), strict=True))
        tails = list({tail for *_, tail in marked if tail not in known})
        known.update(zip(tails, self._encode(tails), strict=True))
        known.update([(w, known[head] + known[tail]) for w, head, tail in marked])
        other = [w for w in words if w not in known]
        known.update(zip(other, self._encode(other), strict=True))

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """``(ids, offsets)``: text *i* has ``ids[offsets[i]:offsets[i + 1]]``; NULL counts as empty."""
        texts = texts.cast(pa.large_string()).fill_null("")
        texts = pc.if_else(pc.match_substring_regex(texts, UNLIKE), texts, pc.utf8_lower(texts))
        split = pc.ascii_split_whitespace(texts)
        coded = split.flatten().dictionary_encode()
        words, codes = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        known = self.known
        new = [w for w in words if w not in known]
        if len(known) + len(new) > CACHED_WORDS:
            known.clear()
            known[""] = b""
            new = [w for w in words if w]
        self._learn(new)
        parts = list(map(known.__getitem__, words))
        for w in new:
            if len(w) > CACHED_LETTERS:
                del known[w]
        pool = np.frombuffer(b"".join(parts), dtype="<u4")
        sizes = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts)) // 4
        total = int(sizes[codes].sum())
        place = np.int32 if max(total, len(pool)) < 1 << 31 else np.int64  # half the memory but for gigantic texts
        starts = (np.cumsum(sizes) - sizes).astype(place)
        n = sizes.astype(place)[codes]  # ids of every word of the texts
        ends = np.zeros(len(n) + 1, dtype=place)
        np.cumsum(n, out=ends[1:])
        at = np.repeat(starts[codes] - ends[:-1], n)
        at += np.arange(total, dtype=place)
        return pool[at], ends[split.offsets.to_numpy() - split.offsets[0].as_py()]


def pieces(docs: DataFrame, sequence: int = SEQUENCE, tokenizer_path: str | None = None,
           id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32[, ids binary])``, in one pass, no shuffle."""
    path = tokenizer_path or vocabulary_path()
    fields = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()),
              ("ids_crc32", pa.int64())] + [("ids", pa.binary())] * with_ids
    schema = pa.schema(fields)
    end = np.array([END_ID], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = WordTokenizer(path)
        for part in in_parts(batches, max_bytes=SLICE_BYTES):
            ids, offsets = tokens.ids(part.column(1))
            rows = []
            for doc_id, low, high in zip(part.column(0).to_pylist(), offsets[:-1], offsets[1:], strict=True):
                own = ids[low:high].tobytes() + end
                for n, at in enumerate(range(0, len(own), 4 * sequence)):
                    piece = own[at:at + 4 * sequence]
                    rows.append((doc_id, n, at // 4, len(piece) // 4, zlib.crc32(piece), piece)[:len(fields)])
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, type=f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)],
                schema=schema)

    return id_and_text(docs, id_col, text_col).mapInArrow(
        run, "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids)


def best_fit(lengths: list[int], sequence: int = SEQUENCE, open_bins: int = OPEN_BINS) -> tuple[list[int], list[int]]:
    """``(bin, offset)`` of every length, in the order given, bins numbered from 0."""
    free_bits = 0  # bit f: an open bin has f tokens free
    by_free: list[list[int]] = [[] for _ in range(sequence + 1)]
    n_bins = n_open = 0
    bins, offsets = [], []
    for length in lengths:
        fitting = free_bits >> length
        if fitting:
            free = length + (fitting & -fitting).bit_length() - 1
            stack = by_free[free]
            place = stack.pop()
            if not stack:
                free_bits ^= 1 << free
            n_open -= 1
        else:
            free, place = sequence, n_bins
            n_bins += 1
        bins.append(place)
        offsets.append(sequence - free)
        left = free - length
        if left:
            by_free[left].append(place)
            free_bits |= 1 << left
            n_open += 1
            if n_open > open_bins:  # the fullest closes
                fullest = (free_bits & -free_bits).bit_length() - 1
                by_free[fullest].pop()
                if not by_free[fullest]:
                    free_bits ^= 1 << fullest
                n_open -= 1
    return bins, offsets


def pack(cut: DataFrame, sequence: int = SEQUENCE, open_bins: int = OPEN_BINS,
         group_pieces: int = GROUP_PIECES) -> DataFrame:
    """``cut(..., length long)`` plus ``sequence_id`` and ``offset``; one row per piece.

    Whole sequences keep to themselves; the rest is dealt into groups of
    about ``group_pieces`` whose number grows with the table.
    """
    columns = cut.columns
    rows = stored(cut.withColumn("__row", F.monotonically_increasing_id()), "packing-pieces")
    whole = rows.where(F.col("length") >= sequence) \
        .select(*columns, (-F.col("__row") - 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest = rows.where(F.col("length") < sequence)
    groups = max(1, -(-rest.count() // group_pieces))
    dealt = rest.withColumn("__deal", F.xxhash64("__row")) \
        .withColumn("__group", F.pmod("__deal", F.lit(groups)).cast("int"))

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("length", "descending"), ("__deal", "ascending"), ("__row", "ascending")])
        bins, offsets = best_fit(table["length"].to_pylist(), sequence, open_bins)
        group = table["__group"][0].as_py() if table.num_rows else 0
        return table.select(columns).append_column(
            "sequence_id", pa.array([(group << 32) + b for b in bins], type=pa.int64())
        ).append_column("offset", pa.array(offsets, type=pa.int64()))

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in whole.schema)
    return whole.unionByName(dealt.groupBy("__group").applyInArrow(run, ddl))


def pack_documents(docs: DataFrame, sequence: int = SEQUENCE, tokenizer_path: str | None = None,
                   id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32[, ids], sequence_id, offset)`` per piece."""
    return pack(pieces(docs, sequence, tokenizer_path, id_col, text_col, with_ids), sequence)


def sequences(packed: DataFrame) -> DataFrame:
    """``(sequence_id, n_tokens, ids binary, doc_ids)`` of pieces packed with their ids.

    A sequence holds ``SEQUENCE`` tokens at most, so its group is small.
    """
    parts = F.array_sort(F.collect_list(F.struct("offset", "length", "doc_id", "ids")))
    grouped = packed.groupBy("sequence_id").agg(parts.alias("parts"), F.sum("length").alias("n_tokens"))
    ids = F.aggregate(F.transform("parts", lambda p: p["ids"]), F.lit(b""), lambda acc, x: F.concat(acc, x))
    return grouped.select("sequence_id", "n_tokens", ids.alias("ids"),
                          F.transform("parts", lambda p: p["doc_id"]).alias("doc_ids"))
