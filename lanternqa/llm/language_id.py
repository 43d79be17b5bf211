"""Language identification by interpolated Kneser-Ney character models.

A text is its words: runs of letters and marks, lower-cased.  A word is a
sentence of a character model: ``ORDER - 1`` blanks, its characters, a
blank.  Every language has a model of order ``ORDER``: counts of the whole
learning part at the highest order, numbers of distinct continuations below
it, one absolute discount an order (from its counts of ones and twos), the
lowest order interpolated with the uniform distribution.  A text's language
is the one of the lowest cross-entropy per character; ties go to the
smaller name.

Counts are gathered from every learning document and grow with the input:
tasks count the n-grams of their distinct words, Spark sums them and
derives lower orders, contexts and probabilities by grouping and joining
tables of distinct n-grams.  N-grams of all other documents are in the
tables with count 0, so that each n-gram that can be met has its back-off
worked out once.  The result, log-probabilities by the n-gram's 64-bit hash,
is read in parts of a hash range each, at most ``PART_BYTES`` large; a part
is broadcast as sorted arrays and one scan of the texts adds up what it
holds.  The number of scans, not the size of a broadcast, grows with the
model.

The score is the calibrated probability that the language is right.  Models
of half of the learning part score the other half; the share of right
answers as a rising function of the margin (difference of the two lowest
cross-entropies times the root of the length) is fitted by pooling adjacent
violators over ``BINS`` bins of margin.  ``accepted`` is false where the
score is below ``ACCEPT``.

Defined cases: a NULL text, or one without a letter, is ``und`` with score
0; without learning documents every text is; a NULL id is not held out;
repeated rows are documents of their own; a table with one language knows
only that; without documents to calibrate on every score is 0.5; an empty
table gives an empty result; extra columns are ignored.  The names of the
languages and their calibration counts are held by the driver.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import in_parts, stored

ORDER = 5
PART_BYTES = 64 << 20
SLICE_BYTES = 1 << 21
HELD_ENTRIES = 1 << 20  # counts that a task gathers before it lets them go
BINS = 256
STEPS = 16  # bins a doubling of 1 + margin
LEAST_DOCS = 30  # documents behind a calibrated share
ACCEPT = 0.9
UNKNOWN = "und"


@dataclass
class Words:
    """The distinct words of a slice of texts and where they occur."""

    row: np.ndarray  # row and word of each occurrence
    word: np.ndarray
    lengths: np.ndarray  # characters of each word
    points: np.ndarray  # code points of all words, blanks between
    first: np.ndarray  # place of each word's first character

    def grams(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(word, place of the last character, hash)`` of every n-gram of the distinct words."""
        n = self.lengths + 1
        word = np.repeat(np.arange(len(n)), n)
        place = self.first[word] + np.arange(len(word)) - np.repeat(np.cumsum(n) - n, n)
        code = np.zeros(len(word), dtype=np.uint64)
        for back in range(ORDER - 1, -1, -1):
            code = (code ^ self.points[place - back]) * np.uint64(0x9E3779B97F4A7C15)
            code ^= code >> np.uint64(29)
        return word, place, code


def words_of(texts: pa.Array) -> Words:
    """NULL texts have no words."""
    clean = pc.replace_substring_regex(pc.utf8_lower(texts.fill_null("")), r"[^\p{L}\p{M}]+", " ")
    split = pc.utf8_split_whitespace(clean)
    row, flat = pc.list_parent_indices(split), split.flatten()
    some = pc.greater(pc.binary_length(flat), 0)
    row, coded = row.filter(some), flat.filter(some).dictionary_encode()
    lengths = pc.utf8_length(coded.dictionary).to_numpy(zero_copy_only=False).astype(np.int64)
    blanks = " " * (ORDER - 1)
    joined = blanks + blanks.join(coded.dictionary.to_pylist()) + " "
    points = np.frombuffer(joined.encode("utf-32-le"), dtype="<u4").astype(np.uint64)
    first = ORDER - 1 + np.cumsum(lengths + ORDER - 1) - (lengths + ORDER - 1)
    return Words(row.to_numpy(zero_copy_only=False), coded.indices.to_numpy(zero_copy_only=False), lengths, points, first)


class Counts:
    """N-gram counts by (hash, class), gathered over a task's slices."""

    def __init__(self) -> None:
        self.code = np.empty(0, dtype=np.uint64)
        self.kind = np.empty(0, dtype=np.int64)
        self.gram = np.empty(0, dtype=f"<U{ORDER}")
        self.n = np.empty(0, dtype=np.int64)

    def add(self, words: Words, kinds: np.ndarray) -> None:
        """``kinds`` are the classes of the rows, -1 for those not learnt from, which count 0."""
        word, place, code = words.grams()
        code, at, gram_of = np.unique(code, return_index=True, return_inverse=True)
        points = words.points[place[at][:, None] + np.arange(1 - ORDER, 1)].astype("<u4")
        grams = np.ascontiguousarray(points).view(f"<U{ORDER}").ravel()
        found = [(self.code, self.kind, self.gram, self.n)]
        of_occurrence = kinds[words.row]
        for kind in np.unique(of_occurrence):
            per_word = np.bincount(words.word[of_occurrence == kind], minlength=len(words.lengths))
            n = np.bincount(gram_of, weights=per_word[word], minlength=len(code)).astype(np.int64)
            has = np.flatnonzero(n)
            found.append((code[has], np.full(len(has), kind), grams[has], n[has] if kind >= 0 else np.zeros(len(has), np.int64)))
        code, kind, gram, n = (np.concatenate(c) for c in zip(*found, strict=True))
        order = np.lexsort((kind, code))
        code, kind, gram, n = code[order], kind[order], gram[order], n[order]
        new = np.flatnonzero(np.r_[True, (np.diff(code) != 0) | (np.diff(kind) != 0)][:len(code)])
        self.code, self.kind, self.gram = code[new], kind[new], gram[new]
        self.n = np.add.reduceat(n, new) if len(new) else n

    def batch(self) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(self.gram.tolist(), type=pa.string()), pa.array(self.code.view(np.int64)),
             pa.array(self.kind.astype(np.int32)), pa.array(self.n)], names=["gram", "code", "kind", "n"])


def labelled(docs: DataFrame) -> DataFrame:
    """``(doc_id, text, lang, rest)``: lang is NULL where it isn't learnt from, rest is the id's CRC-32 modulo 3."""
    doc_id = F.col("doc_id").cast("long")
    rest = F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3, F.lit(0)).cast("int")
    return docs.select(doc_id.alias("doc_id"), F.col("text").cast("string").alias("text"),
                       F.when(rest != 1, F.col("lang").cast("string")).alias("lang"), rest.alias("rest"))


def gram_counts(docs: DataFrame, langs: list[str]) -> DataFrame:
    """``(gram, code, c)`` of every n-gram of all texts; ``c`` has each language's counts in all learning documents, then in half of them."""
    known = {lang: i for i, lang in enumerate(langs)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = Counts()
        for batch in in_parts(batches, 1, SLICE_BYTES):
            half = batch.column(3).to_numpy() == 0
            lang = np.array([known.get(v, -1) for v in batch.column(2).to_pylist()], dtype=np.int64)
            counts.add(words_of(batch.column(1)), np.where(lang < 0, -1, 2 * lang + half))
            if len(counts.code) > HELD_ENTRIES:
                yield counts.batch()
                counts = Counts()
        yield counts.batch()

    found = docs.select("doc_id", "text", "lang", "rest").mapInArrow(run, "gram string, code long, kind int, n long")
    of = lambda kind: F.sum(F.when(F.col("kind") == kind, F.col("n")).otherwise(0))
    sums = [of(2 * i) + of(2 * i + 1) for i in range(len(langs))] + [of(2 * i + 1) for i in range(len(langs))]
    return found.groupBy("gram").agg(F.max("code").alias("code"), F.array(*sums).alias("c"))


def _each(k: int, value) -> Column:
    """The array of ``value(i)`` for each class."""
    return F.array(*[value(i) for i in range(k)])


def _shorter(grams: DataFrame, k: int) -> DataFrame:
    """Grams of one order less, with the numbers of characters that precede them."""
    c = F.col("c")
    return grams.groupBy(F.expr("substring(gram, 2)").alias("gram")) \
        .agg(_each(k, lambda i: F.sum((c[i] > 0).cast("long"))).alias("c"))


def _discounts(grams: DataFrame, k: int) -> list[float]:
    c = F.col("c")
    row = grams.agg(*[F.sum((c[i] == n).cast("long")).alias(f"n{n}_{i}") for i in range(k) for n in (1, 2)]).first()
    found = [(row[f"n1_{i}"] or 0, row[f"n2_{i}"] or 0) for i in range(k)]
    return [min(0.95, max(0.05, one / (one + 2 * two))) if one else 0.5 for one, two in found]


def _interpolated(grams: DataFrame, contexts: DataFrame, lower: DataFrame | None, uniform: float,
                  discounts: list[float]) -> DataFrame:
    """``grams`` with ``p``: discounted relative counts plus the freed mass times the lower order's probability."""
    c, total, kinds = F.col("c"), F.col("total"), F.col("kinds")
    if lower is None:
        joined, below = grams.crossJoin(F.broadcast(contexts.drop("context"))), lambda i: F.lit(uniform)
    else:
        lower = lower.select(F.col("gram").alias("suffix"), F.col("p").alias("q"))
        joined = grams.withColumn("context", F.expr("substring(gram, 1, char_length(gram) - 1)")) \
            .withColumn("suffix", F.expr("substring(gram, 2)")).join(contexts, "context").join(lower, "suffix")
        below = lambda i: F.col("q")[i]
    p = _each(len(discounts), lambda i: F.when(
        total[i] > 0, (F.greatest(c[i] - discounts[i], F.lit(0.0)) + discounts[i] * kinds[i] * below(i)) / total[i])
        .otherwise(below(i)))
    return joined.select(*grams.columns, p.alias("p"))


def probabilities(counts: DataFrame, k: int) -> DataFrame:
    """``(code, logs)``: natural logarithms of every n-gram's probability in each of the ``k`` models."""
    orders = [counts]
    for _ in range(ORDER - 1):
        orders.append(stored(_shorter(orders[-1], k), "language-order"))
    c = F.col("c")
    seen = orders[-1].where(F.exists("c", lambda v: v > 0)).count()
    found = None
    for grams in reversed(orders):
        contexts = grams.groupBy(F.expr("substring(gram, 1, char_length(gram) - 1)").alias("context")).agg(
            _each(k, lambda i: F.sum(c[i])).alias("total"),
            _each(k, lambda i: F.sum((c[i] > 0).cast("long"))).alias("kinds"))
        found = _interpolated(grams, contexts, found, 1.0 / (seen + 1), _discounts(grams, k))
    return found.select("code", F.transform("p", F.ln).cast("array<float>").alias("logs"))


def part_of(code: np.ndarray, parts: int) -> np.ndarray:
    """Which of ``parts`` ranges of hashes."""
    return ((code >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)


def score_part(docs: DataFrame, part: Broadcast, k: int) -> DataFrame:
    """``(doc_id, rest, lang, letters, t1, t2, chars, sums)``: what the part's n-grams add to each text's log-probabilities.

    ``t1, t2`` are hashes of the text.
    """
    schema = pa.schema([("chars", pa.int64()), ("sums", pa.list_(pa.float64()))])
    taken = ("doc_id", "rest", "lang", "letters", "t1", "t2")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, logs = part.value
        for batch in in_parts(batches, 1, SLICE_BYTES):
            words = words_of(batch.column(1))
            word, _, code = words.grams()
            at = np.minimum(np.searchsorted(codes, code), max(len(codes) - 1, 0))
            known = codes[at] == code if len(codes) else np.zeros(len(code), dtype=bool)
            sums = np.empty((batch.num_rows, k))
            for i in range(k):
                of_gram = np.where(known, logs[at, i], 0.0) if len(codes) else np.zeros(len(code))
                per_word = np.bincount(word, weights=of_gram, minlength=len(words.lengths))
                sums[:, i] = np.bincount(words.row, weights=per_word[words.word], minlength=batch.num_rows)
            chars = np.bincount(words.row, weights=words.lengths[words.word] + 1, minlength=batch.num_rows)
            lists = pa.ListArray.from_arrays(np.arange(batch.num_rows + 1) * k, sums.ravel())
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in taken), pa.array(chars.astype(np.int64)), lists], names=[*taken, *schema.names])

    return docs.select("doc_id", "text", "rest", "lang", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letters"),
                       F.xxhash64("text").alias("t1"), F.xxhash64(F.lit(1), "text").alias("t2")) \
        .mapInArrow(run, "doc_id long, rest int, lang string, letters boolean, t1 long, t2 long, chars long, sums array<double>")


def text_scores(docs: DataFrame, model: DataFrame, k: int) -> DataFrame:
    """``(doc_id, rest, lang, letters, chars, sums)`` of every document, summed over the model's parts."""
    spark = docs.sparkSession
    rows = model.count()
    parts = max(1, math.ceil(rows * (8 + 4 * k) / PART_BYTES))
    number = F.shiftrightunsigned(F.shiftrightunsigned("code", 32) * parts, 32)
    scans = []
    for n in range(parts):
        table = model.where(number == n).toArrow()
        codes = table["code"].to_numpy().view(np.uint64)
        logs = table["logs"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, k) \
            if len(codes) else np.empty((0, k), dtype=np.float32)
        order = np.argsort(codes)
        part = spark.sparkContext.broadcast((codes[order], logs[order]))
        scans.append(stored(score_part(docs, part, k), "language-sums"))
        part.destroy()
    if parts == 1:
        return scans[0].drop("t1", "t2")
    every = scans[0]
    for scan in scans[1:]:
        every = every.unionByName(scan)
    # equal rows have equal sums: one row stands for all of them and is repeated in the end
    return every.groupBy("doc_id", "rest", "lang", "letters", "t1", "t2", "chars").agg(
        F.count("*").alias("n"), _each(k, lambda i: F.sum(F.col("sums")[i])).alias("sums")) \
        .withColumn("copies", F.expr(f"n div {parts}")).withColumn("copy", F.explode(F.expr("sequence(1L, copies)"))) \
        .withColumn("sums", F.transform("sums", lambda v: v / F.col("copies"))).drop("n", "copies", "copy", "t1", "t2")


def judged(first: int, n_langs: int) -> tuple[Column, Column]:
    """Place of the best language and the margin, by the models from place ``first`` of ``sums`` on."""
    sums = F.slice("sums", first + 1, n_langs)
    best = F.array_position(sums, F.array_max(sums)).cast("int") - 1
    others = F.array_sort(sums)
    margin = (F.element_at(others, -1) - F.element_at(others, -2)) / F.sqrt(F.greatest("chars", F.lit(1))) \
        if n_langs > 1 else F.lit(0.0)
    return best, margin


def rising_shares(counts: list[tuple[int, int, int]]) -> list[tuple[int, float]]:
    """``(bin, share)`` from ``(bin, documents, right)``: pooled to ``LEAST_DOCS`` and made rising; the last bin of each pool."""
    pools: list[list[int]] = []
    for at, n, right in sorted(counts):
        if pools and pools[-1][1] < LEAST_DOCS:
            pools[-1] = [at, pools[-1][1] + n, pools[-1][2] + right]
        else:
            pools.append([at, n, right])
    share = lambda p: (p[2] + 1) / (p[1] + 2)
    rising: list[list[int]] = []
    for pool in pools:
        rising.append(pool)
        while len(rising) > 1 and share(rising[-2]) >= share(rising[-1]):
            at, n, right = rising.pop()
            rising[-1] = [at, rising[-1][1] + n, rising[-1][2] + right]
    return [(p[0], share(p)) for p in rising]


def identify_languages(docs: DataFrame) -> DataFrame:
    """``(doc_id, held_out, lang_pred, score, accepted, entropy)``; ``entropy`` in bits per character."""
    docs = labelled(docs)
    langs = [r["lang"] for r in docs.where(F.col("lang").isNotNull()).select("lang").distinct().orderBy("lang").collect()]
    held_out = (F.col("rest") == 1).alias("held_out")
    if not langs:
        return docs.select("doc_id", held_out, F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"),
                           F.lit(False).alias("accepted"), F.lit(None).cast("double").alias("entropy"))
    k = 2 * len(langs)
    counts = stored(gram_counts(docs, langs), "language-counts")
    sums = text_scores(docs, stored(probabilities(counts, k), "language-model"), k)
    names = F.array(*[F.lit(v) for v in langs])
    bin_of = lambda margin: F.least(F.lit(BINS - 1), F.floor(STEPS * F.log2(1 + margin))).cast("int")
    half, half_margin = judged(len(langs), len(langs))
    tried = sums.where((F.col("rest") == 2) & F.col("lang").isNotNull() & F.col("letters")) \
        .groupBy(bin_of(half_margin).alias("bin")) \
        .agg(F.count("*").alias("n"), F.sum((names[half] == F.col("lang")).cast("long")).alias("right")).collect()
    shares = rising_shares([(r["bin"], r["n"], r["right"]) for r in tried])
    whole, margin = judged(0, len(langs))
    score = F.lit(shares[-1][1] if shares else 0.5)
    for at, share in reversed(shares[:-1]):
        score = F.when(F.col("bin") <= at, share).otherwise(score)
    found = sums.select("doc_id", held_out, "letters", names[whole].alias("best"), bin_of(margin).alias("bin"),
                        (-F.array_max(F.slice("sums", 1, len(langs))) / F.greatest("chars", F.lit(1)) / math.log(2)).alias("h"))
    known = F.col("letters")
    score = F.when(known, score).otherwise(0.0)
    return found.select("doc_id", "held_out", F.when(known, F.col("best")).otherwise(UNKNOWN).alias("lang_pred"),
                        score.alias("score"), (score >= ACCEPT).alias("accepted"),
                        F.when(known, F.col("h")).alias("entropy"))
