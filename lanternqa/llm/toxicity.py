"""Toxicity by nearest labelled examples under exact TF-IDF cosine.

Terms are words and word beginnings of 4 to 8 letters, with their count in
the text.  Every term of the labelled examples is kept.  A text's vector
holds, for each, its count times its idf over the whole corpus times
``1 + sqrt(chi2)``, the term's chi-squared statistic against the label
among the examples: no term is left out, telling ones weigh more.  The
examples' vectors go into a block-max inverted index: a posting list per
term; the hot lists, which hold most postings, are dense and cut into
blocks of examples with the largest weight of each.  A document's short
lists are added up first: its K-th best sum is a cosine that its neighbours
reach.  Of the hot lists only blocks whose bounds reach it are multiplied
(for some documents at a time, in single precision); what can be among the
K best by its error bound is multiplied in double precision, so the nearest
examples are exact.  They vote with their squared cosine; a logistic curve fitted on the examples'
leave-one-out votes calibrates the score, and the neighbours are its
evidence.

Bounds: ``EXAMPLES`` labelled rows of each class (smallest hash of the id);
terms and postings are bounded by their texts only.  Votes weigh a class by
the rows one example stands for.  Corpus frequencies and scoring cover
every document.

Defined cases: NULL and empty texts, and texts without a term of any
example, score what such examples' labels say (smoothed); a NULL id is not
held out; repeated label rows count once, toxic if any says so; document
rows that share a labelled id are one example, with their smallest text, and
are scored as rows of their own; without labelled examples every score is 0; ties in cosine go to the smaller
example id; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_and_text, in_parts, stored

EXAMPLES = {1: 2048, 0: 6144}
PREFIXES = range(4, 9)
NEIGHBOURS = 15
BLOCK = 64
HOT_SHARE = 16  # lists that hold one in so many examples are dense,
HOT = 1024  # at most so many of them
TOGETHER = 64  # texts whose dense lists are multiplied together
SPREAD = 16  # examples, far from each other, that share a maximum
SLICE = 1 << 20  # postings whose weights are worked out together
ALIKE = 32  # most frequent terms whose presence orders the examples
DOUBT = 0.5  # weight on the clean side of every vote; a neighbour at cosine 1 has 1
THRESHOLD = 0.7
KNOWN = 10_000  # texts whose score a task remembers
SEED = 11

# letters and bytes beyond ASCII make words
_LETTERS = bytes(c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: str) -> list[bytes]:
    return text.lower().encode("utf-8", "surrogatepass").translate(_LETTERS).split()


def bases_of(word: str) -> list[str]:
    """The word, and its beginnings marked with ``*``."""
    return [word, *[word[:n] + "*" for n in PREFIXES if len(word) > n]]


def all_terms(text: str) -> list[str]:
    """The distinct terms of a text."""
    return list({b for w in set(words_of(text)) for b in bases_of(w.decode("utf-8", "replace"))})


@dataclass
class Found:
    """Known terms of many texts: text ``i`` has ``terms[first[i]:first[i + 1]]``, by number, with their counts."""

    first: np.ndarray
    terms: np.ndarray
    counts: np.ndarray

    def of(self, i: int) -> slice:
        return slice(self.first[i], self.first[i + 1])


def term_tables(names: pa.Array) -> list[tuple[int, pa.Array, np.ndarray]]:
    """Words (0) and word beginnings of each length as ``(length, texts, numbers)``; a term's number is its place."""
    marked, size = pc.ends_with(names, "*").to_numpy(zero_copy_only=False), pc.utf8_length(names).to_numpy()
    out = []
    for n in (0, *PREFIXES):
        numbers = np.flatnonzero(marked & (size == n + 1) if n else ~marked)
        texts = names.take(pa.array(numbers))
        out.append((n, pc.utf8_slice_codeunits(texts, 0, n) if n else texts, numbers))
    return out


class Vocabulary:
    """Numbers of the terms: words are looked up in columns, all at once."""

    def __init__(self, at: dict[str, int]):
        numbers = np.fromiter(at.values(), dtype=np.int64, count=len(at))
        self.size = len(at)
        self.tables = [(n, texts, numbers[places]) for n, texts, places in term_tables(pa.array(at, pa.string()))]

    @classmethod
    def of(cls, size: int, tables: list[tuple[int, pa.Array, np.ndarray]]) -> Vocabulary:
        """The vocabulary of ``term_tables``."""
        made = cls.__new__(cls)
        made.size, made.tables = size, tables
        return made

    @cached_property
    def at(self) -> dict[str, int]:
        return {text + "*" * (n > 0): i for n, texts, numbers in self.tables
                for text, i in zip(texts.to_pylist(), numbers.tolist(), strict=True)}

    def _numbers(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of the words' known terms, one word after the other, and how many each word has."""
        size = pc.utf8_length(words).to_numpy()
        found = np.full((len(words), len(self.tables)), -1, dtype=np.int64)
        for column, (n, texts, numbers) in enumerate(self.tables):
            if not len(texts):
                continue
            longer = np.flatnonzero(size > n)
            bases = words.take(pa.array(longer)) if n else words
            places = pc.index_in(pc.utf8_slice_codeunits(bases, 0, n) if n else bases, value_set=texts)
            known = places.is_valid().to_numpy(zero_copy_only=False)
            found[(longer if n else np.arange(len(words)))[known], column] = numbers[places.drop_null().to_numpy()]
        held = found >= 0
        return found[held], held.sum(axis=1)

    def found(self, texts: pa.Array) -> Found:
        """NULL texts have no terms.  Each distinct word of the texts is looked up once."""
        plain = [b"" if t is None else t.lower().encode("utf-8", "replace").translate(_LETTERS) for t in texts.to_pylist()]
        split = pc.ascii_split_whitespace(pa.array(plain, pa.binary()).cast(pa.string()))
        row, coded = pc.list_parent_indices(split).to_numpy(zero_copy_only=False), split.flatten().dictionary_encode()
        word = coded.indices.to_numpy(zero_copy_only=False)
        numbers, held = self._numbers(coded.dictionary)
        spread = held[word]
        kind = np.uint32 if len(plain) * (self.size + 1) < 1 << 32 else np.int64
        key = np.repeat((row * (self.size + 1)).astype(kind), spread)
        key += numbers.astype(kind)[_ranges((np.cumsum(held) - held)[word], spread)]
        key.sort()
        new = np.flatnonzero(np.concatenate((np.ones(min(1, len(key)), dtype=bool), key[1:] != key[:-1])))
        first = np.searchsorted(key[new], (np.arange(len(plain) + 1) * (self.size + 1)).astype(kind))
        terms = key[new].astype(np.int64) - np.repeat(np.arange(len(plain)) * (self.size + 1), np.diff(first))
        return Found(first, terms, np.diff(new, append=len(key)))


def _ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers ``starts[i] ... starts[i] + lengths[i] - 1`` of every i, one after the other."""
    before = np.cumsum(lengths) - lengths
    return np.repeat(starts - before, lengths) + np.arange(lengths.sum())


def _least(values: np.ndarray) -> np.ndarray:
    """Non-negative whole numbers in the smallest type that holds them."""
    return values.astype(np.min_scalar_type(int(values.max(initial=0))))


class BlockMaxIndex:
    """Posting lists of unit vectors in blocks of ``BLOCK`` examples, each with its largest weight.

    ``vectors`` is a matrix, or ``(row, term, value, number of terms)`` of
    its non-zero values; a posting weighs its value times the ``scale`` of
    its example.  Term ``t`` has the blocks ``term_at[t]`` to ``term_at[t + 1]``
    (those that hold a posting), block ``e`` of a term the postings
    ``block_at[e]`` to ``block_at[e + 1]``.  Values and weights aren't negative.
    """

    def __init__(self, vectors: np.ndarray | tuple, ids: np.ndarray, labels: np.ndarray,
                 scale: np.ndarray | None = None):
        if isinstance(vectors, np.ndarray):
            row, term = np.nonzero(vectors)
            value, n_terms = vectors[row, term], vectors.shape[1]
        else:
            row, term, value, n_terms = vectors
        self.n = len(ids)
        scale = np.ones(self.n) if scale is None else scale
        # like examples lie side by side, so that a block's largest weights say much
        often = np.argsort(-np.bincount(term, minlength=n_terms), kind="stable")[:ALIKE]
        column = np.full(n_terms, -1, dtype=np.int8)
        column[often] = np.arange(len(often))
        alike = np.zeros((len(often), self.n), dtype=bool)
        shown = column[term] >= 0
        alike[column[term[shown]], row[shown]] = True
        order = np.lexsort((ids, *alike[::-1], labels))
        self.ids, self.labels, self.scale = ids[order], labels[order], scale[order]
        place = np.empty(self.n, dtype=np.min_scalar_type(self.n))
        place[order] = np.arange(self.n)
        at = place[row]
        by = np.lexsort((at, term))
        self.postings = np.empty(len(by), dtype=[("at", at.dtype), ("value", value.dtype)])
        self.postings["at"], self.postings["value"] = at[by], value[by]
        self.posting_at = np.searchsorted(term[by], np.arange(n_terms + 1)).astype(np.int32)
        self.dense: np.ndarray | None = None  # what searches need is cut for the first

    def cut(self) -> None:
        """Lay out the hot lists by blocks, with the largest weight of each."""
        self.blocks = -(-self.n // BLOCK)
        self.length = np.diff(self.posting_at).astype(np.int64)
        hot = np.argsort(-self.length, kind="stable")[:HOT]
        hot = hot[self.length[hot] * HOT_SHARE >= max(1, self.n)]
        self.column = np.full(len(self.length), -1, dtype=np.int32)
        self.column[hot] = np.arange(len(hot))
        # values that single precision holds, like counts, are kept in it
        exact = all(np.array_equal(v.astype(np.float32), v) for v in (self._list(t)["value"] for t in hot))
        self.dense = np.zeros((self.blocks * BLOCK, len(hot)), dtype=np.float32 if exact else np.float64)
        for i, term in enumerate(hot):
            self.dense[self._list(term)["at"], i] = self._list(term)["value"]
        self.spread = np.zeros(self.blocks * BLOCK)
        self.spread[:self.n] = self.scale
        self.largest = np.zeros((len(hot), self.blocks))
        for block in range(self.blocks):
            p = slice(block * BLOCK, (block + 1) * BLOCK)
            self.largest[:, block] = (self.dense[p] * self.spread[p, None]).max(axis=0)
        # a list is one value of a binary column, so that many are put together at once
        self.lists_in_one = pa.Array.from_buffers(pa.large_binary(), len(self.length), [
            None, pa.py_buffer(self.posting_at.astype(np.int64) * self.postings.itemsize), pa.py_buffer(self.postings.view(np.uint8))])

    def _list(self, term: int) -> np.ndarray:
        return self.postings[self.posting_at[term]:self.posting_at[term + 1]]

    def _together(self, terms: np.ndarray) -> np.ndarray:
        """The terms' postings, one list after the other."""
        n = int(self.length[terms].sum())
        if not n:
            return self.postings[:0]
        return np.frombuffer(self.lists_in_one.take(pa.array(terms)).buffers()[2], dtype=self.postings.dtype, count=n)

    def lists(self) -> dict:
        """What ``cut`` starts from."""
        return {k: vars(self)[k] for k in ("n", "ids", "labels", "scale", "postings", "posting_at")}

    def _reached(self, sums: np.ndarray, k: int) -> np.ndarray:
        """Of each row a sum that its ``k`` best reach: the k-th of the maxima of scattered examples."""
        maxima = sums.reshape(len(sums), SPREAD, -1).max(axis=1)
        if maxima.shape[1] < k:
            return np.zeros(len(sums))
        return np.maximum(0.0, np.partition(maxima, maxima.shape[1] - k, axis=1)[:, maxima.shape[1] - k])

    def _best(self, short: np.ndarray, hot: np.ndarray, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The ``k`` best of the examples ``at``, in double precision."""
        found = np.round(short[at] + (self.dense[at] * hot).sum(axis=1) * self.spread[at], 12)
        best = np.lexsort((self.ids[at], -found))[:k]
        best = best[found[best] > 0]
        return at[best], found[best]

    def nearest(self, queries: Found, k: int, leave: np.ndarray | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
        """``(example positions, cosines)`` of each query's ``k`` nearest with a common term.

        ``queries`` have weights for counts; ``leave`` is each one's example that is passed over.
        The short lists, essential to every query, are added up first; their k best sums so
        far are scores that the answer reaches.  Of the hot lists only blocks whose largest
        weights can lift an example to it are multiplied; whatever is then among the k best
        but for the error of the product is scored again in double precision.
        """
        if self.dense is None:
            self.cut()
        out = []
        error = (self.dense.shape[1] + 2) * np.finfo(self.dense.dtype).eps  # relative, of sums without negative terms
        for start in range(0, len(queries.first) - 1, TOGETHER):
            batch = range(start, min(start + TOGETHER, len(queries.first) - 1))
            sums, hot = np.zeros((len(batch), self.blocks * BLOCK)), np.zeros((len(batch), self.dense.shape[1]))
            for r, i in enumerate(batch):
                terms, weights = queries.terms[queries.of(i)], queries.counts[queries.of(i)]
                column = self.column[terms]
                hot[r, column[column >= 0]] = weights[column >= 0]
                terms, weights = terms[column < 0], weights[column < 0]
                if len(terms):
                    postings = self._together(terms)
                    weight = np.repeat(weights, self.length[terms])
                    weight *= postings["value"]
                    sums[r, :self.n] = np.bincount(postings["at"], weight, minlength=self.n) * self.scale
                if leave is not None and leave[i] >= 0:
                    sums[r, leave[i]] = -np.inf
            whole, least = sums, np.full(len(batch), 1e-13)
            if self.n > k:
                reach = self._reached(sums, k)
                if self.dense.shape[1]:
                    bounds = hot @ self.largest + sums.reshape(len(batch), self.blocks, BLOCK).max(axis=2)
                    needed = np.concatenate(([False], (bounds >= reach[:, None] - 1e-9).any(axis=0), [False]))
                    whole, single, most = sums.copy(), hot.astype(self.dense.dtype), np.zeros(len(batch))
                    for low, high in np.flatnonzero(needed[1:] != needed[:-1]).reshape(-1, 2) * BLOCK:
                        part = (single @ self.dense[low:high].T) * self.spread[low:high]
                        most = np.maximum(most, part.max(axis=1))
                        whole[:, low:high] += part
                    reach = self._reached(whole, k) - 2 * error * most
                least = np.maximum(least, reach - 1e-11)
                candidates = [np.flatnonzero(row[:self.n] >= low) for row, low in zip(whole, least, strict=True)]
            else:
                candidates = [np.flatnonzero(row[:self.n] >= 0) for row in sums]
            out += [self._best(*row, k) for row in zip(sums, hot, candidates, strict=True)]
        return out


_EVIDENCE = pa.list_(pa.struct([("doc_id", pa.int64()), ("cosine", pa.float64()), ("toxic", pa.int32())]))


@dataclass
class ToxicityModel:
    vocabulary: Vocabulary
    weight: np.ndarray  # of each term
    index: BlockMaxIndex  # of the examples' counts
    class_weight: tuple[float, float]
    curve: tuple[float, float]  # of the calibrated score over the vote
    without_terms: float
    neighbours: int = NEIGHBOURS
    sent: tuple[Broadcast, Broadcast] | None = None  # the terms' tables; the term weights and posting lists

    def maker(self) -> Callable[[], ToxicityModel]:
        return _maker(*self.sent, (self.class_weight, self.curve, self.without_terms, self.neighbours))

    def votes(self, found: Found, leave: np.ndarray | None = None) -> list[tuple[float | None, np.ndarray, np.ndarray]]:
        """Of each text: share of the toxic neighbours' weight, and the neighbours; None without any."""
        v = found.counts * self.weight[found.terms]
        row = np.repeat(np.arange(len(found.first) - 1), np.diff(found.first))
        norm = np.sqrt(np.bincount(row, v * v, minlength=len(found.first) - 1))
        # the index holds counts: the examples' term weights are in the query
        queries = Found(found.first, found.terms, v / norm[row] * self.weight[found.terms])
        out: list[tuple[float | None, np.ndarray, np.ndarray]] = []
        for at, cosine in self.index.nearest(queries, self.neighbours, leave):
            weight = cosine ** 2 * np.where(self.index.labels[at] == 1, self.class_weight[1], self.class_weight[0])
            # DOUBT stands for unseen clean neighbours: far ones alone can't carry a vote
            share = float((weight * self.index.labels[at]).sum() / (weight.sum() + DOUBT)) if len(at) else None
            out.append((share, at, cosine))
        return out

    def scores(self, found: Found) -> list[tuple[float, np.ndarray, np.ndarray]]:
        """Of each text: calibrated score and its evidence, positions and cosines of the neighbours, nearest first."""
        a, b = self.curve
        return [(self.without_terms if share is None else float(1 / (1 + np.exp(-(a * share + b)))), at, cosine)
                for share, at, cosine in self.votes(found)]

    def evidence(self, at: list[np.ndarray], cosine: list[np.ndarray]) -> pa.ListArray:
        """``[{doc_id, cosine, toxic}]`` of each document."""
        where = np.concatenate([np.empty(0, dtype=np.int64), *at])
        structs = pa.StructArray.from_arrays(
            [pa.array(self.index.ids[where], pa.int64()), pa.array(np.concatenate([np.empty(0), *cosine]), pa.float64()),
             pa.array(self.index.labels[where], pa.int32())], fields=list(_EVIDENCE.value_type))
        offsets = np.concatenate(([0], np.cumsum([len(x) for x in at]))).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), structs, type=_EVIDENCE)


def logistic_curve(votes: np.ndarray, labels: np.ndarray, weights: np.ndarray, ridge: float = 1e-2) -> tuple[float, float]:
    """Weighted, ridged logistic regression of the label on the vote (Newton's method)."""
    x = np.stack([votes, np.ones(len(votes))], axis=1)
    beta = np.zeros(2)
    weights = weights / weights.mean() if len(weights) else weights
    for _ in range(50):
        p = 1 / (1 + np.exp(-x @ beta))
        step = np.linalg.solve((x * (weights * p * (1 - p))[:, None]).T @ x + ridge * np.eye(2),
                               x.T @ (weights * (labels - p)) - ridge * beta)
        beta += step
        if np.abs(step).max() < 1e-9:
            break
    return float(beta[0]), float(beta[1])


def held_out(doc_id: str = "doc_id"):
    """crc32 of the id as text leaves remainder 1 of 3."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def chosen_examples(labels: DataFrame, bounds: dict[int, int] = EXAMPLES) -> tuple[DataFrame, dict[int, float]]:
    """``(doc_id, toxic)`` of at most ``bounds`` rows a class, and how many rows each stands for."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")) \
        .where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out()) \
        .groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    totals = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    of = lambda c: known.where(F.col("toxic") == c).orderBy(F.xxhash64(F.lit(SEED), "doc_id"), "doc_id").limit(bounds[c])
    return of(1).unionByName(of(0)), {c: totals.get(c, 0) / max(1, min(totals.get(c, 0), n)) for c, n in bounds.items()}


def term_counts(texts: DataFrame) -> pa.Table:
    """``(term, a, b)``: toxic and other rows of ``texts(doc_id, text, toxic)`` that hold each term, by term."""
    @F.arrow_udf("array<string>")
    def terms(text: pa.Array) -> pa.Array:
        return pa.array((all_terms(t.as_py() or "") for t in text), type=pa.list_(pa.string()))

    return texts.select("toxic", F.explode(terms("text")).alias("term")).groupBy("term") \
        .agg(F.sum("toxic").alias("a"), F.sum(1 - F.col("toxic")).alias("b")).toArrow().sort_by("term")


def chi_squared(a: np.ndarray, b: np.ndarray, n_toxic: int, n_other: int) -> np.ndarray:
    """Of a term in ``a`` of the toxic and ``b`` of the other examples; 0 without both classes."""
    c, d, n = n_toxic - a, n_other - b, float(n_toxic + n_other)
    return n * (a * d - b * c) ** 2 / np.maximum((a + b) * (c + d) * float(n_toxic) * float(n_other), 1e-9)


def corpus_frequencies(docs: DataFrame, tables: Broadcast, n_terms: int) -> tuple[np.ndarray, int]:
    """Documents of the corpus that hold each term, and their number."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary.of(n_terms, tables.value)
        held = np.zeros(n_terms + 1, dtype=np.int64)  # the last counts documents
        for batch in in_parts(batches):
            held[:-1] += np.bincount(vocabulary.found(batch.column(1)).terms, minlength=n_terms)
            held[-1] += batch.num_rows
        some = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(held[some])], names=["term", "n"])

    rows = docs.mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    found = np.zeros(n_terms + 1, dtype=np.int64)
    found[rows["term"].to_numpy()] = rows["n"].to_numpy()
    return found[:-1], int(found[-1])


def _maker(tables: Broadcast, lists: Broadcast, rest: tuple) -> Callable[[], ToxicityModel]:
    """Makes a model in a task; a worker cuts the posting lists once."""
    def make() -> ToxicityModel:
        held = lists.value
        index = BlockMaxIndex.__new__(BlockMaxIndex)
        index.__dict__.update(held["index"])
        if "dense" not in held["index"]:
            index.cut()
            held["index"] = dict(vars(index))
        return ToxicityModel(Vocabulary.of(len(held["weight"]), tables.value), held["weight"], index, *rest)

    return make


def fit(docs: DataFrame, labels: DataFrame, bounds: dict[int, int] = EXAMPLES) -> ToxicityModel | None:
    """The model of the labelled rows that aren't held out; None without any."""
    docs = id_and_text(docs)
    examples, stands_for = chosen_examples(labels, bounds)
    # rows that share an id are one example, so the bounds are of rows
    texts = stored(docs.join(F.broadcast(examples), "doc_id").groupBy("doc_id")
                   .agg(F.min("text").alias("text"), F.max("toxic").alias("toxic")), "toxicity-examples")
    sizes = {r["toxic"]: r["n"] for r in texts.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    n_toxic, n_other = sizes.get(1, 0), sizes.get(0, 0)
    if not n_toxic + n_other:
        return None
    single = texts.dropDuplicates(["text", "toxic"])  # copies of a text are one witness
    n = {r["toxic"]: r["n"] for r in single.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    counted = term_counts(single)
    a, b = (counted[c].to_numpy().astype(np.float64) for c in "ab")
    n_terms = counted.num_rows
    vocabulary = Vocabulary.of(n_terms, term_tables(counted["term"].combine_chunks().cast(pa.string())))
    del counted
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary.tables)
    frequency, n_docs = corpus_frequencies(docs, sent, n_terms)
    term_weight = np.log(1 + n_docs / np.maximum(frequency, 1)) * (1 + np.sqrt(chi_squared(a, b, n.get(1, 0), n.get(0, 0))))

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary.of(n_terms, sent.value)
        for batch in batches:
            held = vocabulary.found(batch.column(1))
            first = pa.array(held.first, pa.int32())
            lists = [pa.ListArray.from_arrays(first, pa.array(v.astype(np.int32))) for v in (held.terms, held.counts)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *lists],
                                             names=["doc_id", "toxic", "terms", "counts"])

    rows = texts.select("doc_id", "text", "toxic") \
        .mapInArrow(found, "doc_id long, toxic int, terms array<int>, counts array<int>").toArrow()  # the bounds of rows
    ids, toxic = rows["doc_id"].to_numpy(), rows["toxic"].to_numpy().astype(np.int64)
    length = pc.list_value_length(rows["terms"]).to_numpy().astype(np.int64)
    term = pc.list_flatten(rows["terms"]).to_numpy()
    value = _least(pc.list_flatten(rows["counts"]).to_numpy())
    del rows
    held = length > 0
    row = np.repeat((np.cumsum(held) - 1).astype(np.int32), length)
    norm = np.zeros(int(held.sum()))
    for low in range(0, len(row), SLICE):  # the driver holds postings, not their weights
        p = slice(low, low + SLICE)
        norm += np.bincount(row[p], (value[p] * term_weight[term[p]]) ** 2, minlength=len(norm))
    index = BlockMaxIndex((row, term, value, n_terms), ids[held], toxic[held], 1 / np.sqrt(norm))
    del row, term, value
    weight = (stands_for[0], stands_for[1])
    bare = [weight[c] * int((~held & (toxic == c)).sum()) for c in (0, 1)]
    without = (bare[1] + 0.5 * n_toxic / (n_toxic + n_other)) / (bare[0] + bare[1] + 1)
    lists = docs.sparkSession.sparkContext.broadcast({"index": index.lists(), "weight": term_weight})
    model = ToxicityModel(vocabulary, term_weight, index, weight, (0.0, 0.0), without, sent=(sent, lists))
    make = model.maker()

    def left_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = make()
        places: dict[int, list[int]] = {}
        for i, d in enumerate(model.index.ids.tolist()):
            places.setdefault(d, []).append(i)
        for batch in batches:
            leave = np.array([places.get(doc_id, [-1])[0] for doc_id in batch.column(0).to_pylist()], dtype=np.int64)
            shares = [share for share, *_ in model.votes(model.vocabulary.found(batch.column(1)), leave)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(shares, pa.float64())],
                                             names=["doc_id", "toxic", "share"])

    votes = texts.select("doc_id", "text", "toxic").mapInArrow(left_out, "doc_id long, toxic int, share double") \
        .where(F.col("share").isNotNull()).toArrow().sort_by([("doc_id", "ascending"), ("share", "ascending")])
    if votes.num_rows:
        truth = votes["toxic"].to_numpy().astype(np.int64)
        model.curve = logistic_curve(votes["share"].to_numpy(), truth, np.array(weight)[truth])
    return model


def score(docs: DataFrame, model: ToxicityModel | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, score, evidence array<struct<doc_id, cosine, toxic>>)`` for every document; no shuffle.

    The model is broadcast: its size is bounded by the examples' texts.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("evidence", _EVIDENCE)])
    make = model.maker() if model else lambda: None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = make()
        known: dict[bytes, tuple[float, np.ndarray, np.ndarray]] = {}  # of the same text: scored alike
        for batch in in_parts(batches):
            if model is None:
                scores, evidence = np.zeros(batch.num_rows), pa.array([[]] * batch.num_rows, _EVIDENCE)
            else:
                keys = [hashlib.blake2b((t.as_py() or "").encode("utf-8", "surrogatepass"), digest_size=16).digest()
                        for t in batch.column(1)]
                if len(known) > KNOWN:
                    known.clear()
                new = {key: row for row, key in enumerate(keys) if key not in known}
                texts = batch.column(1).take(pa.array(list(new.values()), pa.int64()))
                known.update(zip(new, model.scores(model.vocabulary.found(texts)), strict=True))
                found = [known[key] for key in keys]
                scores = np.array([f[0] for f in found])
                evidence = model.evidence([f[1] for f in found], [f[2] for f in found])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), evidence], schema=schema)

    return id_and_text(docs, id_col, text_col).mapInArrow(
        run, "doc_id long, score double, evidence array<struct<doc_id: bigint, cosine: double, toxic: int>>")


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``(doc_id, held_out, score, predicted, evidence)`` for every document."""
    scored = score(docs, fit(docs, labels))
    return scored.select("doc_id", held_out().alias("held_out"), "score",
                         (F.col("score") >= threshold).cast("int").alias("predicted"), "evidence")
