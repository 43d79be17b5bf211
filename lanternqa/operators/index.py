"""The weighted term index, built as DataFrame jobs.

Layout (all long form, one row per fact):

* ``postings(doc_id, term, tf, dl)`` - produced in the document's own row:
  the document is parsed, its terms are counted in-row and exploded, so
  building postings needs no shuffle at all.
* ``docs(doc_id, dl)`` - kept n-grams per document (empty documents: 0),
  from the parsed row as well.
* ``terms(term, df)`` - partial + final aggregation of the postings.
* ``meta`` - one row: ``n_docs``, ``total_terms``, and the parameters.

A stored index keeps the postings bucketed by ``doc_id`` and sorted by
``term``: sums per (query, document) need no exchange, and joins with the
stored ``terms`` can be split by AQE (dealing the postings out by document,
when they are stored, is their one shuffle).  ``sources/segments.py`` holds
the layout by term parts that questions are answered from.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import arrow
from ..functions.constants import BM25_B, BM25_K1
from ..functions.text import FILTER_MODES, term_frequencies, with_parsed_terms


def normalized_text(text: Column, unicode_form: str | None) -> Column:
    """Apply the index's Unicode normalisation (``'NFD'`` or ``None``).

    ASCII texts (as many bytes as characters) are in every form and stay in
    the JVM; only the others go through the Arrow function.
    """
    if unicode_form is None:
        return text
    if unicode_form != "NFD":
        raise ValueError(f"unsupported unicode form: {unicode_form}")
    other = F.when(F.octet_length(text) != F.length(text), text)
    return F.coalesce(arrow.nfd(other), text)


def document_terms(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   ngram: int = 1, mode: str = "any",
                   unicode_form: str | None = "NFD") -> DataFrame:
    """B11 over a table: ``(doc_id, terms array<string>)``, one row per doc."""
    if mode not in FILTER_MODES:
        raise ValueError(f"Invalid mode: {mode}")
    text = normalized_text(F.col(text_col), unicode_form)
    base = docs.select(F.col(id_col).alias("doc_id"), text.alias("_text"))
    parsed = with_parsed_terms(base, F.col("_text"), ("doc_id",), ngram, mode, "terms")
    return parsed.select("doc_id", F.coalesce("terms", F.array().cast("array<string>")).alias("terms"))


@dataclass(frozen=True)
class TermIndex:
    """The index as DataFrames plus the parameters that produced it.

    ``postings`` carries each document's length ``dl``; ``docs`` lists every
    document (also the empty ones, which have no postings).  A stored index
    has ``stored_terms``, ``n`` and ``total``; else they are computed.
    ``hash_size``: terms are bucket numbers (C8).
    """

    postings: DataFrame
    docs: DataFrame
    ngram: int = 1
    mode: str = "any"
    unicode_form: str | None = "NFD"
    k1: float = BM25_K1
    b: float = BM25_B
    hash_size: int | None = None
    stored_terms: DataFrame | None = None
    n: int | None = None
    total: int | None = None

    @property
    def doc_ids(self) -> DataFrame:
        return self.docs.select("doc_id")

    @property
    def terms(self) -> DataFrame:
        """``(term, df)``.  Postings of a hot term are counted per task first."""
        if self.stored_terms is not None:
            return self.stored_terms
        return self.postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"))

    @property
    def stats(self) -> DataFrame:
        """C4: ``(n_docs, avgdl)``, one row."""
        return self.docs.agg(F.count(F.lit(1)).alias("n_docs"), F.avg("dl").alias("avgdl"))

    def n_docs(self) -> Column:
        """Number of documents: stored, or a scalar subquery."""
        return F.lit(self.n) if self.n is not None else self.docs.agg(F.count(F.lit(1))).scalar()

    def total_terms(self) -> Column:
        """Kept n-grams in the corpus (= sum of all dl): stored, or a scalar subquery."""
        if self.total is not None:
            return F.lit(float(self.total))
        return self.docs.agg(F.coalesce(F.sum("dl"), F.lit(0)).cast("double")).scalar()

    def avgdl(self) -> Column:
        """Mean document length, empty documents included."""
        return self.total_terms() / self.n_docs()


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                ngram: int = 1, mode: str = "any", unicode_form: str | None = "NFD",
                k1: float = BM25_K1, b: float = BM25_B) -> TermIndex:
    """Parse every document and derive postings and lengths from its row."""
    parsed = document_terms(docs, id_col, text_col, ngram, mode, unicode_form)
    parsed = parsed.select("doc_id", "terms", F.size("terms").cast("long").alias("dl"))
    postings = term_frequencies(parsed, "terms", keep=("doc_id", "dl")) \
        .select("doc_id", "term", "tf", "dl")
    return TermIndex(postings, parsed.select("doc_id", "dl"), ngram, mode, unicode_form, k1, b)


def term_counts(index: TermIndex) -> DataFrame:
    """``(term, doc_id, tf)``."""
    return index.postings.select("term", "doc_id", "tf")


def doc_freqs(index: TermIndex, terms: DataFrame | None = None) -> DataFrame:
    """``(term, df)``; restricted to ``terms`` (a one-column table) if given."""
    found = index.terms
    return found if terms is None else found.join(terms.select("term"), "term", "left_semi")


def doc_lengths(index: TermIndex) -> DataFrame:
    """``(doc_id, dl)``."""
    return index.docs


def corpus_stats(index: TermIndex) -> DataFrame:
    """C4: ``(n_docs, avgdl)``."""
    return index.stats


def idf_column(df: Column, n_docs: Column) -> Column:
    """``max(0, ln((N - df + 0.5) / (df + 0.5)))``."""
    return F.greatest(F.log((n_docs - df + 0.5) / (df + 0.5)), F.lit(0.0))


def idf(index: TermIndex, terms: DataFrame | None = None) -> DataFrame:
    """``(term, df, idf)``."""
    return doc_freqs(index, terms).withColumn("idf", idf_column(F.col("df"), index.n_docs()))


def bm25_tf_part(tf: Column, dl: Column, avgdl: Column, k1: float, b: float) -> Column:
    """The document side of BM25 without idf."""
    return tf * (k1 + 1.0) / (tf + k1 * (1.0 - b + b * dl / avgdl))


def tfidf_weights(index: TermIndex) -> DataFrame:
    """``(term, doc_id, weight = ln(1+tf) * idf)``."""
    return (index.postings.join(idf(index), "term")
            .select("term", "doc_id", (F.log1p("tf") * F.col("idf")).alias("weight")))


def bm25_weights(index: TermIndex) -> DataFrame:
    """``(term, doc_id, weight = idf * tf(k1+1) / (tf + k1(1-b+b dl/avgdl)))``."""
    part = bm25_tf_part(F.col("tf"), F.col("dl"), index.avgdl(), index.k1, index.b)
    return (index.postings.join(idf(index), "term")
            .select("term", "doc_id", (F.col("idf") * part).alias("weight")))


def bucket_of(term: Column, num_buckets: int) -> Column:
    """``murmur3_32(term, seed 0) mod num_buckets``."""
    return arrow.murmur3_unsigned(term) % num_buckets


def hash_terms(df: DataFrame, num_buckets: int, term_col: str = "term") -> DataFrame:
    """Add ``bucket``; each batch of terms is hashed at once, no join."""
    return df.withColumn("bucket", bucket_of(F.col(term_col), num_buckets))


def hashed_index(index: TermIndex, num_buckets: int) -> TermIndex:
    """Postings keyed by hash bucket; colliding terms add their counts."""
    postings = (hash_terms(index.postings, num_buckets)
                .groupBy("doc_id", "bucket")
                .agg(F.sum("tf").cast("long").alias("tf"), F.first("dl").alias("dl"))
                .select("doc_id", F.col("bucket").cast("string").alias("term"), "tf", "dl"))
    return replace(index, postings=postings, hash_size=num_buckets, stored_terms=None)
