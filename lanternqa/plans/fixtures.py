"""Inputs derived from the driver tables (see FIXTURES.md).

* corpus: ``documents(doc_id, text)``
* questions: every ``benchmark`` item, its whole text is the question and
  ``array(text)`` the answer list (the items are passages of documents).
* reader scores: an arithmetic scorer on (document, token position),
  standing in for the span model.
* NER tags: ``'ENT'`` when a token starts with an upper-case letter.
* entity catalogue: every ``embeddings`` vector, entity ``'E' || label``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.documents import read_documents


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


#: Session setting: deal the corpus out over so many partitions before it is
#: parsed.  Unset (as on a cluster, where the corpus has many splits), the
#: text isn't moved.
DOCUMENT_PARTITIONS = "spark.lanternqa.documents.partitions"


def documents(spark: SparkSession, sf_dir: str, parsed: bool = True) -> DataFrame:
    """The corpus; ``parsed=False`` for queries that don't work on the text."""
    wanted = spark.conf.get(DOCUMENT_PARTITIONS, None) if parsed else None
    return read_documents(spark, f"{sf_dir.rstrip('/')}/documents.parquet",
                          partitions=int(wanted) if wanted else None)


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(query_id, question, answer array<string>)`` from ``benchmark``."""
    return table(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("query_id"),
        F.col("text").alias("question"),
        F.array(F.col("text")).alias("answer"))


#: Added to an item's id for the question of its punctuation.
BLANK_ID = 1_000_000


def questions_and_blanks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The questions, and for each a blank one: its text without letters, marks and numbers."""
    q = questions(spark, sf_dir)
    return q.unionByName(q.select((F.col("query_id") + BLANK_ID).alias("query_id"), F.regexp_replace(
        "question", r"[\p{L}\p{M}\p{N}]+", "").alias("question"), "answer"))


# --- fixed values: the arithmetic stand-in for the span model ---
def fixture_start_logit(doc: Column, tok: Column) -> Column:
    return ((tok * 37 + doc * 13) % 101) / 20.0 - 4.0


def fixture_end_logit(doc: Column, tok: Column) -> Column:
    return ((tok * 53 + doc * 7) % 97) / 20.0 - 4.0


def fixture_relevance(doc: Column) -> Column:
    return (doc % 11) / 10.0


def fixture_model():
    """A model over tokens, for ``score_passages_with``: arithmetic on their lengths, outer characters and places."""
    def model(seqs):
        out = []
        for tokens in seqs:
            starts = [(37 * len(t) + 13 * ord(t[0]) + i) % 101 / 20.0 - 4.0 for i, t in enumerate(tokens)]
            ends = [(53 * len(t) + 7 * ord(t[-1]) + i) % 97 / 20.0 - 4.0 for i, t in enumerate(tokens)]
            out.append((starts, ends, len(tokens) % 11 / 10.0))
        return out
    return model


def fixture_ner_tag(token: Column) -> Column:
    """'ENT' for tokens whose first character is upper case, else 'O'."""
    first = F.substring(token, 1, 1)
    return F.when((F.upper(first) == first) & (F.lower(first) != first), F.lit("ENT")) \
        .otherwise(F.lit("O"))


def fixture_pos_tag(token: Column) -> Column:
    return F.when(token.rlike(r"^\p{N}+$"), F.lit("NUM")).when(token.rlike(r"^\p{P}+$"), F.lit("PUNCT")).otherwise(F.lit("WORD"))


def fixture_lemma(token: Column) -> Column:
    """Lower case without a closing s."""
    return F.regexp_replace(F.lower(token), "s$", "")


TAGGERS = {"pos_tag": fixture_pos_tag, "lemma": fixture_lemma, "ner": fixture_ner_tag}
