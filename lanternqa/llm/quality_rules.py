"""Quality rules kept as a bitmask ledger.

Every rule is evaluated once per document.  The ledger stores, per
document, the measurements and one ``failures`` long whose bit *i* says
that rule *i* failed.  Policies are versioned sets of rules: applying one,
comparing two or asking what each rule adds (ablation) reads the ledger
only, by bitwise arithmetic - texts are never read again.

Defined cases: a NULL text counts as empty (no words, rule ``few_words``
fails); repeated rows are judged one by one and alike; an empty table
gives an empty ledger; extra input columns are ignored; a NULL ``doc_id``
stays NULL.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, id_and_text, map_texts

SYMBOLS = b"#*$%&|<>"
WHITE = b" \t\n\x0b\x0c\r"

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
            "n_lines", "n_letters", "n_capitals")


def repeat_words(words: list[bytes]) -> int:
    """Words that lie in a 3-word window found twice or more in the text."""
    n = len(words)
    if n < 4:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), dtype=np.int64, count=n)
    k = len(seen)
    pair = ids[:-2] * k + ids[1:-1]
    if k >= 1 << 21:  # three ids no longer fit in 63 bits: number the pairs first
        pair = np.unique(pair, return_inverse=True)[1].astype(np.int64)
    key = pair * k + ids[2:]
    order = np.sort(key)
    twice = order[1:][order[1:] == order[:-1]]
    if not len(twice):
        return 0
    hit = np.isin(key, twice)
    cover = np.zeros(n, dtype=bool)
    for shift in range(3):
        cover[shift:shift + n - 2] |= hit
    return int(cover.sum())


def measure(text: str) -> tuple[int, ...]:
    """The values of ``MEASURES`` for one whole text."""
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()  # bytes.split() parts at exactly [\x20\x09-\x0D]
    lines = [x for x in data.split(b"\n") if x.strip()]
    raw = np.frombuffer(data, dtype=np.uint8)
    capitals = int(((raw >= 65) & (raw <= 90)).sum())
    small = int(((raw >= 97) & (raw <= 122)).sum())
    return (len(words),
            len(text) - sum(data.count(c) for c in WHITE),
            sum(data.count(c) for c in SYMBOLS),
            len(lines) - len(set(lines)),
            repeat_words(words),
            len(lines), capitals + small, capitals)


def _over(part: str, percent: int, whole: str) -> Column:
    return F.lit(100) * F.col(part) > F.lit(percent) * F.col(whole)


#: (name, failed).  A rule's place is its bit and never changes; new rules go at the end.
RULES: tuple[tuple[str, Callable[[], Column]], ...] = (
    ("few_words", lambda: F.col("n_words") < 50),
    ("repeated_windows", lambda: _over("n_repeat_words", 50, "n_words")),
    ("symbols", lambda: _over("n_symbols", 10, "n_words")),
    ("capitals", lambda: _over("n_capitals", 30, "n_letters")),
    ("repeated_lines", lambda: _over("n_dup_lines", 30, "n_lines")),
    ("word_length", lambda: (F.col("word_chars") < 2 * F.col("n_words"))
     | (F.col("word_chars") > 20 * F.col("n_words"))),
)
BIT = {name: 1 << i for i, (name, _) in enumerate(RULES)}

#: Versioned policies: the rules whose failure rejects a document.
POLICIES: dict[str, tuple[str, ...]] = {
    "base": ("few_words", "repeated_windows"),
    "v1": ("few_words", "repeated_windows", "symbols", "capitals", "word_length"),
    "strict": ("few_words", "repeated_windows", "symbols", "capitals", "repeated_lines", "word_length"),
}


def mask_of(rules: Iterable[str]) -> int:
    """The bits of some rules; an unknown name raises ``KeyError``."""
    mask = 0
    for name in rules:
        mask |= BIT[name]
    return mask


def failure_bits() -> Column:
    """Bit *i* is set where rule *i* fails, over the columns ``MEASURES``."""
    bits = F.lit(0).cast("long")
    for name, failed in RULES:
        bits = bits.bitwiseOR(F.when(failed(), F.lit(BIT[name]).cast("long")).otherwise(F.lit(0).cast("long")))
    return bits


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, *MEASURES, failures)``, one row per document, no shuffle."""
    fields = [(m, pa.int64(), "long") for m in MEASURES]
    measured = map_texts(id_and_text(docs, id_col, text_col), measure, fields)
    return measured.withColumn("failures", failure_bits())


def kept_documents(docs: DataFrame, policy: str, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that the policy keeps, columns as they were; no shuffle.

    The measurements stand beside each row, so ids need not be unique.
    """
    @F.arrow_udf("struct<" + ", ".join(f"{m}: bigint" for m in MEASURES) + ">")
    def measured(texts: pa.Array) -> pa.Array:
        found = np.array([measure(t.as_py() or "") for t in texts], dtype=np.int64).reshape(-1, len(MEASURES))
        return pa.StructArray.from_arrays([pa.array(found[:, i]) for i in range(len(MEASURES))], names=list(MEASURES))

    bounded_batches(docs.sparkSession)
    own = [F.col(f"`{c}`") for c in docs.columns]
    beside = docs.select(F.struct(*own).alias("__row"), measured(F.col(text_col).cast("string")).alias("__m"))
    bits = beside.select("__row", "__m.*").withColumn("failures", failure_bits())
    return bits.where(~rejected(policy)).select("__row.*")


def rejected(policy: str, failures: str = "failures") -> Column:
    """True where a rule of the policy failed."""
    return F.col(failures).bitwiseAND(F.lit(mask_of(POLICIES[policy])).cast("long")) != 0


def apply_policy(book: DataFrame, policy: str) -> DataFrame:
    """The ledger with ``kept`` and ``reasons`` (names of the failed rules of the policy)."""
    names = [F.when(F.col("failures").bitwiseAND(F.lit(BIT[r]).cast("long")) != 0, F.lit(r))
             for r in POLICIES[policy]]
    return book.withColumn("kept", ~rejected(policy)).withColumn("reasons", F.array_compact(F.array(*names)))


def ablations(book: DataFrame, policy: str) -> DataFrame:
    """What each rule of a policy adds: ``(rule, failed, sole, rejected_without)``.

    The ledger shrinks to one row per failure pattern (``2**rules`` at most)
    before any rule is looked at: ``sole`` counts the documents that only
    this rule rejects, ``rejected_without`` those rejected if it is left out.
    """
    mask = mask_of(POLICIES[policy])
    patterns = book.groupBy(F.col("failures").bitwiseAND(F.lit(mask).cast("long")).alias("bits")) \
        .agg(F.count(F.lit(1)).alias("n"))
    rules = F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(BIT[r]).cast("long").alias("bit"))
                      for r in POLICIES[policy]])
    each = patterns.select("bits", "n", F.explode(rules).alias("r")).select("bits", "n", "r.rule", "r.bit")
    count = lambda cond: F.sum(F.when(cond, F.col("n")).otherwise(F.lit(0))).cast("long")
    return each.groupBy("rule").agg(
        count(F.col("bits").bitwiseAND(F.col("bit")) != 0).alias("failed"),
        count(F.col("bits") == F.col("bit")).alias("sole"),
        count(F.col("bits").bitwiseAND(F.bitwise_not(F.col("bit"))) != 0).alias("rejected_without"))
