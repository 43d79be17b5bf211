"""Column -> Column text expressions (all JVM-side built-ins).

These compose into DataFrame jobs in ``lanternqa.operators``; none of
them leaves the JVM, so they stay inside whole-stage code generation or
Spark's interpreted higher-order functions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .constants import (ARTICLES, ASCII_PUNCTUATION, KEPT_TOKEN_PATTERN, STOPWORDS,
                        TOKEN_PATTERN)

FILTER_MODES = ("any", "all", "ends")


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def tokenize(text: Column | str) -> Column:
    """B2: array of tokens (word runs, else single visible characters)."""
    return F.regexp_extract_all(_col(text), F.lit(TOKEN_PATTERN), 0)


def words(tokens: Column | str, uncased: bool = False) -> Column:
    """Token texts, optionally lower-cased token by token."""
    tokens = _col(tokens)
    return F.transform(tokens, F.lower) if uncased else tokens


def token_count(tokens: Column | str) -> Column:
    """Number of tokens."""
    return F.size(_col(tokens))


def token_slice(tokens: Column | str, i: int | None = None, j: int | None = None) -> Column:
    """Python slice ``tokens[i:j]`` (negative and missing bounds allowed)."""
    tokens = _col(tokens)
    n = F.size(tokens)

    def bound(v: int | None, default: Column) -> Column:
        if v is None:
            return default
        raw = F.lit(v) if v >= 0 else n + F.lit(v)
        return F.least(F.greatest(raw, F.lit(0)), n)

    lo = bound(i, F.lit(0))
    hi = bound(j, n)
    length = F.greatest(hi - lo, F.lit(0))
    return F.when(length > 0, F.slice(tokens, lo + 1, length)).otherwise(
        F.array().cast("array<string>"))


def is_filtered_word(word: Column) -> Column:
    """True when the word is all punctuation or an English stop word."""
    return word.rlike(r"^\p{P}+$") | F.lower(word).isin(*STOPWORDS)


def filter_ngram(gram: Column, mode: str = "any") -> Column:
    """True when the n-gram should be dropped under ``mode``."""
    if mode == "any":
        return F.exists(gram, is_filtered_word)
    if mode == "all":
        return F.forall(gram, is_filtered_word)
    if mode == "ends":
        return is_filtered_word(F.get(gram, 0)) | is_filtered_word(
            F.get(gram, F.size(gram) - 1))
    raise ValueError(f"Invalid mode: {mode}")


def ngrams(ws: Column | str, n: int = 1,
           filter_fn: Callable[[Column], Column] | None = None,
           as_strings: bool = True) -> Column:
    """All n-grams of length 1..n, ordered by start then length.

    ``filter_fn`` maps an array<string> gram column to a boolean "drop"
    column.  With ``as_strings`` the grams are joined by one space.
    """
    ws = _col(ws)
    if n < 1:
        raise ValueError("n must be >= 1")
    if n == 1:
        grams = F.transform(ws, lambda w: F.array(w))
    else:
        size = F.size(ws)
        grams = F.when(
            size > 0,
            F.flatten(F.transform(
                F.sequence(F.lit(1), size),
                lambda i: F.transform(
                    F.sequence(F.lit(1), F.least(F.lit(n), size - i + 1)),
                    lambda m: F.slice(ws, i, m)))),
        ).otherwise(F.array().cast("array<array<string>>"))
    if filter_fn is not None:
        grams = F.filter(grams, lambda g: ~filter_fn(g))
    if as_strings:
        return F.transform(grams, lambda g: F.array_join(g, " "))
    return grams


def unigram_terms(text: Column | str) -> Column:
    """B8+B10 for n=1, mode 'any', straight from the text.

    Punctuation tokens are skipped by the pattern itself.  Each token is
    lower-cased by itself, as lower case can depend on what follows (a
    final sigma) and the next token must not count.
    """
    found = F.regexp_extract_all(_col(text), F.lit(KEPT_TOKEN_PATTERN), 0)
    return F.filter(F.transform(found, F.lower), lambda w: ~w.isin(*STOPWORDS))


def parse_terms(text: Column | str, n: int = 1, mode: str = "any") -> Column:
    """Text -> uncased, filtered n-gram strings (NFD is applied by callers).

    For ``n > 1`` prefer ``with_parsed_terms``: the n-gram lambdas read the
    word array once per element, so it should be a materialised column.
    """
    if n == 1 and mode == "any":
        return unigram_terms(text)
    ws = words(tokenize(text), uncased=True)
    return ngrams(ws, n, filter_fn=lambda g: filter_ngram(g, mode))


def with_parsed_terms(df, text: Column, keep: tuple[str, ...], n: int = 1, mode: str = "any",
                      out: str = "terms"):
    """B11 over a DataFrame: ``(keep..., out)``; the words are a column first."""
    if mode not in FILTER_MODES:
        raise ValueError(f"Invalid mode: {mode}")
    if n == 1 and mode == "any":
        return df.select(*keep, unigram_terms(text).alias(out))
    w = df.select(*keep, words(tokenize(text), uncased=True).alias("_w"))
    return w.select(*keep, ngrams("_w", n, filter_fn=lambda g: filter_ngram(g, mode)).alias(out))


def term_frequencies(df, terms_col: str = "terms", keep: tuple[str, ...] = ("doc_id",)):
    """In-row term counts: one ``(keep..., term, tf)`` row per distinct term.

    The terms are sorted, run starts are found in one pass and each run
    length is the gap to the next start.  Everything of one document is
    in one row, so counting needs no shuffle.  Each step is its own
    projection so the lambdas read materialised arrays, not expressions.
    """
    keep_cols = [F.col(c) for c in keep]
    s = df.select(*keep_cols, F.sort_array(terms_col).alias("_s"))
    s = s.select(*keep, "_s", F.size("_s").alias("_n"))
    starts = s.select(*keep, "_s", "_n", F.filter(
        F.sequence(F.lit(1), F.greatest(F.col("_n"), F.lit(1))),
        lambda i: (i <= F.col("_n")) & (
            (i == 1) | (F.element_at("_s", i) != F.element_at("_s", F.greatest(i - 1, F.lit(1)))))
    ).alias("_starts"))
    return starts.select(*keep, F.inline(F.transform(
        "_starts",
        lambda p, j: F.struct(
            F.element_at("_s", p).alias("term"),
            (F.coalesce(F.try_element_at("_starts", j + 2), F.col("_n") + 1) - p)
            .cast("long").alias("tf")))))


def join_tokens(tokens: Column | str, sep: str = " ") -> Column:
    return F.array_join(_col(tokens), sep)


def contains_token_run(doc_words: Column, answer_words: Column) -> Column:
    """G1 core: is ``answer_words`` a contiguous run inside ``doc_words``?

    Both sides are joined with U+0001, which cannot be inside a token
    (it is a control character), so substring search equals run search.
    An empty answer is found in every document.
    """
    sep = "\u0001"
    hay = F.concat(F.lit(sep), F.array_join(doc_words, sep), F.lit(sep))
    needle = F.concat(F.lit(sep), F.array_join(answer_words, sep), F.lit(sep))
    return F.when(F.size(answer_words) == 0, F.lit(True)).otherwise(F.contains(hay, needle))


_WORD = r"[\p{L}\p{N}_]"
# Python's str.isspace() set: Unicode White_Space plus the four separators
# U+001C..U+001F.
PY_SPACE = r"(?U)[\s\x1c-\x1f]"


def normalize_answer(text: Column | str) -> Column:
    """Lower, drop ASCII punctuation, drop articles, squeeze spaces."""
    s = F.lower(_col(text))
    s = F.translate(s, ASCII_PUNCTUATION, "")
    articles = "|".join(ARTICLES)
    s = F.regexp_replace(s, rf"(?<!{_WORD})({articles})(?!{_WORD})", " ")
    s = F.regexp_replace(s, PY_SPACE + "+", " ")
    return F.regexp_replace(s, r"^ +| +$", "")


def strip_whitespace(text: Column | str) -> Column:
    """Remove every whitespace character."""
    return F.regexp_replace(_col(text), PY_SPACE + "+", "")


def strip_edges(text: Column) -> Column:
    """Python ``str.strip()`` for the whitespace classes that occur in text."""
    return F.regexp_replace(text, "^" + PY_SPACE + "+|" + PY_SPACE + "+$", "")
