"""G2 helpers: answer patterns in the ``regex`` dialect, in Java where that is provably the same.

Patterns are searched ignoring case, Unicode-aware and line by line.  One
that is a plain regular expression - literals, ``.``, simple sets, general
categories, anchors, groups, alternatives, counts - describes a set of
strings, so whether a text holds one of them doesn't depend on how an engine
searches.  Such a pattern is written anew without any flag: every letter as
the set of its case variants, anchors as look-arounds, ``.`` as all but a
line feed.  Everything else (back-references, possessive counts, set
operations, word boundaries, inline flags, counts without bound on a group,
which Java repeats by recursion, and very long patterns) runs in the
``regex`` package itself.
"""

from __future__ import annotations

import re
import sys
from collections import defaultdict
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F
from pyspark.sql import types as T

ATOMS = 1000  # Java matches one atom a stack frame
GROUP_COUNT = 20

_TOKEN = re.compile(r"""
    (?P<mark>\\[!-/:;=?@\[-`{-~]) | (?P<control>\\[nrt]) | (?P<category>\\p\{[LNPSZ]\})
  | (?P<set>\[\^?(?:\\p\{[LMNPSZ]\}|\\[!-/:;=?@\[-`{-~nrt]|[a-zA-Z0-9]-[a-zA-Z0-9]|[^\\\[\]^&|~\-])+\])
  | (?P<open>\((?:\?:|\?P<\w+>)?) | (?P<close>\)) | (?P<bar>\|) | (?P<start>\^) | (?P<end>\$) | (?P<dot>\.)
  | (?P<count>(?:[*+?]|\{\d{1,3}(?:,\d{0,3})?\})\??) | (?P<literal>[^\\\[\](){}|.*+?^$])""", re.VERBOSE)
_ITEM = re.compile(r"(\\p\{(.)\})|\\(.)|(.)-(.)|(.)", re.DOTALL)
_CONTROLS = {"n": "\n", "r": "\r", "t": "\t"}
_SINGLE = ("mark", "control", "category", "set", "dot", "literal")


@lru_cache(maxsize=1)
def _relatives() -> dict[str, set[str]]:
    """Characters by those that one step of lower- or upper-casing relates them to (of longer forms: the first)."""
    related: dict[str, set[str]] = defaultdict(set)
    for point in range(sys.maxunicode + 1):
        c = chr(point)
        for other in (c.lower()[0], c.upper()[0]):
            if other != c:
                related[c].add(other)
                related[other].add(c)
    return related


@lru_cache(maxsize=4096)
def case_variants(c: str) -> tuple[str, ...]:
    """The characters that the literal ``c`` matches, by the ``regex`` package's own word."""
    import regex
    found, border = {c}, [c]
    while border:
        new = _relatives().get(border.pop(), set()) - found
        found |= new
        border += new
    literal = regex.compile(regex.escape(c), regex.IGNORECASE | regex.UNICODE)
    return tuple(sorted(v for v in found if literal.fullmatch(v)))


def _points(chars: set[str]) -> str:
    return "".join(rf"\x{{{ord(c):x}}}" for c in sorted(chars))


def _literal(c: str) -> str:
    return f"[{_points(set(case_variants(c)))}]"


def _set(token: str) -> str | None:
    negated, body = token[1] == "^", token[2 if token[1] == "^" else 1:-1]
    chars: set[str] = set()
    categories: set[str] = set()
    for _, category, escaped, low, high, single in _ITEM.findall(body):
        if category:
            categories.add(category)
        elif low:
            kinds = {(k.isdigit(), k.islower()) for k in (low, high)}
            if len(kinds) > 1 or low > high:
                return None
            for point in range(ord(low), ord(high) + 1):
                chars.update(case_variants(chr(point)))
        else:
            chars.update(case_variants(_CONTROLS.get(escaped, escaped) or single))
    if "M" in categories and "L" not in categories:
        return None  # a mark has a letter as its upper case
    return f"[{'^' * negated}{_points(chars)}{''.join(rf'\p{{{c}}}' for c in sorted(categories))}]"


def java_pattern(pattern: str) -> str | None:
    """A Java pattern found in exactly the texts in which ``regex`` finds the valid ``pattern``; None if that isn't proven."""
    out: list[str] = []
    at, before, atoms = 0, "", 0
    while at < len(pattern):
        m = _TOKEN.match(pattern, at)
        if not m:
            return None
        kind, token, at = m.lastgroup, m.group(), m.end()
        if kind == "count":
            bound = re.fullmatch(r"\{(\d+)(?:,(\d*))?\}\??", token)
            most = 1 if token[0] == "?" else int(bound[1] if bound[2] is None else bound[2] or 1000) if bound else 1000
            if before not in _SINGLE and not (before == "close" and most <= GROUP_COUNT):
                return None
            if bound and bound[2] and int(bound[2]) < int(bound[1]):
                return None
        translated = {
            "mark": lambda t: _literal(t[1]), "control": lambda t: _literal(_CONTROLS[t[1]]),
            "literal": _literal, "category": str, "set": _set, "open": lambda t: "(?:", "dot": lambda t: r"[^\n]",
            "start": lambda t: r"(?<![^\n])", "end": lambda t: r"(?![^\n])"}.get(kind, str)(token)
        if translated is None:
            return None
        atoms += kind in _SINGLE
        out.append(translated)
        before = kind
    return "".join(out) if atoms <= ATOMS else None


@lru_cache(maxsize=256)
def _compiled(pattern: str):
    """The compiled pattern, None where it isn't one."""
    import regex
    try:
        return regex.compile(pattern, regex.IGNORECASE | regex.UNICODE | regex.MULTILINE)
    except (regex.error, OverflowError, RecursionError, ValueError):
        return None


@F.arrow_udf(T.StructType([T.StructField("valid", T.BooleanType()), T.StructField("java", T.StringType())]))
def checked_patterns(patterns: pa.Array) -> pa.Array:
    """Whether each pattern compiles, and its Java form if that is proven; apply it to distinct patterns."""
    valid = [p is not None and _compiled(p) is not None for p in patterns.to_pylist()]
    java = [java_pattern(p) if ok else None for p, ok in zip(patterns.to_pylist(), valid, strict=True)]
    return pa.StructArray.from_arrays([pa.array(valid), pa.array(java, type=pa.string())], names=["valid", "java"])


@F.arrow_udf(T.BooleanType())
def regex_found(patterns: pa.Array, texts: pa.Array) -> pa.Array:
    """Whether the text holds a match; rows of one pattern are searched together, NULL pattern or text gives NULL."""
    out: list[bool | None] = [None] * len(patterns)
    coded = patterns.dictionary_encode()
    rows_of: dict[int, list[int]] = defaultdict(list)
    for row, code in enumerate(coded.indices.to_pylist()):
        if code is not None:
            rows_of[code].append(row)
    for code, pattern in enumerate(coded.dictionary.to_pylist()):
        rows = rows_of.get(code, [])
        found = _compiled(pattern)
        for row, text in zip(rows, pc.take(texts, pa.array(rows, type=pa.int64())), strict=True):
            out[row] = None if not text.is_valid else found is not None and found.search(text.as_py()) is not None
    return pa.array(out, type=pa.bool_())
