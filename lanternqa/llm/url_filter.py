"""URL rules fetched through their rarest literal token.

A rule is a host-and-path prefix (fits the host and its subdomains) or a
glob pattern.  Every rule becomes one regular expression over
``host + path`` and a set of literal tokens (runs of ``[a-z0-9]``) that a
fitting URL must hold as whole tokens.  The rule is filed under the one
of them that is rarest among the URLs of the whole table; a URL's own
tokens fetch its candidate rules and only those run their expressions.

Defined cases: a NULL url, or one without ``://``, has an empty host and
path, fits no prefix rule and is allowed by the patterns; repeated rows
are judged alike; an empty table gives an empty result; extra columns are
ignored.  Rules without a whole literal token are tried on every URL.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ALLOW, BLOCK = "allow", "block"
TOKEN = re.compile(rb"[a-z0-9]+")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_TO_LOWER = str.maketrans(UPPER, LOWER)


@dataclass(frozen=True)
class Rule:
    """``regex`` over ``host + path``; ``tokens`` it cannot fit without; ``prefix`` if it is one."""

    name: str
    verdict: str
    regex: str
    tokens: frozenset[str]
    prefix: bool = False


def prefix_rule(verdict: str, host: str, path: str) -> Rule:
    """Fits ``host`` and its subdomains where the URL's path starts with ``path``."""
    whole = host + path
    # the path's last run may go on in the URL, unless the prefix ends in a separator
    runs = list(re.finditer(r"[A-Za-z0-9]+", whole))
    tokens = {m[0].translate(_TO_LOWER) for m in runs if m.end() < len(whole)}
    return Rule(whole, verdict, rf"^(?:[^/]*\.)?{re.escape(whole)}", frozenset(tokens), True)


def pattern_rule(verdict: str, glob: str) -> Rule:
    """A glob over ``host + path``, in either case: ``||`` starts at a host label,
    ``*`` is any run, ``^`` one character outside ``[a-z0-9]`` or the end."""
    body = glob.removeprefix("||")
    start = r"^(?:[^/]*\.)?" if glob.startswith("||") else ""
    parts = {"*": ".*", "^": r"(?:[^a-z0-9]|$)"}
    regex = "(?is)" + start + "".join(parts.get(c) or re.escape(c) for c in body)
    tokens = set()
    for m in re.finditer(r"[A-Za-z0-9]+", body):
        left = body[m.start() - 1] if m.start() else ("." if glob.startswith("||") else "*")
        right = body[m.end()] if m.end() < len(body) else "*"
        if "*" not in (left, right):
            tokens.add(m[0].translate(_TO_LOWER))
    return Rule(glob, verdict, regex, frozenset(tokens))


#: The prefix rules of the contract, then the engine's own patterns.
PREFIX_RULES = (
    prefix_rule(BLOCK, "net", "/"),
    prefix_rule(ALLOW, "example.net", "/en/"),
    prefix_rule(BLOCK, "example.com", "/de/"),
    prefix_rule(ALLOW, "org", "/fr/"),
)
PATTERN_RULES = tuple(pattern_rule(BLOCK, g) for g in (
    "||spam-*", "||*-spam^", "||cheap-pills^", "||*-pills^", "||casino^", "||*-casino^", "||adult^", "||xxx^",
    "||doubleclick^", "||ads.", "||adserver^", "||tracker.", "/wp-login.", "/cgi-bin/", "/phpmyadmin^",
    "*-viagra^", "*free-download^")) + tuple(pattern_rule(ALLOW, g) for g in ("/robots.txt^", "/spam-policy^"))


def parts_of(url: str | None) -> tuple[str, str]:
    """``(host, path)``: host up to ``/``, ``?`` or ``#`` with A-Z lower-cased, path up to ``?`` or ``#``."""
    if url is None or (at := url.find("://")) < 0:
        return "", ""
    rest = re.split(r"[?#]", url[at + 3:], maxsplit=1)[0]
    host, slash, path = rest.partition("/")
    return host.translate(_TO_LOWER), slash + path


def tokens_of(target: str) -> set[str]:
    return {t.decode() for t in TOKEN.findall(target.encode("utf-8", "surrogatepass").lower())}


def token_counts(pages: DataFrame, rules: tuple[Rule, ...], url_col: str = "url") -> dict[str, int]:
    """URLs of the whole table that hold each rule token (at most one row per rule token)."""
    wanted = sorted({t for r in rules for t in r.tokens})
    if not wanted:
        return {}
    held = F.array_distinct(F.regexp_extract_all(F.translate(F.col(url_col), UPPER, LOWER), F.lit("[a-z0-9]+"), 0))
    rows = pages.select(F.explode(F.array_intersect(held, F.array(*[F.lit(t) for t in wanted]))).alias("token")) \
        .groupBy("token").agg(F.count(F.lit(1)).alias("n")).collect()
    return {r["token"]: r["n"] for r in rows}


def rule_index(rules: tuple[Rule, ...], counts: dict[str, int]) -> tuple[dict[str, list[int]], list[int]]:
    """Each rule's number under its rarest token (ties: first by spelling), and the rules without a token."""
    index: dict[str, list[int]] = {}
    always: list[int] = []
    for i, r in enumerate(rules):
        if r.tokens:
            index.setdefault(min(r.tokens, key=lambda t: (counts.get(t, 0), t)), []).append(i)
        else:
            always.append(i)
    return index, always


def filter_urls(pages: DataFrame, rules: tuple[Rule, ...] = PREFIX_RULES + PATTERN_RULES,
                id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """``(page_id, host, path, rule, verdict, patterns, n_candidates)`` per row.

    ``rule`` is the longest fitting prefix rule; it decides.  Without one, a
    fitting block pattern blocks unless an allow pattern fits too.
    ``patterns`` names every fitting pattern, ``n_candidates`` the
    expressions that ran.
    """
    src = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"))
    index, always = rule_index(rules, token_counts(src, rules))
    schema = pa.schema([("page_id", pa.int64()), ("host", pa.string()), ("path", pa.string()), ("rule", pa.string()),
                        ("verdict", pa.string()), ("patterns", pa.list_(pa.string())), ("n_candidates", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = [re.compile(r.regex) for r in rules]

        def judge(url: str | None) -> tuple:
            host, path = parts_of(url)
            target = host + path
            tried = sorted({i for t in tokens_of(target) for i in index.get(t, ())}.union(always))
            fits = [rules[i] for i in tried if compiled[i].search(target)]
            prefix = max((r for r in fits if r.prefix), key=lambda r: len(r.name), default=None)
            patterns = [r for r in fits if not r.prefix]
            if prefix:
                verdict = prefix.verdict
            else:
                said = {r.verdict for r in patterns}
                verdict = BLOCK if BLOCK in said and ALLOW not in said else ALLOW
            return host, path, prefix.name if prefix else None, verdict, [r.name for r in patterns], len(tried)

        for batch in batches:
            if batch.num_rows:
                columns = zip(*[judge(u.as_py()) for u in batch.column(1)], strict=True)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), *[pa.array(c, type=f.type) for c, f in zip(columns, list(schema)[1:], strict=True)]],
                    schema=schema)

    return src.mapInArrow(run, "page_id long, host string, path string, rule string, verdict string, "
                               "patterns array<string>, n_candidates int")
