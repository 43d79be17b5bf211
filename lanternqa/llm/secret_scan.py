"""Secret scan: fixed patterns, and zstandard novelty in sensitive contexts.

The base patterns (assignments, access keys, long hex runs) give spans
that always stay.  Beyond them, every unbroken string of
``LEAST`` code points or more with a sensitive word in the ``AROUND`` code
points on either side, on whatever line, is a candidate: its marginal compressed size is what the
compressor, primed with a dictionary of common identifiers, needs for the
text around it with the candidate, minus what it needs without.  Other
occurrences of the candidate are taken out of the text around it first.  Words,
placeholders and repeated identifiers cost next to nothing; a string that
costs about as much as its alphabet allows is reported as ``novel``.

Defined cases: a NULL text counts as empty (no spans); offsets are code
points, end exclusive; repeated rows are scanned alike; an empty table
gives an empty result; extra columns are ignored; a NULL id stays NULL.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections.abc import Callable, Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import id_and_text, map_texts

KINDS = ("assign", "access", "hex", "novel")
BASE_KINDS = KINDS[:3]


def _either(word: str) -> str:
    """The word's ASCII letters in either case (no Unicode case folding)."""
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


ASSIGN = re.compile("(" + "|".join(map(_either, ("password", "passwd", "secret", "token"))) + "|"
                    + _either("api") + "_?" + _either("key")
                    + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ASSIGN_WORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
# the longest runs of these alphabets, so the least length can stand in the pattern
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")

SENSITIVE_WORDS = ("passphrase", "pwd", "credential", "bearer", "authorization", "private_key", "private key",
                   "access_key", "access key", "client_secret", "auth_token", "signing_key", "encryption_key",
                   "session_key", "password", "passwd", "secret", "token", "apikey", "api_key")
SENSITIVE = re.compile("|".join(map(_either, SENSITIVE_WORDS)))
LEAST = 16  # code points of a candidate
RUN = re.compile(r"\S{%d,}" % LEAST)
#: What may part strings of a run; a run that isn't novel as a whole is measured in its parts.
PARTED = re.compile(r"""[^\s"'`()\[\]{}<>,;:=&?|]{%d,}""" % LEAST)
JOINT = re.compile(r"""["'`][,:;=]+["'`]?""")  # where one quoted string ends and the next begins
EDGES = "\"'`()[]{}<>,;:."  # around a string, not of it
#: What the compressor knows beforehand: plain identifiers and placeholders around secrets.
IDENTIFIERS = (
    "password passwd secret token api_key apikey access_key private_key client_secret client_id auth authorization "
    "bearer basic credential credentials session_key signing_key encryption_key public_key username user_name email "
    "config configuration settings environment getenv os.environ process.env System.getenv properties parameter "
    "default_value placeholder example_value your_api_key_here your-secret-key changeme change_me insert_token_here "
    "xxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxx 0000000000000000 1234567890 0123456789 abcdefghijklmnopqrstuvwxyz "
    "ABCDEFGHIJKLMNOPQRSTUVWXYZ request response headers content_type application/json import return function "
    "public static final String private const let var def class self this null None true false undefined "
)
AROUND = 1024  # code points of surrounding text on either side
NOVELTY = 0.85  # of the bytes a random string of the same alphabet and length needs


def alphabet_size(s: str) -> int:
    """Size of the smallest usual alphabet that holds the ASCII string."""
    if re.fullmatch(r"[0-9]+", s):
        return 10
    if re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", s):
        return 16
    if re.fullmatch(r"[A-Za-z]+", s):
        return 26 if s.lower() == s or s.upper() == s else 52
    if not re.fullmatch(r"[A-Za-z0-9+/_=-]+", s):
        return 94
    return 36 if s.lower() == s or s.upper() == s else 64


def random_bits(s: str) -> float:
    """Bits of a random string of the same alphabet and length; beyond ASCII, all of the bytes."""
    ascii_only = "".join(c for c in s if c < "\x80")
    rest = len(s.encode("utf-8", "surrogatepass")) - len(ascii_only)
    return 8 * rest + (len(ascii_only) * math.log2(alphabet_size(ascii_only)) if ascii_only else 0)


def novelty_meter() -> Callable[[str, str], float]:
    """``f(surrounding, candidate)``: marginal compressed bytes over the random string's bytes."""
    primed = zstandard.ZstdCompressionDict(IDENTIFIERS.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    packer = zstandard.ZstdCompressor(level=9, dict_data=primed, write_checksum=False, write_content_size=False,
                                      write_dict_id=False)

    def cost(text: str) -> int:
        return len(packer.compress(text.encode("utf-8", "surrogatepass")))

    def novelty(surrounding: str, candidate: str) -> float:
        extra = cost(surrounding + candidate) - cost(surrounding)
        return extra * 8 / random_bits(candidate)

    return novelty


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """``(start, end, kind)`` of the base patterns, by start, then kind."""
    found: list[tuple[int, int, str]] = []
    data = text.encode("utf-8", "surrogatepass").lower()
    if any(w in data for w in ASSIGN_WORDS):
        found += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(*m.span(), "access") for m in ACCESS.finditer(text)]
    found += [(*m.span(), "hex") for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


def strings(text: str, known: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """``(start, end)`` of what the ``known`` spans (in order) leave of the text's unbroken strings, without ``EDGES``."""
    i = 0
    for run in RUN.finditer(text):
        at = run.start()
        while i < len(known) and known[i][1] <= at:
            i += 1
        j, pieces = i, []
        while j < len(known) and known[j][0] < run.end():
            pieces.append((at, known[j][0]))
            at = max(at, known[j][1])
            j += 1
        i = max(i, j - 1)
        pieces.append((at, run.end()))
        joints = [(s, e, [m.span() for m in JOINT.finditer(text, s, e)]) for s, e in pieces if s < e]
        for s, e in [p for s, e, cuts in joints for p in zip([s, *[c[1] for c in cuts]], [*[c[0] for c in cuts], e], strict=True)]:
            while s < e and text[s] in EDGES + "=":
                s += 1
            while s < e and text[e - 1] in EDGES:
                e -= 1
            if e - s >= LEAST:
                yield s, e


def scanner() -> Callable[[str], tuple]:
    """``f(text)``: its spans as ``[{kind, start, end, novelty}]``."""
    novelty = novelty_meter()
    words = tuple(w.encode() for w in SENSITIVE_WORDS)

    def scan(text: str) -> tuple:
        spans = [(s, e, k, None) for s, e, k in base_spans(text)]
        data = text.encode("utf-8", "surrogatepass").lower()
        if any(w in data for w in words):
            sensitive = [m.span() for m in SENSITIVE.finditer(text)]
            starts, ends = [s for s, _ in sensitive], [e for _, e in sensitive]
            # neither sensitive words nor base spans are part of a candidate
            known = sorted(sensitive + [s[:2] for s in spans])

            def measured(s: int, e: int) -> float | None:
                """The novelty, where a sensitive word is in the context."""
                i = bisect_left(ends, s - AROUND)
                if i == len(starts) or starts[i] > e + AROUND:
                    return None
                around = text[max(0, s - AROUND):s] + "\n" + text[e:e + AROUND]
                return novelty(around.replace(text[s:e], ""), text[s:e])

            for s, e in strings(text, known):
                value = measured(s, e)
                if value is not None and value >= NOVELTY:
                    spans.append((s, e, "novel", value))
                    continue
                for m in PARTED.finditer(text, s, e):
                    value = None if m.span() == (s, e) else measured(*m.span())
                    if value is not None and value >= NOVELTY:
                        spans.append((*m.span(), "novel", value))
        spans.sort(key=lambda x: (x[0], KINDS.index(x[2])))
        return ([{"kind": k, "start": s, "end": e, "novelty": v} for s, e, k, v in spans],)

    return scan


_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("novelty", pa.float64())])


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, spans array<struct<kind, start, end, novelty>>)``, by start, then kind; no shuffle."""
    return map_texts(id_and_text(docs, id_col, text_col), None,
                     [("spans", pa.list_(_SPAN),
                       "array<struct<kind: string, start: bigint, `end`: bigint, novelty: double>>")], make=scanner)


def redacted(text: Column, spans: Column) -> Column:
    """The text with every span replaced by ``[kind]``, later spans first; overlaps are cut once."""
    def cut(acc: Column, s: Column) -> Column:
        return F.when(s["end"] > acc["at"], acc).otherwise(F.struct(
            F.concat(F.substring(acc["text"], F.lit(1), s["start"].cast("int")), F.lit("["), s["kind"], F.lit("]"),
                     F.substring(acc["text"], (s["end"] + 1).cast("int"), F.length(acc["text"]))).alias("text"),
            s["start"].alias("at")))
    start = F.struct(text.alias("text"), F.lit(2**62).alias("at"))
    return F.aggregate(F.reverse(spans), start, cut, lambda acc: acc["text"])


def spelled(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def of_kinds(spans: Column, kinds: tuple[str, ...]) -> Column:
    return F.filter(spans, lambda s: s["kind"].isin(*kinds))
