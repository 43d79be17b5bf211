"""Mixing sources to target weights by iterative proportional fitting.

Tokens are summed by cell (source, language, topic).  A margin's target
tokens are its tempered shares of the budget, none above the tokens there
are: what a category cannot give is shared by the others.  Raking multiplies
the cells' probabilities, margin by margin, until their expected tokens meet
every target; a probability that reaches 1 stays there while its margin
wants more, so capping and raking do not undo each other.  Documents are
sampled with their cell's probability.  Each row has its margins' target and
reached shares.  Up to ``FEW_CELLS`` cells are raked in one piece; beyond it
(cells grow with the number of sources) cells and margins are Spark tables,
raked in the same steps, each round written to the shared folder.

Topics are told apart within each language, so that they are no second name
for it.  A language's vocabulary is the ``VOCABULARY`` terms that weigh most
in it (document frequency times idf), counted over all its documents; their
co-occurrence, again over all documents, gives the correlations of its
terms.  Along their first principal axis, on whose ends lie the terms that
keep apart, the vocabulary is cut into ``TOPICS`` topics of equal weight.  A
text has the topic whose terms weigh most in it, each topic measured by its
mean.  Every pass reads all documents and whole texts.

Defined cases: a NULL or empty source or language is the category ``''``;
a text without a vocabulary term (NULL and empty ones too) has topic -1;
a document without tokens takes part with its cell's probability; rows
that share an id share their draw, rows without id draw by their text;
an empty table gives an empty result; ``mixed_documents`` keeps every
column of its input, whatever the names.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import compacted, in_parts, stored

TOPICS = 8
VOCABULARY = 128  # terms of a language
HELD_TERMS = 1 << 19  # counts that a task gathers before it lets them go
MARGINS = ("source", "lang", "topic")
MEASURES = tuple(f"{kind}_{m}" for m in MARGINS for kind in ("target", "reached"))
#: Target share of a category: proportional to its tokens to this power.
TEMPERATURE = {"source": 0.7, "lang": 0.7, "topic": 0.7}
BUDGET = 0.8  # expected share of the tokens that is sampled
ROUNDS = 200
TOLERANCE = 1e-5  # of the budget: what a margin may miss when raking ends
FEW_CELLS = 1 << 16  # raked in one piece: a few MB
SEED = 7

# letters and bytes beyond ASCII stay, A-Z are lower-cased, the rest parts words
_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_WORDS).split()


class TopicModel:
    """For each language its terms' topics and weights, idf by the topic's mean."""

    def __init__(self, terms: dict[str, dict[str, tuple[int, float]]]):
        self.terms = {lang: {t.encode(): held for t, held in found.items()} for lang, found in terms.items()}

    def topic(self, text: str, lang: str) -> int:
        """The topic of most weight, the smaller number of equal ones; -1 without a term."""
        known = self.terms.get(lang, {})
        counts = Counter(w for w in words_of(text) if w in known)
        weights: dict[int, float] = {}
        for word, n in sorted(counts.items()):
            topic, weight = known[word]
            weights[topic] = weights.get(topic, 0.0) + n ** 0.5 * weight
        return min(weights, key=lambda t: (-round(weights[t], 9), t)) if weights else -1


def _language(lang: Column) -> Column:
    return F.coalesce(lang.cast("string"), F.lit(""))


def vocabularies(src: DataFrame, size: int = VOCABULARY) -> dict[str, list[tuple[str, float]]]:
    """By language, its ``size`` terms of most weight with their idf; all of ``src(lang, text)`` is counted."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter] = {}

        def rows() -> pa.RecordBatch:
            found = [(lang, term.decode("utf-8", "replace"), n) for lang, terms in held.items() for term, n in terms.items()]
            return pa.RecordBatch.from_arrays(
                [pa.array(c, type=t) for c, t in zip(zip(*found, strict=True) if found else ((), (), ()),
                                                     (pa.string(), pa.string(), pa.int64()), strict=True)], names=["lang", "term", "n"])

        for batch in in_parts(batches):
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                held.setdefault(lang, Counter()).update(set(words_of(text.as_py() or "")))
            if sum(map(len, held.values())) > HELD_TERMS:
                yield rows()
                held = {}
        yield rows()

    sizes = src.groupBy("lang").agg(F.count(F.lit(1)).alias("docs"))
    df = src.mapInArrow(count, "lang string, term string, n long").groupBy("lang", "term").agg(F.sum("n").alias("df"))
    idf = F.log(F.col("docs") / F.col("df"))
    order = Window.partitionBy("lang").orderBy(F.desc("weight"), "term")
    best = df.join(F.broadcast(sizes), "lang").withColumn("idf", idf).withColumn("weight", F.round(F.col("df") * F.col("idf"), 9)) \
        .where(F.col("weight") > 0).withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= size)
    found: dict[str, list[tuple[str, float]]] = {}
    for r in best.select("lang", "nth", "term", "idf").orderBy("lang", "nth").collect():  # ``size`` rows a language
        found.setdefault(r["lang"], []).append((r["term"], r["idf"]))
    return found


def cooccurrences(src: DataFrame, terms: dict[str, list[str]]) -> dict[str, np.ndarray]:
    """By language, how many documents hold both of two terms; all of ``src(lang, text)`` is counted."""
    names = sorted(terms)
    at = {lang: {t.encode(): i for i, t in enumerate(terms[lang])} for lang in names}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {lang: np.zeros((len(at[lang]), len(at[lang]))) for lang in names}
        for batch in in_parts(batches):
            shown: dict[str, list[list[int]]] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                known = at.get(lang)
                if known:
                    shown.setdefault(lang, []).append([known[w] for w in set(words_of(text.as_py() or "")) if w in known])
            for lang, rows in shown.items():
                x = np.zeros((len(rows), len(at[lang])), dtype=np.float32)
                x[np.repeat(np.arange(len(rows)), [len(r) for r in rows]), [i for r in rows for i in r]] = 1
                held[lang] += x.T @ x
        for number, lang in enumerate(names):
            i, j = np.nonzero(np.triu(held[lang]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(i), number, dtype=np.int32)), pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)),
                 pa.array(held[lang][i, j].astype(np.int64))], names=["lang", "i", "j", "n"])

    table = src.mapInArrow(count, "lang int, i int, j int, n long").groupBy("lang", "i", "j").agg(F.sum("n").alias("n")).toArrow()
    lang, i, j, n = (table[c].to_numpy() for c in ("lang", "i", "j", "n"))  # bounded by the vocabularies' squares
    found = {}
    for number, name in enumerate(names):
        own = lang == number
        both = np.zeros((len(at[name]), len(at[name])))
        both[i[own], j[own]] = n[own]
        found[name] = np.maximum(both, both.T)
    return found


def fit_topics(docs: DataFrame, topics: int = TOPICS, vocabulary: int = VOCABULARY, text_col: str = "text") -> TopicModel:
    """Two passes over all documents: terms, then what occurs together."""
    src = docs.select(_language(F.col("lang")).alias("lang"), F.col(text_col).cast("string").alias("text"))
    chosen = vocabularies(src, vocabulary)
    sizes = {r["lang"]: r["n"] for r in src.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    model: dict[str, dict[str, tuple[int, float]]] = {}
    both = cooccurrences(src, {lang: [t for t, _ in terms] for lang, terms in chosen.items()})
    for lang, terms in chosen.items():
        share = both[lang] / sizes[lang]
        p = np.diag(share)
        spread = np.sqrt(np.outer(p * (1 - p), p * (1 - p)))
        x = np.divide(share - np.outer(p, p), spread, out=np.zeros_like(share), where=spread > 0)
        axis = np.linalg.eigh(x)[1][:, -1]
        axis = np.round(axis * np.sign(axis[np.argmax(np.abs(np.round(axis, 9)))]), 9)
        order = np.argsort(axis, kind="stable")
        weight = p * [idf for _, idf in terms]
        before = np.cumsum(weight[order]) - weight[order]
        own = np.empty(len(terms), dtype=int)
        own[order] = np.minimum(topics - 1, np.floor(before / weight.sum() * topics)).astype(int)
        mean = np.bincount(own, weight, minlength=topics)
        model[lang] = {t: (int(o), idf / mean[o]) for (t, idf), o in zip(terms, own, strict=True)}
    return TopicModel(model)


def _categories(model: TopicModel, text: Column, source: Column, lang: Column) -> list[Column]:
    @F.arrow_udf("struct<topic: int, tokens: bigint>")
    def read(texts: pa.Array, langs: pa.Array) -> pa.Array:
        found = [(model.topic(t, lang), len(t.encode("utf-8", "surrogatepass").split()))
                 for t, lang in zip((x.as_py() or "" for x in texts), langs.to_pylist(), strict=True)]
        topics, tokens = zip(*found, strict=True) if found else ((), ())
        return pa.StructArray.from_arrays([pa.array(topics, pa.int32()), pa.array(tokens, pa.int64())],
                                          names=["topic", "tokens"])

    return [F.coalesce(source.cast("string"), F.lit("")), _language(lang), read(text, _language(lang))]


def rake(cells: DataFrame, targets: dict[str, DataFrame], rounds: int = ROUNDS,
         tolerance: float = TOLERANCE) -> DataFrame:
    """``cells(*MARGINS, tokens)`` plus ``weight``: weighted tokens meet every target share.

    ``targets[m]`` is ``(m, share)``; shares of a margin sum to 1.
    """
    total = float(cells.agg(F.sum("tokens")).first()[0] or 0)
    wanted = {m: t.select(m, (F.col("share") * total).alias("wanted")) for m, t in targets.items()}
    return _raked(cells.withColumn("weight", F.lit(1.0)), wanted, total, float("inf"), rounds, tolerance)


def _raked(now: DataFrame, wanted: dict[str, DataFrame], total: float, cap: float, rounds: int = ROUNDS,
           tolerance: float = TOLERANCE) -> DataFrame:
    """``now(..., tokens, weight)`` with weights up to ``cap`` that meet ``wanted[m] = (m, wanted)`` tokens.

    A round rakes each margin once; it ends when none missed its tokens by
    more than ``tolerance`` of ``total``.  Weights at the cap stay there while their margin wants more.
    """
    columns, rows = now.columns, now.count()
    for _ in range(rounds):
        off = F.lit(0.0)
        for i, m in enumerate(wanted):
            full = F.col("weight") >= cap
            have = now.groupBy(m).agg(F.sum(F.col("tokens") * F.col("weight")).alias("__have"),
                                      F.sum(F.when(full, F.col("tokens") * F.col("weight")).otherwise(0.0)).alias("__full"))
            more = F.col("wanted") > F.col("__full")
            free = F.col("__have") - F.col("__full")
            factor = F.when(more & (free > 0), (F.col("wanted") - F.col("__full")) / free) \
                .when(~more & (F.col("__have") > 0), F.col("wanted") / F.col("__have")).otherwise(1.0)
            steps = have.join(wanted[m], m).select(m, more.alias("__more"), factor.alias("__factor"),
                                                   F.abs(F.col("__have") - F.col("wanted")).alias(f"__off{i}"))
            now = now.join(steps, m).withColumn("weight", F.when(full & F.col("__more"), F.col("weight")).otherwise(
                F.least(F.lit(cap), F.col("weight") * F.col("__factor")))).drop("__more", "__factor")
            off = F.greatest(off, F.col(f"__off{i}"))
        now = stored(now.select(*columns, off.alias("__off")), "mixing-round", rows)
        worst = now.agg(F.max("__off")).first()[0]
        now = now.drop("__off")
        if worst is None or worst <= tolerance * total:
            break
    return now


def calibrate(weighted: DataFrame, budget: float = BUDGET) -> DataFrame:
    """Adds ``probability = min(1, c * weight)`` with ``sum(tokens * probability) = budget * tokens``.

    The rows at 1 are found by repeating: what they leave of the budget is
    shared by the others in proportion to their weights.
    """
    total = weighted.agg(F.sum("tokens").cast("double")).first()[0] or 0.0
    c = 0.0
    while True:
        full = F.col("weight") * F.lit(c) >= 1.0
        row = weighted.agg(F.sum(F.when(full, F.col("tokens")).otherwise(0)).cast("double"),
                           F.sum(F.when(full, 0.0).otherwise(F.col("tokens") * F.col("weight")))).first()
        at_one, shared = row[0] or 0.0, row[1] or 0.0
        after = (budget * total - at_one) / shared if shared > 0 else c
        if after <= c * (1 + 1e-9):
            break
        c = after
    return weighted.withColumn("probability", F.round(F.least(F.lit(1.0), F.col("weight") * F.lit(c)), 12))


def margin_targets(cells: DataFrame, temperature: dict[str, float], budget: float) -> dict[str, DataFrame]:
    """``{margin: (margin, wanted)}``: tokens of the budget, in proportion to tokens to a power and no more than there are."""
    targets, rows = {}, cells.count()
    for m, power in temperature.items():
        sums = cells.groupBy(m).agg(F.sum("tokens").alias("tokens")) \
            .withColumn("weight", F.when(F.col("tokens") > 0, F.pow(F.col("tokens").cast("double"), F.lit(power - 1))).otherwise(0.0))
        filled = calibrate(sums, budget)
        targets[m] = stored(filled.select(m, (F.col("tokens") * F.col("probability")).alias("wanted")), "mixing-target", rows)
    return targets


def _filled(tokens: np.ndarray, weight: np.ndarray, budget: float) -> np.ndarray:
    """``calibrate`` of arrays: the probabilities."""
    c, total = 0.0, tokens.sum()
    while True:
        full = weight * c >= 1.0
        shared = (tokens * weight)[~full].sum()
        after = (budget * total - tokens[full].sum()) / shared if shared > 0 else c
        if after <= c * (1 + 1e-9):
            return np.round(np.minimum(1.0, weight * c), 12)
        c = after


def odds_of_rows(cells: pa.Table, temperature: dict[str, float], budget: float, rounds: int = ROUNDS,
                 tolerance: float = TOLERANCE) -> pa.Table:
    """``margin_targets``, ``_raked`` and ``calibrate`` over a table of few cells, by the same steps."""
    if not cells.num_rows:
        for name in ("weight", "probability", *MEASURES):
            cells = cells.append_column(name, pa.array([], pa.float64()))
        return cells
    tokens = cells["tokens"].to_numpy().astype(np.float64)
    codes = [np.unique(cells[m].to_numpy(), return_inverse=True)[1] for m in temperature]
    whole = budget * tokens.sum()
    wanted = []
    for code, power in zip(codes, temperature.values(), strict=True):
        held = np.bincount(code, tokens)
        wanted.append(held * _filled(held, np.power(held, power - 1, where=held > 0, out=np.zeros_like(held)), budget))
    p = np.full(len(tokens), budget)
    for _ in range(rounds):
        worst = 0.0
        for code, want in zip(codes, wanted, strict=True):
            full = p >= 1.0
            have, at_one = np.bincount(code, tokens * p), np.bincount(code, tokens * full)
            worst = max(worst, np.abs(have - want).max(initial=0))
            more, free = want > at_one, have - at_one
            factor = np.ones_like(want)
            np.divide(want - at_one, free, out=factor, where=more & (free > 0))
            np.divide(want, have, out=factor, where=~more & (have > 0))
            p = np.where(full & more[code], p, np.minimum(1.0, p * factor[code]))
        if worst <= tolerance * whole:
            break
    p = _filled(tokens, p, budget)
    out = cells.append_column("weight", pa.array(p / budget if budget else p)).append_column("probability", pa.array(p))
    sampled = (tokens * p).sum() or 1.0
    for m, code, want in zip(temperature, codes, wanted, strict=True):
        out = out.append_column(f"target_{m}", pa.array((want / (want.sum() or 1.0))[code])) \
            .append_column(f"reached_{m}", pa.array((np.bincount(code, tokens * p) / sampled)[code]))
    return out


def odds(cells: DataFrame, temperature: dict[str, float], budget: float, few: int = FEW_CELLS) -> DataFrame:
    """``cells`` plus ``weight``, ``probability`` and, for each margin, ``target_<m>`` and ``reached_<m>``.

    At most ``few`` cells are raked in one piece and their odds broadcast;
    more are raked as Spark tables, in the same steps.
    """
    n = cells.count()
    if n <= few:
        table = odds_of_rows(cells.orderBy(*MARGINS).toArrow(), temperature, budget)
        return F.broadcast(cells.sparkSession.createDataFrame(table))
    wanted = margin_targets(cells, temperature, budget)
    whole = float(budget * (cells.agg(F.sum("tokens")).first()[0] or 0))
    raked = _raked(cells.withColumn("weight", F.lit(float(budget))), wanted, whole, 1.0)
    found = stored(calibrate(raked, budget).withColumn("weight", F.col("probability") / (budget or 1.0)), "mixing-odds", n)
    sampled = found.agg(F.sum(F.col("tokens") * F.col("probability"))).first()[0] or 1.0
    for m, want in wanted.items():
        sums = found.groupBy(m).agg((F.sum(F.col("tokens") * F.col("probability")) / sampled).alias(f"reached_{m}"))
        both = want.select(m, (F.col("wanted") / (whole or 1.0)).alias(f"target_{m}")).join(sums, m)
        found = found.join(both, m)
    return stored(found.select(*cells.columns, "weight", "probability", *[f"{k}_{m}" for m in wanted for k in ("target", "reached")]),
                  "mixing-odds", n)


def _draw(doc_id: Column, text: Column, seed: int) -> Column:
    """Uniform in [0, 1), by the id, or by the text where there is none."""
    key = F.coalesce(doc_id.cast("long"), F.xxhash64(text))
    return F.pmod(F.xxhash64(F.lit(seed), key), F.lit(1 << 53)) / float(1 << 53)


def _with_probability(docs: DataFrame, temperature: dict[str, float], budget: float, seed: int,
                      id_col: str, text_col: str, with_text: bool = True) -> DataFrame:
    """``docs`` plus ``__source, __lang, __topic, __tokens, __probability, __sampled``.

    ``with_text`` keeps the text: it is read for the cells and again for the
    draw, never written.  Without it the narrow rows are stored once between.
    """
    model = fit_topics(docs, text_col=text_col)
    source, lang, read = _categories(model, F.col(text_col), F.col("source"), F.col("lang"))
    held = docs.select("*", source.alias("__source"), lang.alias("__lang"), read.alias("__read"),
                       _draw(F.col(id_col), F.col(text_col), seed).alias("__draw")) \
        .select(*[F.col(f"`{c}`") for c in docs.columns], "__source", "__lang", "__draw",
                F.col("__read.topic").alias("__topic"), F.col("__read.tokens").alias("__tokens"))
    if not with_text:
        held = stored(held.drop(text_col), "mixing-rows")
    cells = compacted(held.groupBy(F.col("__source").alias("source"), F.col("__lang").alias("lang"),
                                   F.col("__topic").alias("topic")).agg(F.sum("__tokens").alias("tokens")), "mixing-cells")
    drawn = odds(cells, temperature, budget).select(*[F.col(m).alias(f"__{m}") for m in MARGINS],
                                                    *[F.col(c).alias(f"__{c}") for c in (*MEASURES, "weight", "probability")])
    return held.join(drawn, [f"__{m}" for m in MARGINS]).withColumn("__sampled", F.col("__draw") < F.col("__probability"))


def mixture(docs: DataFrame, temperature: dict[str, float] = TEMPERATURE, budget: float = BUDGET, seed: int = SEED,
            id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, source, lang, topic, tokens, weight, probability, sampled, target_<margin>, reached_<margin>)`` of every document."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"),
                       "source", "lang")
    return _with_probability(docs, temperature, budget, seed, "doc_id", "text", with_text=False).select(
        "doc_id", *[F.col(f"__{c}").alias(c) for c in (*MARGINS, "tokens", "weight", "probability", "sampled", *MEASURES)])


def mixed_documents(docs: DataFrame, temperature: dict[str, float] = TEMPERATURE, budget: float = BUDGET,
                    seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The sampled documents, with the columns of ``docs``."""
    drawn = _with_probability(docs, temperature, budget, seed, id_col, text_col)
    return drawn.where("__sampled").select(*[F.col(f"`{c}`") for c in docs.columns])
