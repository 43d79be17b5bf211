"""Answer spans from per-token model scores.

Each passage is one row holding its token sequence and its start / end
logit arrays, as a span model emits them.  Valid spans (after the first
separator, before the last, at most ``max_answer_len`` tokens) are
scored per passage - ``max_answer_len`` ends per start instead of all
``L x L`` pairs - and cut to the passage's best ``n_best`` spans there.
That cut is exact: a question's n-best are among the union of its
passages' n-best.  Only then are spans exploded and ranked per question
(``row_number`` with a partial ``WindowGroupLimit`` before the shuffle).
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.constants import CLS, EMITTED_SPANS, EMPTY_PASSAGE, MAX_ANSWER_TOKENS, N_BEST, SEP
from ..functions.text import tokenize, words
from ..session import checkpoint_dir
from .joins import attach_text

AGGREGATIONS = ("sum", "none")
LOGIT_DIGITS = 6


def reader_pairs(retrieved: DataFrame, questions: DataFrame, docs: DataFrame) -> DataFrame:
    """E1 + E2: ``(query_id, passage_idx, doc_key, question, text)``.

    Duplicate ids are dropped (first rank kept) and passages are numbered
    by retrieval rank.  A question without documents gets one passage
    whose id and text are ``'pass'``; a retrieved id without document raises.
    """
    firsts = retrieved.groupBy("query_id", "doc_id").agg(F.min("rank").alias("rank"))
    w = Window.partitionBy("query_id").orderBy("rank", "doc_id")
    numbered = firsts.select("query_id", "doc_id",
                             (F.row_number().over(w) - 1).cast("long").alias("passage_idx"))
    found = attach_text(numbered, docs).join(questions.select("query_id", "question"), "query_id")
    found = found.select("query_id", "passage_idx", F.col("doc_id").cast("string").alias("doc_key"),
                         "question", "text")
    empty = questions.join(numbered.select("query_id").distinct(), "query_id", "left_anti").select(
        "query_id", F.lit(0).cast("long").alias("passage_idx"), F.lit(EMPTY_PASSAGE).alias("doc_key"),
        "question", F.lit(EMPTY_PASSAGE).alias("text"))
    return found.unionByName(empty)


def pair_encoding(pairs: DataFrame, max_length: int | None = None) -> DataFrame:
    """``[CLS] question [SEP] passage [SEP]`` as uncased word tokens.

    The pairs are dealt out by (query_id, passage_idx) first: encoding is
    bound by CPU, and the join before it leaves as few tasks as its bytes need.

    Adds ``seq``, ``sep1`` (index of the first separator) and ``sep2`` (the
    last).  ``max_length`` truncates only the passage, as a model window
    would; the default keeps whole passages.
    """
    tasks = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = pairs.repartition(tasks, "query_id", "passage_idx")
    q = spread.select("*", words(tokenize("question"), uncased=True).alias("_q"),
                     words(tokenize("text"), uncased=True).alias("_p"))
    passage = F.col("_p")
    if max_length is not None:
        passage = F.slice(passage, 1, F.greatest(F.lit(max_length) - F.size("_q") - 3, F.lit(0)))
    enc = q.select(*pairs.columns, F.concat(F.array(F.lit(CLS)), F.col("_q"), F.array(F.lit(SEP)),
                                            passage, F.array(F.lit(SEP))).alias("seq"),
                   (F.size("_q") + 1).alias("sep1"))
    return enc.withColumn("sep2", F.size("seq") - 1)


def score_passages(enc: DataFrame, token_logits: Callable[[Column, Column], Column],
                   end_logits: Callable[[Column, Column], Column],
                   relevance: Callable[[Column], Column], doc_col: str = "doc_num") -> DataFrame:
    """Attach ``start_logits``, ``end_logits`` (arrays over ``seq``) and ``rel``.

    The scorer is given as Column functions of (document number, token
    position); ``score_passages_with`` takes a model over the tokens.
    """
    doc = F.col(doc_col)
    n = F.size("seq")
    positions = F.sequence(F.lit(0), n - 1)
    return enc.select("*",
                      F.transform(positions, lambda t: token_logits(doc, t)).alias("start_logits"),
                      F.transform(positions, lambda t: end_logits(doc, t)).alias("end_logits"),
                      relevance(doc).alias("rel"))


def score_passages_with(enc: DataFrame, scorer: Callable[[], Callable[[list[list[str]]], list[tuple]]],
                        batch_size: int = 32) -> DataFrame:
    """E4 with a batch model: adds ``start_logits``, ``end_logits`` and ``rel``.

    ``scorer()`` runs once in every task and gives the model: a function of
    up to ``batch_size`` token sequences that returns, for each, its start
    logits, its end logits (as long as the sequence) and its relevance.
    """
    names, columns = enc.columns, [F.col(f"`{c}`") for c in enc.columns]
    out = T.StructType([*enc.schema.fields, T.StructField("start_logits", T.ArrayType(T.DoubleType())),
                        T.StructField("end_logits", T.ArrayType(T.DoubleType())), T.StructField("rel", T.DoubleType())])

    def run(batches):
        model = scorer()
        for b in batches:
            for at in range(0, b.num_rows, batch_size):
                part = b.slice(at, batch_size)
                seqs = part.column(names.index("seq")).to_pylist()
                scores = model(seqs)
                for s, (start, end, _) in zip(seqs, scores, strict=True):
                    if not len(s) == len(start) == len(end):
                        raise ValueError("a logit for every token is needed")
                new = [pa.array([list(map(float, s[i])) for s in scores], pa.list_(pa.float64())) for i in (0, 1)]
                new.append(pa.array([float(s[2]) for s in scores], pa.float64()))
                yield pa.RecordBatch.from_arrays([*part.columns, *new], names=[*names, "start_logits", "end_logits", "rel"])

    return enc.select(*columns).mapInArrow(run, out)


def materialize_passages(scored: DataFrame) -> DataFrame:
    """Reliable checkpoint of the scored passages (shared checkpoint folder).

    The span lambdas index the token and logit arrays once per span; after
    the checkpoint those are stored columns, so the optimizer cannot fold
    the tokenising expressions into the lambdas, and retrieval upstream is
    not re-run by the later stages.  Size: questions x retrieved passages.
    """
    checkpoint_dir(scored.sparkSession)
    return scored.checkpoint(eager=True)


def _passage_topn(max_answer_len: int, n_best: int):
    """Per Arrow batch: each passage's valid spans scored with numpy; the
    spans within 2e-6 of its ``n_best``-th raw logit are kept (exact once
    Spark rounds to 6 digits and ranks, as rounding is monotone)."""
    schema = pa.schema([("query_id", pa.int64()), ("passage_idx", pa.int64()), ("doc_key", pa.string()),
                        ("start_idx", pa.int64()), ("end_idx", pa.int64()), ("raw_logit", pa.float64()),
                        ("span", pa.string())])

    def run(batches):
        for b in batches:
            out = {k: [] for k in schema.names}
            qid, pidx, dkey = (b.column(c).to_pylist() for c in ("query_id", "passage_idx", "doc_key"))
            sep1 = b.column("sep1").to_numpy(zero_copy_only=False)
            sep2 = b.column("sep2").to_numpy(zero_copy_only=False)
            rel = b.column("rel").to_numpy(zero_copy_only=False)
            seq, sl, el = b.column("seq"), b.column("start_logits"), b.column("end_logits")
            q_off = seq.offsets.to_numpy()
            spans_at = []
            s_off, s_val = sl.offsets.to_numpy(), sl.values.to_numpy(zero_copy_only=False)
            e_off, e_val = el.offsets.to_numpy(), el.values.to_numpy(zero_copy_only=False)
            for r in range(b.num_rows):
                lo, hi = int(sep1[r]) + 1, int(sep2[r]) - 1
                if hi < lo:
                    continue
                st = s_val[s_off[r]:s_off[r + 1]]
                en = e_val[e_off[r]:e_off[r + 1]]
                starts = np.arange(lo, hi + 1)
                grid = np.full((len(starts), max_answer_len), -np.inf)
                for o in range(max_answer_len):
                    ok = starts + o <= hi
                    grid[ok, o] = st[starts[ok]] + en[starts[ok] + o] + rel[r]
                flat = grid.ravel()
                finite = np.isfinite(flat)
                if len(flat) > n_best:
                    cut = np.partition(flat, len(flat) - n_best)[len(flat) - n_best]
                    keep = np.nonzero(finite & (flat >= cut - 2e-6))[0]
                else:
                    keep = np.nonzero(finite)[0]
                for k in keep.tolist():
                    i, j = lo + k // max_answer_len, lo + k // max_answer_len + k % max_answer_len
                    out["query_id"].append(qid[r])
                    out["passage_idx"].append(pidx[r])
                    out["doc_key"].append(dkey[r])
                    out["start_idx"].append(i)
                    out["end_idx"].append(j)
                    out["raw_logit"].append(float(flat[k]))
                    spans_at.append((int(q_off[r]) + i, j - i + 1))
            # only the tokens of kept spans leave Arrow
            idx = [a + t for a, n in spans_at for t in range(n)]
            words_ = pc.take(seq.values, pa.array(idx, type=pa.int64())).to_pylist() if idx else []
            pos = 0
            for _, n in spans_at:
                out["span"].append(" ".join(words_[pos:pos + n]))
                pos += n
            yield pa.RecordBatch.from_pydict(out, schema=schema)
    return run


def passage_spans(scored: DataFrame, max_answer_len: int = MAX_ANSWER_TOKENS,
                  n_best: int = N_BEST) -> DataFrame:
    """E5 + E6 + E8: each passage's best valid spans, one row per span.

    Output ``(query_id, passage_idx, doc_key, start_idx, end_idx, logit, raw_logit,
    span)``, ``logit`` being rounded to 6 digits (ranking and ties use it).  Span
    scoring is tensor arithmetic on the model output, so it runs as one
    vectorised numpy step per passage inside the task (``mapInArrow``);
    the per-question ranking after it is Spark's.
    """
    cols = ["query_id", "passage_idx", "doc_key", "seq", "sep1", "sep2",
            "start_logits", "end_logits", "rel"]
    src = scored.select(*[F.col(c).cast("long") if c in ("query_id", "passage_idx", "sep1", "sep2")
                          else F.col(c).cast("double") if c == "rel" else F.col(c) for c in cols])
    src = src.withColumn("start_logits", F.col("start_logits").cast("array<double>")) \
        .withColumn("end_logits", F.col("end_logits").cast("array<double>"))
    spans = src.mapInArrow(_passage_topn(max_answer_len, n_best),
                           "query_id long, passage_idx long, doc_key string, start_idx long, end_idx long, "
                           "raw_logit double, span string")
    return spans.select("query_id", "passage_idx", "doc_key", "start_idx", "end_idx",
                        F.round("raw_logit", LOGIT_DIGITS).alias("logit"), "raw_logit", "span")


def nbest(spans: DataFrame, n_best: int = N_BEST) -> DataFrame:
    """First ``n_best`` spans per question by rounded logit; ``prob = exp(raw logit)``."""
    w = Window.partitionBy("query_id").orderBy(F.col("logit").desc(), "passage_idx", "start_idx", "end_idx")
    ranked = spans.withColumn("nbest_rank", F.row_number().over(w).cast("long")) \
        .where(F.col("nbest_rank") <= n_best)
    prob = F.exp("raw_logit")
    return ranked.select("*", F.when(F.isnan(prob) | (prob == float("inf")),
                                     F.raise_error(F.lit("span logit overflows exp()")))
                         .otherwise(prob).alias("prob"))


def require_spans(best: DataFrame, questions: DataFrame) -> DataFrame:
    """``best`` unchanged; a question whose n-best is empty raises."""
    any_span = best.select("query_id").distinct().withColumn("_any", F.lit(True))
    missing = F.raise_error(F.concat(F.lit("no valid span for question "), F.col("query_id").cast("string")))
    checked = questions.select("query_id").join(any_span, "query_id", "left") \
        .select(F.when(F.col("_any"), F.col("query_id")).otherwise(missing.cast("long")).alias("query_id"))
    return best.join(checked, "query_id", "left_semi")


def aggregate_spans(best: DataFrame, aggregation: str = "sum", top: int = EMITTED_SPANS) -> DataFrame:
    """``(query_id, rank, span, score, docs, start_idx, end_idx)``.

    ``sum`` adds the probabilities of equal span texts and keeps their
    occurrences in n-best order; equal sums keep first-seen order.
    ``none`` keeps every n-best span.  Only the first ``top`` are emitted.
    """
    if aggregation not in AGGREGATIONS:
        raise ValueError(f"unknown aggregation: {aggregation}")
    occ = F.struct("nbest_rank", "doc_key", "start_idx", "end_idx")
    if aggregation == "sum":
        grouped = best.groupBy("query_id", "span").agg(
            F.sum("prob").alias("score"), F.min("nbest_rank").alias("first"),
            F.array_sort(F.collect_list(occ)).alias("occ"))
    else:
        grouped = best.select("query_id", "span", F.col("prob").alias("score"),
                              F.col("nbest_rank").alias("first"), F.array(occ).alias("occ"))
    w = Window.partitionBy("query_id").orderBy(F.round("score", LOGIT_DIGITS).desc(), "first")
    ranked = grouped.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= top)
    return ranked.select("query_id", "rank", "span", F.round("score", LOGIT_DIGITS).alias("score"),
                         F.transform("occ", lambda o: o["doc_key"]).alias("docs"),
                         F.transform("occ", lambda o: o["start_idx"]).alias("start_idx"),
                         F.transform("occ", lambda o: o["end_idx"]).alias("end_idx"))


def read(retrieved: DataFrame, questions: DataFrame, docs: DataFrame,
         token_logits, end_logits, relevance, max_answer_len: int = MAX_ANSWER_TOKENS,
         n_best: int = N_BEST, aggregation: str = "sum", top: int = EMITTED_SPANS,
         max_length: int | None = None) -> DataFrame:
    """E1-E11 end to end."""
    enc = pair_encoding(reader_pairs(retrieved, questions, docs), max_length)
    enc = enc.withColumn("doc_num", F.coalesce(F.col("doc_key").try_cast("long"), F.lit(0)))
    scored = materialize_passages(score_passages(enc, token_logits, end_logits, relevance))
    best = nbest(passage_spans(scored, max_answer_len, n_best), n_best)
    return aggregate_spans(require_spans(best, questions), aggregation, top)
