"""Retrieval, reading, linking and evaluation on small fixtures and sf0.001."""

import inspect
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lanternqa.functions import arrow
from lanternqa.operators import evaluate as ev
from lanternqa.operators import index as ix
from lanternqa.operators import joins
from lanternqa.operators import link as lk
from lanternqa.operators import read as rd
from lanternqa.operators import retrieve as rt
from lanternqa.plans import catalog
from lanternqa.sources import index_store

from .conftest import SF001


def docs_df(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_bm25_weight_literal(spark):
    """tf 2 in a document of average length: idf * 2 * 2.2 / 3.2."""
    index = ix.build_index(docs_df(spark, ["alpha alpha beta", "gamma delta epsilon", "zeta eta theta"]), unicode_form=None)
    w = {(r.term, r.doc_id): r.weight for r in ix.bm25_weights(index).collect()}
    assert math.isclose(w["alpha", 0], math.log(2.5 / 1.5) * 1.375)


def test_idf_clip(spark):
    df = spark.createDataFrame([(5,), (6,)], "df long")
    got = [r[0] for r in df.select(ix.idf_column(F.col("df"), F.lit(10))).collect()]
    assert got == [0.0, 0.0]


def test_topk_fewer_than_k_and_ties(spark):
    scores = spark.createDataFrame([(1, 7, 1.0), (1, 3, 1.0), (2, 5, 0.5)], "query_id long, doc_id long, score double")
    got = [tuple(r) for r in rt.top_k(scores, 5).orderBy("query_id", "rank").collect()]
    assert got == [(1, 1, 3, 1.0), (1, 2, 7, 1.0), (2, 1, 5, 0.5)]


def test_retrieve_finds_source(spark):
    docs = docs_df(spark, ["red apples grow", "blue sky above", "apples and pears"])
    index = ix.build_index(docs, unicode_form=None)
    qs = spark.createDataFrame([(0, "red apples"), (1, "the of")], "query_id long, question string")
    out = [tuple(r) for r in rt.retrieve(index, qs, k=2).orderBy("query_id", "rank").collect()]
    assert [r[2] for r in out if r[0] == 0][0] == 0
    assert all(r[0] == 0 for r in out)            # lenient: empty question gives no rows
    assert [r[0] for r in rt.empty_queries(qs, rt.question_terms(qs, index)).collect()] == [1]


def test_strict_empty_query_raises(spark):
    docs = docs_df(spark, ["red apples grow"])
    index = ix.build_index(docs, unicode_form=None)
    qs = spark.createDataFrame([(1, "the of")], "query_id long, question string")
    try:
        rt.retrieve(index, qs, strict=True)
    except RuntimeError:
        return
    raise AssertionError("strict mode must raise")


def test_topk_prefix_property(spark):
    a = catalog.bm25_topk(spark, SF001)
    b = catalog.batch_topk(spark, SF001)
    sa = {tuple(r) for r in a.collect()}
    sb = {tuple(r) for r in b.where("rank <= 5").collect()}
    assert sa == sb and len(sa) > 0


def test_hashed_index_with_huge_buckets_equals_exact(spark, tmp_path):
    docs = docs_df(spark, ["alpha beta beta", "beta gamma", "delta", "1 2 3 17 beta"])
    index = ix.build_index(docs, unicode_form=None)
    exact = sorted((r.doc_id, ix_bucket(r.term), r.tf) for r in index.postings.collect())
    hashed = ix.hashed_index(index, 1 << 32)
    assert sorted((r.doc_id, int(r.term), r.tf) for r in hashed.postings.collect()) == exact
    questions = spark.createDataFrame([(1, "beta delta?"), (2, "nothing 17")], "query_id long, question string")
    stored = index_store.save_index(hashed, f"{tmp_path}/hashed")
    assert stored.hash_size == 1 << 32
    want = sorted(tuple(r) for r in rt.retrieve(index, questions, 3).collect())
    assert sorted(tuple(r) for r in rt.retrieve(stored, questions, 3).collect()) == want and want


def ix_bucket(term):
    raw = np.frombuffer(term.encode(), dtype=np.uint8)
    return int(arrow.murmur3_32(raw.reshape(1, len(raw)))[0])


def test_span_sum_literal(spark):
    best = spark.createDataFrame(
        [(0, "p", 1.0, 1, "7", 3, 3), (0, "q", 1.5, 2, "7", 4, 4), (0, "p", 1.0, 3, "8", 5, 5)],
        "query_id long, span string, prob double, nbest_rank long, doc_key string, start_idx long, end_idx long")
    got = [(r.span, r.score, r.docs) for r in rd.aggregate_spans(best, "sum").orderBy("rank").collect()]
    assert got == [("p", 2.0, ["7", "8"]), ("q", 1.5, ["7"])]


def test_span_rules(spark):
    # question "q" -> seq = [CLS] q [SEP] a b c [SEP]; sep1 = 2, sep2 = 6
    scored = spark.createDataFrame(
        [(0, 0, "1", ["[CLS]", "q", "[SEP]", "a", "b", "c", "[SEP]"], 2, 6,
          [9.0, 9.0, 9.0, 1.0, 0.0, 0.0, 9.0], [9.0, 9.0, 9.0, 0.0, 0.0, 2.0, 9.0], 0.0)],
        "query_id long, passage_idx long, doc_key string, seq array<string>, sep1 int, sep2 int, "
        "start_logits array<double>, end_logits array<double>, rel double")
    spans = {(r.start_idx, r.end_idx): r.logit for r in rd.passage_spans(scored, 2, 60).collect()}
    assert set(spans) == {(3, 3), (3, 4), (4, 4), (4, 5), (5, 5)}   # max 2 tokens, inside the passage
    assert spans[(4, 5)] == 2.0


def test_no_documents_gives_placeholder(spark):
    retrieved = spark.createDataFrame([], "query_id long, rank long, doc_id long")
    qs = spark.createDataFrame([(1, "who")], "query_id long, question string")
    docs = docs_df(spark, ["x"])
    got = [tuple(r) for r in rd.reader_pairs(retrieved, qs, docs).select("doc_key", "text").collect()]
    assert got == [("pass", "pass")]


def test_fusion_and_dedupe(spark):
    cands = spark.createDataFrame([(0, 0, 1, 1), (0, 0, 2, 2), (0, 0, 3, 3), (0, 1, 1, 4)],
                                  "query_id long, mention_idx long, rank long, entity_id long")
    fused = lk.fuse_candidates(cands)
    assert [r.entity_id for r in fused.orderBy("fused_rank").collect()] == [1, 4, 2, 3]
    imap = spark.createDataFrame([("1", "A"), ("4", "A"), ("2", "B"), ("3", "C")], "key string, value string")
    out = [r.entity for r in lk.dedupe_entities(lk.map_entities(fused, imap)).orderBy("rank").collect()]
    assert out == ["A", "B", "C"]


def test_dense_topk_brute_force(spark):
    rng = np.random.default_rng(0)
    vecs = rng.normal(size=(40, 8)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vecs)], "vec_id long, embedding array<float>")
    got = lk.dense_topk(df.select(F.col("vec_id").alias("mention_id"), "embedding"), df, 3, exclude_self=True)
    got = {(r.mention_id, r.rank): r.entity_id for r in got.collect()}
    v64 = vecs.astype(np.float64)
    sims = v64 @ v64.T
    np.fill_diagonal(sims, -np.inf)
    for m in range(40):
        order = sorted(range(40), key=lambda e: (-round(sims[m, e], 6), e))[:3]
        assert [got[(m, r)] for r in (1, 2, 3)] == order


def test_mrr_and_hits(spark):
    preds = spark.createDataFrame([(0, 1, "a"), (0, 2, "b"), (0, 3, "x"), (1, 1, "c")],
                                  "query_id long, rank long, entity string")
    gold = spark.createDataFrame([(0, "x"), (1, "z")], "query_id long, entity string")
    assert ev.mean_reciprocal_rank(preds, gold, "entity").collect()[0].mrr == round(1 / 6, 6)
    assert ev.hits_at_k(preds, gold, 3, "entity").collect()[0].hits == 1


def test_remap_drops_blanks(spark):
    preds = spark.createDataFrame([(0, 1, ""), (0, 2, "x")], "query_id long, rank long, entity string")
    imap = spark.createDataFrame([("x", "X")], "key string, value string")
    assert [tuple(r) for r in ev.remap_predictions(preds, imap, "entity").collect()] == [(0, 1, "X")]
    assert ev.remap_predictions(preds, None, "entity").where("entity = 'x'").collect()[0].rank == 2


def test_empty_predictions_metric_is_null(spark):
    per_q = spark.createDataFrame([], "query_id long, hit long")
    assert ev.retrieval_accuracy(per_q).collect()[0].accuracy is None


def test_bad_regex_is_a_miss(spark):
    retrieved = spark.createDataFrame([(0, 1, 0)], "query_id long, rank long, doc_id long")
    docs = docs_df(spark, ["some (text"])
    answers = spark.createDataFrame([(0, ["("])], "query_id long, answer array<string>")
    assert ev.answer_hits(retrieved, docs, answers, 5, "regex").collect()[0].hit is False


def test_entry_smoke(spark):
    import __spark_entry__ as e
    df = e.entry(spark)
    assert df.columns == ["query_id", "rank", "doc_id", "score"]
    assert df.count() > 0


def final_plan(df):
    df.write.format("noop").mode("overwrite").save()
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def stored_index(spark, tmp_path, texts, **kw):
    return index_store.save_index(ix.build_index(docs_df(spark, texts), unicode_form=None, **kw), f"{tmp_path}/index")


def test_retrieval_plan_over_a_stored_index(spark, tmp_path):
    """One scan of the postings, no exchange by (query, document), top-k cut before its exchange."""
    index = stored_index(spark, tmp_path, [f"alpha beta{i} beta{i % 7} gamma{i % 3}" for i in range(200)])
    questions = spark.createDataFrame([(1, "beta3 gamma1"), (2, "beta5")], "query_id long, question string")
    plan = final_plan(rt.retrieve(index, questions, 3)).split("Initial Plan")[0]
    assert plan.count("FileScan parquet spark_catalog.default.postings_") == 1
    assert "WindowGroupLimit" in plan and "Python" not in plan and "Arrow" not in plan
    exchanges = [line for line in plan.splitlines() if " Exchange hashpartitioning" in line]
    assert len(exchanges) == 1 and "doc_id" not in exchanges[0]


def test_stored_index_reads_back(spark, tmp_path):
    texts = ["alpha alpha beta", "", "the of", "beta gamma"]
    index = stored_index(spark, tmp_path, texts)
    again = index_store.load_index(spark, f"{tmp_path}/index")
    fresh = ix.build_index(docs_df(spark, texts), unicode_form=None)
    for part in ("postings", "docs", "terms"):
        want = sorted(tuple(r) for r in getattr(fresh, part).collect())
        assert sorted(tuple(r) for r in getattr(index, part).collect()) == want
        assert sorted(tuple(r) for r in getattr(again, part).collect()) == want
    assert (again.n, again.total) == (4, 5)
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("postings_")]
    assert again.stats.first().asDict() == {"n_docs": 4, "avgdl": 1.25}


def test_hot_term_is_split(spark, tmp_path):
    """Postings joined with the stored terms: AQE splits the partition of a term of 95 % of the postings."""
    keep = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold",
                                           "spark.sql.adaptive.advisoryPartitionSizeInBytes",
                                           "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes")}
    postings = spark.range(200_000).select(
        F.col("id").alias("doc_id"), F.when(F.col("id") % 20 > 0, "hot").otherwise(F.concat(F.lit("t"), "id")).alias("term"),
        F.lit(1).cast("long").alias("tf"), F.lit(1).cast("long").alias("dl")).repartition(8)
    docs = spark.range(400_000).select(F.col("id").alias("doc_id"), F.lit(1).cast("long").alias("dl"))
    index = index_store.save_index(ix.TermIndex(postings, docs, unicode_form=None), f"{tmp_path}/index")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "64k")
        spark.conf.set("spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes", "64k")
        weights = ix.bm25_weights(index)
        assert weights.count() == 200_000
        assert "skew=true" in final_plan(weights)
    finally:
        for k, v in keep.items():
            spark.conf.set(k, v)


def error_of(df):
    with pytest.raises(Exception) as e:
        df.collect()
    return str(e.value)


def test_questions_without_documents_or_answers_stay_in_the_total(spark):
    questions = spark.createDataFrame([(1, "q", ["red"]), (2, "q", ["red"]), (3, "q", []), (4, "q", None)],
                                      "query_id long, question string, answer array<string>")
    retrieved = spark.createDataFrame([(1, 1, 0), (3, 1, 0), (4, 1, 0)], "query_id long, rank long, doc_id long")
    docs = docs_df(spark, ["a red hat"])
    for match in ev.MATCH_MODES:
        hits = ev.answer_hits(retrieved, docs, questions, match=match)
        assert {(r.query_id, r.hit) for r in hits.collect()} == {(1, True), (3, False), (4, False)}
        per = ev.retrieval_hits(hits, questions)
        assert ev.retrieval_accuracy(per).first().asDict() == {"total": 4, "matches": 1, "accuracy": 25.0}


def test_missing_things_raise(spark):
    retrieved = spark.createDataFrame([(1, 1, 9)], "query_id long, rank long, doc_id long")
    questions = spark.createDataFrame([(1, "q", ["x"])], "query_id long, question string, answer array<string>")
    docs = docs_df(spark, ["a red hat"])
    assert "no such document: 9" in error_of(ev.answer_hits(retrieved, docs, questions))
    assert "no such document: 9" in error_of(rd.reader_pairs(retrieved, questions, docs))
    preds = spark.createDataFrame([(1, 1, "a"), (1, 2, ""), (1, 3, "b")], "query_id long, rank long, item string")
    ids = spark.createDataFrame([("b", "B")], "key string, value string")
    assert "not in the entity map: a" in error_of(ev.remap_predictions(preds, ids))
    fused = spark.createDataFrame([(1, 1, 7)], "query_id long, fused_rank long, entity_id long")
    assert "not in the index map: 7" in error_of(lk.map_entities(fused, ids))
    gold = spark.createDataFrame([(2, "a")], "query_id long, item string")
    assert "no answer for question 1" in error_of(ev.hits_at_k(preds, gold, 5))
    assert "no answer for question 1" in error_of(ev.mean_reciprocal_rank(preds, gold))
    spans = spark.createDataFrame([(2, "x")], "query_id long, span string")
    assert "no valid span for question 1" in error_of(rd.require_spans(spans, questions))
    occ = spark.createDataFrame([(1, 0, 1, "s", "77", 3, 3)], "query_id long, mention_idx long, pred_rank long, span string, "
                                "doc_key string, start_idx long, end_idx long")
    assert "no such document: 77" in error_of(lk.mention_spans(occ, questions, docs))


def test_empty_lists_count_in_the_totals(spark):
    preds = spark.createDataFrame([(1, 1, "a")], "query_id long, rank long, item string")
    gold = spark.createDataFrame([(1, "a"), (2, "b")], "query_id long, item string")
    lists = spark.createDataFrame([(1,), (2,)], "query_id long")
    assert ev.hits_at_k(preds, gold, 5, lists=lists).first().asDict() == {"total": 2, "hits": 1, "hits_at_k": 50.0}
    assert ev.mean_reciprocal_rank(preds, gold, lists=lists).first().asDict() == {"total": 2, "mrr": 0.5}


def test_regex_answers_in_their_dialect(spark):
    questions = spark.createDataFrame([(i, "q", [p]) for i, p in enumerate(
        [r"\p{L}+ hat", r"(?P<c_1>red) hat", "(", r"^RED hat$", "red.hat"])], "query_id long, question string, answer array<string>")
    retrieved = questions.selectExpr("query_id", "1L as rank", "0L as doc_id")
    hits = ev.answer_hits(retrieved, docs_df(spark, ["a\u2028b\nred hat\nc"]), questions, match="regex")
    assert [r.hit for r in hits.orderBy("query_id").collect()] == [True, True, False, True, True]


def test_dense_topk_ties_blocks_and_empty_tiles(spark, monkeypatch):
    monkeypatch.setattr(lk, "ENTITY_BLOCK", 7)
    monkeypatch.setattr(lk, "MENTION_BLOCK", 5)
    rng = np.random.default_rng(2)
    x = rng.integers(-2, 3, (60, 3)).astype(float)  # many equal scores
    cat = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    m = cat.select(F.col("vec_id").alias("mention_id"), "embedding")
    for tile_bytes in (1 << 30, 500, 24):  # one, three and sixty tiles, larger than the blocks and not
        got = lk.dense_topk(m, cat, 6, exclude_self=True, tile_bytes=tile_bytes)
        rows = {(r.mention_id, r.rank): r.entity_id for r in got.collect()}
        s = x @ x.T
        for i in range(60):
            order = [j for j in np.lexsort((np.arange(60), -s[i])) if j != i][:6]
            assert [rows[i, r] for r in range(1, 7)] == order
    assert "collect" not in inspect.getsource(lk.dense_topk)


def test_dense_topk_moves_a_vector_few_times():
    """600,000 vectors of 64 as mentions and catalogue; some 600 copies of each before."""
    size = 600_000 * 64 * 8
    tiles, blocks = lk.grid(size, 600_000, size, 12, lk.TILE_BYTES)
    assert tiles <= 5 and blocks <= 40 and tiles * blocks >= 100
    assert lk.grid(10_000 * 512, 10_000, 10_000 * 512, 12, lk.TILE_BYTES) == (1, 10)


def test_single_precision_loses_no_vector(monkeypatch):
    """Scores apart by less than single precision tells, many equal ones, vectors too large for it or not finite."""
    monkeypatch.setattr(lk, "ENTITY_BLOCK", 64)
    monkeypatch.setattr(lk, "SCORE_ROWS", 3)
    rng = np.random.default_rng(5)
    for scale in (1.0, 30.0, 1e-3, 1e25):
        x = (np.ones((400, 8)) + rng.integers(-3, 4, (400, 8)) * 1e-7 + (rng.random((400, 1)) < 0.3)) * scale
        x = x[np.argsort(-np.square(x).sum(axis=1))]
        mentions, ids = x[rng.permutation(400)[:20]], rng.permutation(400)
        block = lk.MentionBlock(ids[:20] + 0, mentions, 4, exclude_self=True)
        for at in range(0, 400, 90):
            block.meet(ids[at:at + 90], x[at:at + 90])
        for i in range(20):
            s = lk._rounded(np.einsum("j,ij->i", mentions[i], x))
            s[ids == ids[i]] = -np.inf
            near = np.lexsort((ids, -s))[:4]
            if scale < 1e6:
                assert block.best_ids[i].tolist() == ids[near].tolist()
            assert np.allclose(block.best[i], s[near], rtol=1e-12)


def test_vectors_that_cannot_reach_are_not_scored(monkeypatch):
    """Falling norms: most products are left out, the lists are those of all products."""
    monkeypatch.setattr(lk, "ENTITY_BLOCK", 50)
    rng = np.random.default_rng(3)
    x = rng.normal(size=(2000, 16)) * rng.pareto(1.0, 2000)[:, None]
    x = x[np.argsort(-np.square(x).sum(axis=1))]
    mentions, ids = rng.normal(size=(40, 16)), np.arange(2000)
    block = lk.MentionBlock(np.arange(5000, 5040), mentions, 10, exclude_self=True)
    for at in range(0, 2000, 130):  # a tile larger than a block, in pieces
        block.meet(ids[at:at + 130], x[at:at + 130])
    scores = lk._rounded(mentions @ x.T)
    want = [np.lexsort((ids, -s))[:10] for s in scores]
    assert (block.best_ids == np.array(want)).all()
    assert (block.best == np.take_along_axis(scores, np.array(want), axis=1)).all()
    assert block.scored < 40 * 2000 / 4
    assert lk._rounded(np.array([0.0000005, -0.0000005, 1.25])).tolist() == [1e-6, -1e-6, 1.25]


def test_batch_model_scores_the_tokens(spark):
    def scorer():
        return lambda seqs: [([float(len(t)) for t in s], [1.0] * len(s), 0.5) for s in seqs]
    questions = spark.createDataFrame([(1, "who")], "query_id long, question string")
    pairs = rd.reader_pairs(spark.createDataFrame([(1, 1, 0)], "query_id long, rank long, doc_id long"), questions,
                            docs_df(spark, ["a longest word"]))
    scored = rd.score_passages_with(rd.pair_encoding(pairs), scorer)
    best = rd.nbest(rd.passage_spans(scored, 1)).orderBy("nbest_rank").first()
    assert best.span == "longest" and math.isclose(best.prob, math.exp(8.5))


def test_scratch_is_cleaned(spark):
    from lanternqa import session
    path = session.scratch_path(spark, "x")
    spark.range(3).write.parquet(path)
    assert session.clean_scratch(spark) >= 1
    with pytest.raises(Exception):
        spark.read.parquet(path).count()


def test_large_question_side_scores_alike(spark, tmp_path):
    """Beyond the broadcast bound the same scores come from two stored tables."""
    index = stored_index(spark, tmp_path, [f"alpha beta{i} beta{i % 7} gamma{i % 3}" for i in range(60)])
    questions = spark.createDataFrame([(1, "beta3 gamma1"), (2, "beta5")], "query_id long, question string")
    qterms = rt.question_terms(questions, index)
    scores = [sorted((r.query_id, r.doc_id, round(r.score, 9)) for r in rt.score_pairs(
        index, rt.query_vectors(qterms, index, "bm25", small), "bm25", small).collect()) for small in (True, False)]
    assert scores[0] == scores[1] and scores[0]


def test_broadcast_bound_counts_bytes(spark):
    df = spark.createDataFrame([("x" * 1000, 1)] * 10, "s string, n long")
    assert joins.fits_broadcast(df, 20_000) and not joins.fits_broadcast(df, 10_000)
    assert joins.fits_broadcast(df.where("false"), 0)


def test_no_machine_local_scratch_on_a_cluster(tmp_path):
    from types import SimpleNamespace

    from lanternqa import session
    context = SimpleNamespace(master="spark://host:7077", getCheckpointDir=lambda: None)
    cluster = SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda k, d=None: d))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.checkpoint_dir(cluster)
