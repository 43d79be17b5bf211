"""Operators 2 and 4 against brute force and held-out accuracy."""

import random
import sys
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lanternqa.llm import graph_ann as ga
from lanternqa.llm import toxicity as tx

from .conftest import sentence

INSULTS = ("grumblefoot", "snorkwit", "dunderclod", "blatherskite")


def toxic_corpus(n=900):
    rng = random.Random(6)
    docs, labels = [], []
    for i in range(n):
        words = sentence(rng, rng.randrange(30, 120)).split()
        toxic = int(i % 7 == 0)
        if toxic:
            for _ in range(rng.randrange(1, 6)):
                words.insert(rng.randrange(len(words)), rng.choice(INSULTS) + rng.choice(["", "s", "ish", ","]))
        docs.append((i, " ".join(words), "clash"))
        if i % 3:
            labels.append((i, 1, toxic))
    return docs, labels


def test_held_out_documents_are_told_apart(spark):
    docs, labels = toxic_corpus()
    table = spark.createDataFrame(docs, "doc_id long, text string, score string")
    marks = spark.createDataFrame(labels + labels[:50] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    rows = {r["doc_id"]: r for r in tx.toxicity(table, marks).collect()}
    assert len(rows) == len(docs)
    for i, r in rows.items():
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7)
    hits = [r["predicted"] == int(i % 7 == 0) for i, r in rows.items() if r["held_out"]]
    assert sum(hits) / len(hits) > 0.97
    known = {i for i, _, _ in labels if zlib.crc32(str(i).encode()) % 3 != 1}
    assert all(e["doc_id"] in known for r in rows.values() for e in r["evidence"])


def test_scores_ignore_held_out_labels(spark):
    docs, labels = toxic_corpus(300)
    table = spark.createDataFrame(docs, "doc_id long, text string, score string")
    turned = [(i, q, 1 - t if zlib.crc32(str(i).encode()) % 3 == 1 else t) for i, q, t in labels]
    scores = [sorted((r["doc_id"], r["score"]) for r in tx.toxicity(table, spark.createDataFrame(
        x, "doc_id long, quality int, toxic int")).collect()) for x in (labels, turned)]
    assert scores[0] == scores[1]


def test_odd_rows_and_missing_labels(spark, odd_docs, no_docs):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r["score"] for r in tx.toxicity(odd_docs, none).collect()} == {0.0}
    one_class = spark.createDataFrame([(i, 1, 0) for i in range(40)], "doc_id long, quality int, toxic int")
    rows = tx.toxicity(odd_docs, one_class).collect()
    assert len(rows) == odd_docs.count() and all(r["score"] < 0.5 for r in rows)
    docs, labels = toxic_corpus(300)
    model = tx.fit(spark.createDataFrame(docs, "doc_id long, text string, score string"),
                   spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert tx.score(odd_docs, model).count() == odd_docs.count()
    assert tx.score(no_docs, model).count() == 0
    for r in tx.score(odd_docs, model).where("doc_id in (1, 2, 3)").collect():
        assert r["score"] < 0.5 and r["evidence"] == []


def test_every_term_of_the_examples_is_searched(spark):
    # nothing tells the labels apart: no term is significant, and each text has a word of its own
    rng = random.Random(8)
    texts = [" ".join("".join(rng.choice("abcdefgh") for _ in range(7)) for _ in range(12)) + f" zq{chr(97 + i % 26)}{chr(97 + i // 26)}"
             for i in range(60)]
    labels = [(i, 1, i % 2) for i in range(60)]
    known = [i for i in range(60) if zlib.crc32(str(i).encode()) % 3 != 1]
    words = {i: texts[i].split() for i in known}
    probes = [(1000 + i, " ".join([words[i][-1]] * 3)) for i in known]
    table = spark.createDataFrame(list(enumerate(texts)) + probes, "doc_id long, text string")
    model = tx.fit(table, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    got = {r["doc_id"]: r["evidence"] for r in tx.score(table, model).collect()}
    counts = [Counter(b for w in texts[i].split() for b in tx.bases_of(w)) for i in known]
    assert set(model.vocabulary.at) == {b for c in counts for b in c}
    x = np.zeros((len(known), len(model.weight)))
    for k, c in enumerate(counts):
        for b, n in c.items():
            x[k, model.vocabulary.at[b]] = n * model.weight[model.vocabulary.at[b]]
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    for k, i in enumerate(known):
        assert got[1000 + i][0]["doc_id"] == i  # found by a word that one example holds
        cosines = np.round(x @ x[k], 9)
        want = sorted((-c, known[j]) for j, c in enumerate(cosines) if c > 0)[:15]
        assert np.allclose([e["cosine"] for e in got[i]], [-c for c, _ in want], atol=1e-8)


def test_counts_of_a_term_are_not_levelled():
    texts = ["bad " * 7 + "good bad", None, "", "ugly", "Good!bad? badly", "\u00e9good"]
    found = tx.Vocabulary({"bad": 0, "good": 1, "badl*": 2}).found(pa.array(texts))
    lists = [(found.terms[found.of(i)].tolist(), found.counts[found.of(i)].tolist()) for i in range(len(texts))]
    assert lists == [([0, 1], [8, 1]), ([], []), ([], []), ([], []), ([0, 1, 2], [1, 1, 1]), ([], [])]


def test_words_are_looked_up_in_columns():
    """No step of Python for a word, whatever the number of distinct words."""
    words = [f"{a}{b}{c}{d}word{a}" for a in "abcdefg" for b in "abcdefg" for c in "abcdefg" for d in "abcdefg"]
    vocabulary = tx.Vocabulary({b: i for i, b in enumerate(dict.fromkeys(b for w in words[::2] for b in tx.bases_of(w)))})
    texts, steps = pa.array([" ".join(words), None, "aaaaw aaaaword"]), []
    sys.setprofile(lambda _frame, event, _arg: steps.append(event))
    try:
        found = vocabulary.found(texts)
    finally:
        sys.setprofile(None)
    assert len(steps) < len(words) / 2
    want = Counter(vocabulary.at[b] for w in words for b in tx.bases_of(w) if b in vocabulary.at)
    assert dict(zip(found.terms[found.of(0)].tolist(), found.counts[found.of(0)].tolist(), strict=True)) == want
    want = Counter(vocabulary.at[b] for w in ("aaaaw", "aaaaword") for b in tx.bases_of(w) if b in vocabulary.at)
    assert found.first[1] == found.first[2]
    assert dict(zip(found.terms[found.of(2)].tolist(), found.counts[found.of(2)].tolist(), strict=True)) == want


def test_rows_of_one_id_are_one_example(spark):
    docs = spark.createDataFrame([(0, f"bad words {i:04d}") for i in range(3000)] + [(i, f"fine text {i}") for i in range(1, 40)],
                                 "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1 if i == 0 else 0) for i in range(40)], "doc_id long, toxic int")
    model = tx.fit(docs, labels, {1: 2, 0: 5})
    assert len(model.index.ids) <= 7 and (model.index.ids == 0).sum() == 1
    assert tx.toxicity(docs, labels).count() == docs.count()


def test_votes_and_calibrated_scores_against_brute_force(spark):
    rng = random.Random(8)
    texts = [" ".join(rng.choice(["vile", "foul", "rude"] if rng.random() < (0.4 if i % 4 == 0 else 0.05) else ["calm", "kind", "mild", "tree", "sky"])
                      for _ in range(rng.randrange(1, 12))) for i in range(200)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(200)], "doc_id long, toxic int")
    got = {r["doc_id"]: r for r in tx.toxicity(docs, labels).collect()}
    learnt = [i for i in range(200) if zlib.crc32(str(i).encode()) % 3 != 1]
    names = sorted({t for i in learnt for t in tx.all_terms(texts[i])})
    counts = np.array([[sum(t in tx.bases_of(w.decode()) for w in tx.words_of(text)) for t in names] for text in texts])
    toxic = np.array([int(i % 4 == 0) for i in range(200)])
    single = list({(texts[i], toxic[i]): i for i in learnt}.values())
    a, b = ((counts[[i for i in single if toxic[i] == c]] > 0).sum(axis=0) for c in (1, 0))
    chi = tx.chi_squared(a.astype(float), b.astype(float), sum(toxic[i] for i in single), sum(1 - toxic[i] for i in single))
    weight = np.log(1 + 200 / np.maximum((counts > 0).sum(axis=0), 1)) * (1 + np.sqrt(chi))
    v = counts * weight
    v = v / np.linalg.norm(v, axis=1, keepdims=True)

    def share(i, leave):
        cosine = np.round(v[learnt] @ v[i], 12)
        near = [j for j in np.lexsort((learnt, -cosine)) if cosine[j] > 0 and learnt[j] != leave][:15]
        w = cosine[near] ** 2
        return (w * toxic[learnt][near]).sum() / (w.sum() + tx.DOUBT)

    curve = tx.logistic_curve(np.array([share(i, i) for i in learnt]), toxic[learnt], np.ones(len(learnt)))
    for i in range(200):
        assert got[i]["score"] == pytest.approx(1 / (1 + np.exp(-(curve[0] * share(i, None) + curve[1]))), abs=1e-6)


def test_block_max_search_is_exact():
    rng = np.random.default_rng(4)
    vectors = rng.random((700, 30)) * (rng.random((700, 30)) < 0.15)
    vectors[100:200] = vectors[100]  # many ties
    norms = np.linalg.norm(vectors, axis=1, keepdims=True)
    vectors = np.divide(vectors, norms, where=norms > 0, out=np.zeros_like(vectors))
    ids = rng.permutation(700).astype(np.int64)
    index = tx.BlockMaxIndex(vectors, ids, np.zeros(700, dtype=np.int64))
    for _ in range(60):
        q = rng.random(30) * (rng.random(30) < 0.2)
        terms = np.flatnonzero(q).tolist()
        if not terms:
            continue
        w = q[terms] / np.linalg.norm(q)
        at, cosine = index.nearest(tx.Found(np.array([0, len(terms)]), np.array(terms), w), 15)[0]
        full = np.round(vectors[:, terms] @ w, 12)
        order = [i for i in np.lexsort((ids, -full)) if full[i] > 0][:15]
        assert np.allclose(cosine, full[order], atol=1e-11)
        got, want = index.ids[at], ids[order]
        last = cosine[-1]
        assert set(got[cosine > last + 1e-9]) == {i for i, c in zip(want, full[order], strict=True) if c > last + 1e-9}


def test_the_search_is_exact_beyond_single_precision():
    """Counts are multiplied in single precision first; cosines that differ less are told apart."""
    rng = np.random.default_rng(9)
    counts = (rng.random((900, 40)) < 0.5).astype(np.int64)
    counts[:400] = counts[0]  # apart by their scale alone
    scale = 1 / np.linalg.norm(counts, axis=1)
    scale[:400] *= 1 - rng.permutation(400) * 1e-10
    row, term = np.nonzero(counts)
    index = tx.BlockMaxIndex((row, term, counts[row, term].astype(np.uint8), 40), np.arange(900), np.zeros(900, dtype=np.int64), scale)
    index.cut()
    assert index.dense.shape[1] == 40 and index.dense.dtype == np.float32
    for q in (counts[0] * rng.random(40), rng.random(40)):
        terms = np.flatnonzero(q)
        at, cosine = index.nearest(tx.Found(np.array([0, len(terms)]), terms, q[terms] / np.linalg.norm(q)), 15)[0]
        full = np.round((counts @ (q / np.linalg.norm(q))) * scale, 12)
        order = np.lexsort((np.arange(900), -full))[:15]
        assert np.allclose(cosine, full[order], atol=2e-12)
        assert index.ids[at].tolist() == order.tolist()


def brute_nearest(rows, k=20):
    ok = [(i, np.array(v, dtype=np.float64)) for i, v in rows if i is not None and v is not None and None not in v
          and len(v) == 8 and np.isfinite(np.array(v, dtype=float)).all() and any(v)]
    out = {}
    for q, x in ok:
        if q % 20 == 0:
            best = sorted({(-float((x.astype(np.longdouble) * y.astype(np.longdouble)).sum()), i) for i, y in ok if i != q})
            out[q] = [(i, -s) for s, i in best[:k]]
    return out


def test_odd_vectors_match_brute_force(spark):
    rng = random.Random(2)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(8)]) for i in range(60)]
    rows += [(100 + i, list(rows[0][1])) for i in range(30)] + [rows[5], rows[40]]  # equal vectors, repeated rows
    rows += [(200, None), (220, [0.0] * 8), (240, [None] + [1.0] * 7), (260, [float("nan")] * 8),
             (280, [float("inf")] * 8), (300, [1.0] * 3), (None, [1.0] * 8), (320, [9.0] + [0.0] * 7)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "vec_id long, embedding array<double>, shard string").repartition(4)
    got = ga.nearest_neighbours(df, df.where("vec_id % 20 = 0")).collect()
    lists = {}
    for r in sorted(got, key=lambda r: (r["query_id"], r["rank"])):
        lists.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert lists == brute_nearest(rows)
    few = df.where("vec_id in (0, 1, 2)")
    assert [tuple(r)[:2] for r in ga.nearest_neighbours(few, few.where("vec_id = 0")).orderBy("rank").collect()] == [(0, 1), (0, 2)]
    assert ga.nearest_neighbours(df.where("false"), df.where("false")).count() == 0


def test_recall_of_the_searched_graph(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(20, 32))
    x = (centres[rng.integers(0, 20, 6000)] + 0.7 * rng.normal(size=(6000, 32))) * rng.uniform(0.5, 2, (6000, 1))
    x[1000:1500] = x[1000]  # a hot vector
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    rows = ga.nearest_neighbours(df, df.where(F.col("vec_id") % 20 == 0)).collect()
    got = {}
    for r in rows:
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    hit = 0
    for q in range(0, 6000, 20):
        s = np.round(x @ x[q], 9)
        s[q] = -np.inf
        hit += len(got[q] & set(np.lexsort((np.arange(6000), -s))[:20].tolist()))
    assert hit / (300 * 20) >= 0.95


def test_graph_edges_are_diverse_and_bounded():
    x = ga.lifted(np.random.default_rng(3).normal(size=(2000, 16)))
    edges, entry = ga.build_graph(x)
    assert edges.shape == (2000, ga.DEGREE + ga.SLACK) and 0 <= entry < 2000
    seen, todo = {entry}, [entry]
    while todo:
        for v in edges[todo.pop()]:
            if v >= 0 and v not in seen:
                seen.add(int(v))
                todo.append(int(v))
    assert len(seen) == 2000  # every node can be reached
