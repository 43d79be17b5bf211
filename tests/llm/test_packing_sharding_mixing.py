"""Operators 7, 8 and 9 against brute force and their invariants."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lanternqa.llm import mixing as mx
from lanternqa.llm import packing as pk
from lanternqa.llm import sharding as sd

from .conftest import odd_texts, sentence


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(pk.vocabulary_path())


HARD = ["Straße İ K ΑΣ σ. Σ", "á ́b é É. ª º µ ſ ŉ Ǆ, H̱ ẖ", "<|endoftext|>x don't it's. ... <|ENDOFTEXT|>",
        "x\x1cy  z w\x85q r", "a.b. hello!! WORLD, \"q\".", "中文字符 日本語。", "ÀÉÎ, öö; ß? ÿ! ð: þ.", "x" * 300 + " " + "Y" * 200 + ".",
        " ".join(f"wörld{i}" for i in range(50)), "🙂 emoji🙂. ́", " nbsp  x"]


def test_word_ids_are_the_text_ids(tokenizer):
    texts = HARD + [t or "" for _, t in odd_texts()]
    rng = random.Random(2)
    pool = list("abÀé.,!'’ \n\tΣİḰ<|0") + ["<|endoftext|>", " the ", "'s"]
    texts += ["".join(rng.choice(pool) for _ in range(rng.randrange(60))) for _ in range(500)]
    words = pk.WordTokenizer(pk.vocabulary_path())
    want = [np.array(e.ids, dtype="<u4").tobytes() for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert ids_of(words, texts) == want
    assert [ids_of(words, [t])[0] for t in texts] == want  # from the kept words
    assert ids_of(words, [None, "", "a"])[:2] == [b"", b""]
    sliced = pa.array(["skipped", *texts[:20]]).slice(1, 5)
    ids, at = words.ids(sliced)
    assert [ids[s:e].tobytes() for s, e in zip(at[:-1], at[1:], strict=True)] == want[:5]


def ids_of(words, texts):
    ids, at = words.ids(pa.array(texts, pa.string()))
    return [ids[s:e].tobytes() for s, e in zip(at[:-1], at[1:], strict=True)]


def test_a_small_cache_changes_nothing(tokenizer, monkeypatch):
    monkeypatch.setattr(pk, "CACHED_WORDS", 5)
    words = pk.WordTokenizer(pk.vocabulary_path())
    for t in HARD * 2:
        assert ids_of(words, [t])[0] == np.array(tokenizer.encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes()


def brute_best_fit(lengths, sequence, open_bins):
    free, open_, bins, offsets = [], [], [], []
    for length in lengths:
        fitting = [b for b in open_ if free[b] >= length]
        if fitting:
            least = min(free[b] for b in fitting)
            b = [b for b in fitting if free[b] == least][-1]
            open_.remove(b)
        else:
            b = len(free)
            free.append(sequence)
        bins.append(b)
        offsets.append(sequence - free[b])
        free[b] -= length
        if free[b]:
            open_.append(b)
            if len(open_) > open_bins:
                least = min(free[x] for x in open_)
                open_.remove([x for x in open_ if free[x] == least][-1])
    return bins, offsets


@pytest.mark.parametrize("open_bins", [1, 3, 1000])
def test_best_fit_matches_brute_force(open_bins):
    rng = random.Random(open_bins)
    for _ in range(20):
        lengths = [rng.randrange(1, 65) for _ in range(rng.randrange(120))]
        assert pk.best_fit(lengths, 64, open_bins) == brute_best_fit(lengths, 64, open_bins)
    assert pk.best_fit([]) == ([], [])


def test_pieces_and_sequences_round_trip(odd_docs, no_docs, tokenizer):
    packed = pk.pack_documents(odd_docs, with_ids=True).cache()
    rows = packed.collect()
    docs = Counter()
    for r in odd_docs.collect():
        ids = tokenizer.encode(r["text"] or "", add_special_tokens=False).ids + [0]
        for n, at in enumerate(range(0, len(ids), 2048)):
            part = np.array(ids[at:at + 2048], dtype="<u4").tobytes()
            docs[(r["doc_id"], n, at, len(part) // 4, zlib.crc32(part))] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == docs
    by_sequence = defaultdict(list)
    for r in rows:
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    total = sum(r["length"] for r in rows)
    assert len(by_sequence) <= 1 + -(-total // 2048)
    for s in pk.sequences(packed).collect():
        assert len(s["ids"]) == 4 * s["n_tokens"] and len(s["doc_ids"]) == len(by_sequence[s["sequence_id"]])
    assert pk.pack_documents(no_docs).count() == 0


def test_many_groups_pack_gaplessly(spark):
    rng = random.Random(8)
    cut = spark.createDataFrame([(i, rng.randrange(1, 2049)) for i in range(3000)], "doc_id long, length long")
    rows = pk.pack(cut, group_pieces=500).collect()
    held = defaultdict(list)
    for r in rows:
        held[r["sequence_id"]].append((r["offset"], r["length"]))
    assert len(rows) == 3000
    assert all(sum(n for _, n in p) <= 2048 for p in held.values())
    assert len(held) <= 1.02 * sum(r["length"] for r in rows) / 2048


def check_shards(rows, n_shards, total):
    slots = defaultdict(list)
    sizes = Counter()
    for r in rows:
        slots[r["shard"]].append(r["slot"])
        sizes[r["shard"]] += r["size"]
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(0 <= s < n_shards for s in slots)
    assert sum(sizes.values()) == total
    return sizes


def test_odd_documents_are_placed_once(odd_docs, no_docs):
    rows = sd.shard_documents(odd_docs).collect()
    docs = odd_docs.collect()
    want = Counter((r["doc_id"], len((r["text"] or "").encode()) + 1, zlib.crc32((r["text"] or "").encode())) for r in docs)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == want
    check_shards(rows, 16, sum(s * n for (_, s, _), n in want.items()))
    assert sd.shard_documents(no_docs).count() == 0


@pytest.mark.parametrize("hot", [False, True])
def test_shards_are_near_equal_even_with_a_hot_group(spark, hot):
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.when(
        F.lit(hot) & (F.col("id") % 3 == 0), F.lit("the same text " * 20)).otherwise(
        F.repeat(F.concat(F.col("id").cast("string"), F.lit(" word ")), (F.col("id") % 60 + 1).cast("int"))).alias("text"))
    rows = sd.shard_documents(docs, ranges=512).collect()
    total = sum(r["size"] for r in rows)
    sizes = check_shards(rows, 16, total)
    assert len(sizes) == 16
    assert max(sizes.values()) <= 1.05 * total / 16 and min(sizes.values()) >= 0.95 * total / 16


def test_overfull_ranges_are_cut_again(spark):
    # two samples for each range are far too few: many ranges come out overfull
    docs = spark.range(5000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), (F.col("id") % 500).cast("int")).alias("text"))
    rows = sd.shard_documents(docs, n_shards=8, ranges=64, samples=1).collect()
    sizes = check_shards(rows, 8, sum(r["size"] for r in rows))
    assert max(sizes.values()) <= 1.15 * sum(sizes.values()) / 8


def test_equal_texts_lie_side_by_side(spark):
    docs = spark.createDataFrame([(i, f"text {i % 50}") for i in range(1000)], "doc_id long, text string")
    rows = sorted((r["shard"], r["slot"], r["text_crc32"]) for r in sd.shard_documents(docs, n_shards=4).collect())
    changes = sum(a[2] != b[2] for a, b in zip(rows, rows[1:], strict=False))
    assert changes == 49


def test_no_python_in_the_sharding_plan(odd_docs):
    placed = sd.shard_documents(odd_docs)
    plan = placed._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_shards_are_written(spark, odd_docs, tmp_path):
    sd.write_shards(odd_docs, f"{tmp_path}/out", 4)
    assert spark.read.parquet(f"{tmp_path}/out").count() == odd_docs.count()


def brute_rake(cells, targets, rounds=200):
    w = {c: 1.0 for c in cells}
    total = sum(cells.values())
    for _ in range(rounds):
        for m, share in enumerate(targets):
            have = defaultdict(float)
            for c, t in cells.items():
                have[c[m]] += t * w[c]
            for c in cells:
                if have[c[m]] > 0:
                    w[c] *= share[c[m]] * total / have[c[m]]
    return w


def test_raking_meets_every_margin(spark):
    rng = random.Random(3)
    cells = {(s, la, t): rng.randrange(50, 5000) for s in "abcd" for la in ("en", "fr") for t in (-1, 0, 1)}
    shares = [{"a": .1, "b": .2, "c": .3, "d": .4}, {"en": .6, "fr": .4}, {-1: .1, 0: .5, 1: .4}]
    df = spark.createDataFrame([(*c, n) for c, n in cells.items()], "source string, lang string, topic int, tokens long")
    targets = {m: spark.createDataFrame(list(s.items()), f"{m} {'int' if m == 'topic' else 'string'}, share double")
               for m, s in zip(mx.MARGINS, shares, strict=True)}
    got = {(r["source"], r["lang"], r["topic"]): r["weight"] for r in mx.rake(df, targets, tolerance=1e-7).collect()}
    want = brute_rake(cells, shares)
    assert got.keys() == want.keys()
    assert all(abs(got[c] - want[c]) < 1e-4 * want[c] for c in want)


def test_few_and_many_cells_get_the_same_odds(spark):
    rng = random.Random(5)
    cells = [(s, la, t, rng.randrange(0, 5000)) for s in "abcde" for la in ("", "en", "fr") for t in (-1, 0, 1)
             if rng.random() < 0.8]
    df = spark.createDataFrame(cells, "source string, lang string, topic int, tokens long")
    few, many = (sorted(tuple(r) for r in mx.odds(df, mx.TEMPERATURE, 0.6, n).collect()) for n in (1000, 0))
    assert [r[:4] for r in few] == [r[:4] for r in many]
    assert np.allclose([r[4:] for r in few], [r[4:] for r in many], rtol=1e-6)
    assert abs(sum(r[3] * r[5] for r in few) - 0.6 * sum(r[3] for r in few)) < 1e-3


def test_probabilities_meet_the_budget(spark):
    df = spark.createDataFrame([("a", 100, 1.0), ("b", 300, 0.2), ("c", 50, 9.0), ("d", 0, 3.0)],
                               "source string, tokens long, weight double")
    rows = mx.calibrate(df, 0.6).collect()
    assert abs(sum(r["tokens"] * r["probability"] for r in rows) - 0.6 * 450) < 1e-6
    p = {r["source"]: r["probability"] for r in rows}
    assert p["c"] == 1.0 and max(p.values()) <= 1 and (p["a"] == 1 or abs(p["a"] / p["b"] - 5) < 1e-6)


def test_mixture_of_odd_documents(odd_docs, no_docs):
    rows = mx.mixture(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    by_id = {r["doc_id"]: r for r in rows}
    assert by_id[1]["topic"] == -1 and by_id[1]["tokens"] == 0
    assert all(0 <= r["probability"] <= 1 for r in rows)
    for r in rows:  # a cell has one probability
        assert r["probability"] == next(x["probability"] for x in rows if all(x[m] == r[m] for m in mx.MARGINS))
    kept = mx.mixed_documents(odd_docs)
    assert kept.columns == odd_docs.columns
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter(r["doc_id"] for r in rows if r["sampled"])
    assert mx.mixture(no_docs).count() == 0 and mx.mixed_documents(no_docs).count() == 0


def test_sampled_tokens_follow_the_targets(spark):
    rng = random.Random(1)
    docs = spark.createDataFrame([(i, sentence(rng, 20), "en" if i % 4 else "fr", "hot" if i % 3 else f"s{i % 5}")
                                  for i in range(3000)], "doc_id long, text string, lang string, source string")
    rows = mx.mixture(docs, budget=0.5).collect()
    expected, sampled = Counter(), Counter()
    for r in rows:
        expected[r["source"]] += r["tokens"] * r["probability"]
        sampled[r["source"]] += r["tokens"] * r["sampled"]
    total = sum(r["tokens"] for r in rows)
    assert abs(sum(expected.values()) / total - 0.5) < 1e-6
    assert abs(sum(sampled.values()) / total - 0.5) < 0.05
    have = Counter()
    for r in rows:
        have[r["source"]] += r["tokens"]
    want = {s: n ** 0.7 for s, n in have.items()}
    for s in have:
        assert abs(expected[s] / sum(expected.values()) - want[s] / sum(want.values())) < 0.05


def brute_probabilities(cells, power, budget):
    """Water-filled targets, then margins met one after the other; probabilities at 1 stay while their margin wants more."""
    total = sum(cells.values())

    def filled(tokens):
        c_low, c_high = 0.0, 1e12
        for _ in range(300):  # bisection
            c = (c_low + c_high) / 2
            got = sum(min(t, c * t ** power) for t in tokens.values() if t)
            c_low, c_high = (c, c_high) if got < budget * total else (c_low, c)
        return {m: min(t, c_low * t ** power) if t else 0.0 for m, t in tokens.items()}

    wanted = []
    for i in range(3):
        held = defaultdict(float)
        for c, t in cells.items():
            held[c[i]] += t
        wanted.append(filled(held))
    p = {c: budget for c in cells}
    for _ in range(400):
        for i, want in enumerate(wanted):
            for value, tokens in want.items():
                own = [c for c in cells if c[i] == value]
                at_one = sum(cells[c] for c in own if p[c] >= 1)
                have = sum(cells[c] * p[c] for c in own)
                for c in own:
                    if tokens > at_one and p[c] < 1 and have > at_one:
                        p[c] = min(1.0, p[c] * (tokens - at_one) / (have - at_one))
                    elif tokens <= at_one and have > 0:
                        p[c] = p[c] * tokens / have
    return p, wanted


def brute_topics(docs, vocabulary, topics):
    """``{doc_id: topic}`` by the definition, document by document."""
    out = {}
    for lang in {d[2] for d in docs}:
        own = [(i, [w.decode() for w in mx.words_of(t or "")]) for i, t, la in docs if la == lang]
        df = Counter(w for _, ws in own for w in set(ws))
        idf = {w: np.log(len(own) / n) for w, n in df.items()}
        best = sorted((w for w in df if round(df[w] * idf[w], 9) > 0), key=lambda w: (-round(df[w] * idf[w], 9), w))[:vocabulary]
        held = np.array([[w in set(ws) for w in best] for _, ws in own], dtype=float).reshape(len(own), len(best))
        if not best:
            out.update({i: -1 for i, _ in own})
            continue
        p, both = held.mean(axis=0), held.T @ held / len(own)
        sd = np.sqrt(p * (1 - p))
        r = (both - np.outer(p, p)) / np.outer(sd, sd)
        axis = np.linalg.eigh(r / np.linalg.norm(r, axis=1, keepdims=True) * np.linalg.norm(r, axis=1, keepdims=True))[1][:, -1]
        axis = np.round(axis * np.sign(axis[np.argmax(np.abs(np.round(axis, 9)))]), 9)
        weight = {w: p[j] * idf[w] for j, w in enumerate(best)}
        topic, so_far = {}, 0.0
        for j in np.argsort(axis, kind="stable"):
            topic[best[j]] = min(topics - 1, int(so_far / sum(weight.values()) * topics + 1e-12))
            so_far += weight[best[j]]
        mean = Counter()
        for w in best:
            mean[topic[w]] += weight[w]
        for i, ws in own:
            sums = Counter()
            for w, n in Counter(ws).items():
                if w in topic:
                    sums[topic[w]] += n ** 0.5 * idf[w] / mean[topic[w]]
            out[i] = min(sums, key=lambda t: (-round(sums[t], 9), t)) if sums else -1
    return out


def test_mixture_against_brute_force(spark):
    rng = random.Random(12)
    themes = [[f"t{k}w{i}" for i in range(12)] for k in range(4)]
    docs = []
    for i in range(400):
        theme = themes[rng.randrange(4)]
        words = [rng.choice(theme if rng.random() < 0.7 else themes[rng.randrange(4)]) for _ in range(rng.randrange(0, 30))]
        docs.append((i, " ".join(words) or None, rng.choice(["en", "en", "en", "fr"]), rng.choice(["a", "a", "a", "b", "c"])))
    rows = mx.mixture(spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").repartition(5)).collect()
    topics = brute_topics([d[:3] for d in docs], mx.VOCABULARY, mx.TOPICS)
    assert {r["doc_id"]: r["topic"] for r in rows} == topics
    cells = Counter()
    for i, text, lang, source in docs:
        cells[source, lang, topics[i]] += len((text or "").split())
    p, wanted = brute_probabilities(cells, 0.7, mx.BUDGET)
    total = mx.BUDGET * sum(cells.values())
    for r in rows:
        cell = (r["source"], r["lang"], r["topic"])
        assert r["probability"] == pytest.approx(p[cell], abs=2e-3)
        for k, m in enumerate(mx.MARGINS):
            assert r[f"target_{m}"] == pytest.approx(wanted[k][cell[k]] / total, abs=1e-6)
            assert r[f"reached_{m}"] == pytest.approx(r[f"target_{m}"], abs=1e-3)
        assert r["sampled"] == (r["probability"] > 0 and r["sampled"])


def test_targets_beyond_what_there_is_are_cut_and_told(spark):
    cells = spark.createDataFrame([("a", "en", 0, 9000), ("b", "en", 0, 10), ("a", "fr", 1, 900), ("b", "fr", 1, 90)],
                                  "source string, lang string, topic int, tokens long")
    for few in (1000, 0):
        rows = mx.odds(cells, mx.TEMPERATURE, 0.8, few).collect()
        assert sum(r["tokens"] * r["probability"] for r in rows) == pytest.approx(8000, abs=1)
        b = next(r for r in rows if r["source"] == "b")
        assert b["target_source"] == pytest.approx(100 / 8000, abs=1e-6)  # all there is
        assert all(0 <= r["probability"] <= 1 for r in rows)
