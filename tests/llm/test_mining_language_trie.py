"""Operators 11 to 13 against brute force, and their defined cases."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from lanternqa.llm import hard_negatives, language_id, prefix_trie

CLASH = "__a string, key string, depth string, k1 string, ids string, score string, rank string, vector string"


# --- hard negatives -------------------------------------------------------

def mined(rows):
    """The contract, pair by pair."""
    used = {}
    for i, v, label in rows:
        if i is None or v is None or label is None or any(x is None or not math.isfinite(x * 256) for x in v):
            continue
        label = int(math.fmod(label + 1, 10)) if i % 7 == 0 else label
        row = (label, list(v))
        used[i] = min(used.get(i, row), row)
    whole = {i: (label, [math.floor(256 * x) for x in v]) for i, (label, v) in used.items()}
    clip = lambda n: max(-2**63, min(2**63 - 1, n))
    out = []
    for a, (label, v) in whole.items():
        if a % 100:
            continue
        scores = {c: clip(sum(x * y for x, y in zip(v, w, strict=False))) for c, (_, w) in whole.items() if c != a}
        ranked = sorted(scores, key=lambda c: (-scores[c], c))
        for p in [c for c in ranked if whole[c][0] == label][:5]:
            fit = [c for c in ranked if whole[c][0] != label and 80 * scores[p] <= 100 * scores[c] <= 100 * scores[p]]
            out += [(a, p, r, c, scores[p], scores[c]) for r, c in enumerate(fit[:5], 1)]
    return sorted(out)


def vectors(n, dim, seed, spread=0.6):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(dim)] for _ in range(4)]
    return [(i, [x + rng.gauss(0, spread) for x in centres[rng.randrange(4)]], rng.randrange(10)) for i in range(n)]


def embeddings(spark, rows):
    names = CLASH.split(", ")
    return spark.createDataFrame([(*r, *["clash"] * len(names)) for r in rows],
                                 f"vec_id long, embedding array<double>, label int, {CLASH}").repartition(3)


@pytest.mark.parametrize(("dim", "seed"), [(16, 1), (20, 2), (64, 3)])
def test_hard_negatives_equal_brute_force(spark, dim, seed, monkeypatch):
    monkeypatch.setattr(hard_negatives, "TILE_ROWS", 64)
    monkeypatch.setattr(hard_negatives, "GROUP_TILES", 3)
    monkeypatch.setattr(hard_negatives, "BLOCK_ANCHORS", 4)
    rows = vectors(1200, dim, seed)
    found = sorted(tuple(r) for r in hard_negatives.hard_negatives(embeddings(spark, rows)).collect())
    assert found == mined(rows) and found


def test_hard_negatives_defined_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = vectors(300, 8, 5) + [
        (1000, None, 1), (1100, [nan] * 8, 2), (1200, [0.0, None] * 4, 3), (1300, [inf] * 8, 4), (1400, [1e307] * 8, 4),
        (None, [1.0] * 8, 1), (1500, [1.0] * 8, None), (1600, [], 2), (1700, [0.0] * 8, 3), (1800, [0.5] * 3, 4),
        (1900, [-1.0] * 8, 5), (2000, [1e17] * 8, 6), (2001, [1e17] * 8, 6), (2002, [9e16] * 8, 7), (2100, [3.0] * 12, 1)]
    rows += [(i, [0.25] * 8, i % 3) for i in range(3000, 3100)]  # ties
    rows += [(3000, [0.25] * 8, 0)] * 50 + [(3000, [0.125] * 8, 0)]  # repeated rows
    found = sorted(tuple(r) for r in hard_negatives.hard_negatives(embeddings(spark, rows)).collect())
    assert found == mined(rows)
    assert {r[0] for r in found} >= {1700, 2000, 3000}
    assert hard_negatives.hard_negatives(embeddings(spark, []).where("vec_id > 0")).count() == 0


def test_summaries_bound_every_score_and_spare_exact_ones():
    import numpy as np
    rng = np.random.default_rng(4)
    x = np.floor(rng.normal(0, 30, (400, 64)) + rng.normal(0, 60, (400, 1)))
    means, deviations = hard_negatives.summaries(x)
    true, at = x @ x.T, 0
    for n in hard_negatives.LEVELS:
        m, d = means[:, at:at + n], deviations[:, at:at + n]
        at += n
        middle, spread = 64 // n * (m @ m.T), d @ d.T
        assert (np.abs(true - middle) <= spread + 1e-6).all()
    ids, labels = np.arange(400), np.arange(400) % 2
    every = hard_negatives.Vectors(ids, labels, x, means, deviations)
    full = np.iinfo(np.int64)
    lists = hard_negatives.Lists(np.arange(20), np.full(20, full.min), np.full(20, full.max), 5)
    tiles = [every.take(slice(i, i + 50)) for i in range(0, 400, 50)]
    exact = hard_negatives.search(every.take(slice(0, 20)), iter(tiles), lists, same_label=True)
    assert exact < 20 * 400 / 2  # of 3,980 pairs of equal label


# --- prefix trie ----------------------------------------------------------

def trie(rows):
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            key = hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()
            convs[c].append((turn is not None, turn or 0, key, role, text))
    turns = {c: [(t[3], t[4]) for t in sorted(ts)] for c, ts in convs.items()}
    rebuilt = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 6
        rebuilt[c] = tuple(turns.get(c - int(math.fmod(c, 100)), [])[:h] + own[h:])
    members = defaultdict(list)
    for c, path in sorted(rebuilt.items()):
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
    out = []
    for path, who in members.items():
        below = [p for p in members if p[:len(path)] == path]
        children = [p for p in below if len(p) == len(path) + 1]
        leaves = [p for p in below if not any(len(q) == len(p) + 1 and q[:len(p)] == p for q in below)]
        saved = sum((len(members[p]) - 1) * len(p[-1][1]) for p in below if p)
        ends = ",".join(str(c) for c in who if len(rebuilt[c]) == len(path))
        out.append((who[0], len(path), members[path[:-1]][0] if path else None, len(who), len(children), len(leaves),
                    saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def conversations(spark, rows):
    names = CLASH.split(", ")
    return spark.createDataFrame([(*r, *["clash"] * len(names)) for r in rows],
                                 f"conv_id long, turn long, role string, text string, {CLASH}").repartition(4)


def found_trie(spark, rows):
    return sorted((tuple(r) for r in prefix_trie.prefix_trie(conversations(spark, rows)).collect()), key=str)


def talks(n, seed, texts=3, longest=9):
    rng = random.Random(seed)
    return [(c, t, rng.choice(["user", "assistant"]), f"text {rng.randrange(texts)}" * (1 + t % 2))
            for c in range(n) for t in range(rng.randrange(1, longest))]


@pytest.mark.parametrize("shard", [3, 2048])
def test_prefix_trie_equals_brute_force(spark, shard, monkeypatch):
    monkeypatch.setattr(prefix_trie, "SHARD_CONVERSATIONS", shard)
    rows = talks(230, 7)
    assert found_trie(spark, rows) == trie(rows)


def test_prefix_trie_defined_cases(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "BLOCK", 4)
    monkeypatch.setattr(prefix_trie, "SPAN", 3)
    rows = talks(120, 9, texts=2, longest=14) + [
        (None, 1, "user", "lost"), (500, None, None, None), (500, 0, "", ""), (500, 0, "user", "tie"), (500, 0, "user", "also"),
        (501, None, "user", "null first"), (501, -5, "user", "negative turn"), (501, 10**12, "user", "late"),
        (-7, 1, "user", "negative id"), (-7, 2, "user", "x" * 100_000), (777, 5, "é", "naïve   𝄞"), (2**62, 0, "user", "big id")]
    rows += [(600, 3, "user", "again")] * 20 + [(650, 3, "user", "again")] * 25  # repeated rows
    rows += [(c, t, "user", f"long {t}") for c in (700, 703, 704) for t in range(40)]
    assert found_trie(spark, rows) == trie(rows)
    assert found_trie(spark, [(None, 1, "user", "lost")]) == []


def test_very_common_conversation_and_first_turn(spark):
    rows = [(c, t, "user", f"copy {t}") for c in range(0, 300, 2) for t in range(5)]
    rows += [(c, t, "user", "hello" if t == 0 else f"{c} {t}") for c in range(1, 300, 2) for t in range(3)]
    assert found_trie(spark, rows) == trie(rows)


# --- languages ------------------------------------------------------------

def tongue(rng, letters, n):
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randrange(1, 8))) for _ in range(n))


def texts(n, seed=3):
    rng = random.Random(seed)
    alphabets = {"xa": "aaaeeinst", "xb": "ooouurrlm", "xc": "aeouinßéç"}
    return [(i, tongue(rng, alphabets[lang], rng.randrange(3, 30)), lang) for i, lang in
            ((i, rng.choice(list(alphabets))) for i in range(n))]


def documents(spark, rows):
    names = "code string, gram string, sums string, letters string, rest string, chars string, held_out string"
    return spark.createDataFrame([(*r, *["clash"] * 7) for r in rows], f"doc_id long, text string, lang string, {names}").repartition(3)


def kneser_ney(rows, order=language_id.ORDER):
    """Probability functions by language, straight from the definition."""
    def sentences(text):
        return [" " * (order - 1) + w + " " for w in "".join(c if c.isalpha() else " " for c in text.lower()).split()]

    counts = defaultdict(Counter)
    for i, text, lang in rows:
        if zlib.crc32(str(i).encode()) % 3 != 1 and lang:
            for s in sentences(text or ""):
                counts[lang].update(s[j - order:j] for j in range(order, len(s) + 1))
    alphabet = {g[-1] for c in counts.values() for g in c}

    def model(top):
        levels = {order: top}
        for n in range(order - 1, 0, -1):
            levels[n] = Counter(g[1:] for g in levels[n + 1])
        contexts = {n: defaultdict(lambda: [0, 0]) for n in levels}
        discounts = {}
        for n, c in levels.items():
            ones, twos = (sum(v == k for v in c.values()) for k in (1, 2))
            discounts[n] = min(0.95, max(0.05, ones / (ones + 2 * twos))) if ones else 0.5
            for g, v in c.items():
                contexts[n][g[:-1]][0] += v
                contexts[n][g[:-1]][1] += 1

        def p(g):
            if not g:
                return 1 / (len(alphabet) + 1)
            total, kinds = contexts[len(g)].get(g[:-1], (0, 0))
            if not total:
                return p(g[1:])
            discount = discounts[len(g)]
            return (max(levels[len(g)].get(g, 0) - discount, 0) + discount * kinds * p(g[1:])) / total
        return p

    models = {lang: model(top) for lang, top in counts.items()}

    def entropies(text):
        grams = [s[j - order:j] for s in sentences(text) for j in range(order, len(s) + 1)]
        return {lang: -sum(math.log2(p(g)) for g in grams) / max(1, len(grams)) for lang, p in models.items()}
    return entropies


@pytest.mark.parametrize("part_bytes", [language_id.PART_BYTES, 20_000])
def test_language_models_equal_the_definition(spark, part_bytes, monkeypatch):
    monkeypatch.setattr(language_id, "PART_BYTES", part_bytes)
    rows = texts(120)
    rows += [rows[1], rows[1]]
    want = kneser_ney(rows)
    found = language_id.identify_languages(documents(spark, rows)).collect()
    assert len(found) == len(rows)
    of = {i: text for i, text, _ in rows}
    for r in found:
        h = want(of[r["doc_id"]])
        assert r["entropy"] == pytest.approx(min(h.values()), abs=1e-4)
        assert h[r["lang_pred"]] == pytest.approx(min(h.values()), abs=1e-4)
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)


def test_held_out_languages_and_label_blindness(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang", "source")
    found = language_id.identify_languages(docs)
    right = found.join(docs.select("doc_id", "lang"), "doc_id").where("held_out") \
        .agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")).alias("r")).first()["r"]
    assert right >= 0.98
    hidden = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit("zz")).otherwise(F.col("lang"))
    blind = language_id.identify_languages(docs.withColumn("lang", hidden))
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, blind.collect()))


def test_language_defined_cases(spark, odd_docs, no_docs):
    rows = texts(60) + [(1001, None, "xa"), (1002, "", "xb"), (1003, "12 34 !?", "xc"), (None, "aeni sata", "xa"), (1004, "w" * 300_000, None),
                        (1005, "日本語 и кириллица", None), (1006, "́́", "xa")]
    found = {r["doc_id"]: r for r in language_id.identify_languages(documents(spark, rows)).collect()}
    assert len(found) == 67
    for i in (1001, 1002, 1003, 1006):
        assert (found[i]["lang_pred"], found[i]["score"], found[i]["accepted"]) == ("und", 0.0, False)
    assert found[None]["held_out"] is False
    assert found[1004]["lang_pred"] in {"xa", "xb", "xc"} and found[1005]["lang_pred"] in {"xa", "xb", "xc"}
    assert all(0 <= r["score"] <= 1 for r in found.values())
    assert language_id.identify_languages(odd_docs).count() == odd_docs.count()
    assert language_id.identify_languages(no_docs).count() == 0
    unlabelled = language_id.identify_languages(documents(spark, [(1, "some text", None), (2, "more", None)])).collect()
    assert {(r["lang_pred"], r["score"]) for r in unlabelled} == {("und", 0.0)}
    one = language_id.identify_languages(documents(spark, [(i, "only one", "xa") for i in range(40)])).collect()
    assert {r["lang_pred"] for r in one} == {"xa"}


def test_shares_rise_and_pool():
    found = language_id.rising_shares([(0, 40, 10), (1, 40, 30), (2, 40, 20), (3, 5, 5), (4, 40, 40)])
    assert [b for b, _ in found] == sorted(b for b, _ in found)
    assert [s for _, s in found] == sorted(s for _, s in found)
    assert language_id.rising_shares([]) == []
