"""Operators 1 and 3 against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash

from lanternqa.llm import line_dedup as ld
from lanternqa.llm import simhash as sh
from lanternqa.llm.components import connected_components

from .conftest import sentence

WHITE = " \t\n\x0b\x0c\r"


def lower(s):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in s)


def brute_lines(docs, min_chars=40, min_docs=5):
    holders = {}
    for i, t in docs:
        for line in (t or "").split("\n"):
            key = lower(line.strip(WHITE))
            if len(key) >= min_chars:
                holders.setdefault(key, set()).add(i)
    keeper = {k: max((i for i in v if i is not None), default=None) for k, v in holders.items() if len(v) >= min_docs}
    out = []
    for i, t in docs:
        lines = (t or "").split("\n")
        kept = [x for x in lines if (k := lower(x.strip(WHITE))) not in keeper or keeper[k] == i]
        out.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def test_lines_match_brute_force(spark, odd_docs, no_docs):
    docs = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    got = sorted((tuple(r) for r in ld.dedup_lines(odd_docs, with_text=False).collect()), key=str)
    assert got == brute_lines(docs)
    assert sum(r[2] for r in got) > 5
    assert ld.dedup_lines(no_docs).count() == 0
    cleaned = ld.deduplicated_documents(odd_docs)
    assert cleaned.columns == odd_docs.columns
    texts = {(r["doc_id"], hashlib.sha256((r["text"] or "").encode()).hexdigest()) for r in cleaned.collect()}
    assert texts == {(r[0], r[3]) for r in got}
    assert cleaned.where("text is null").count() == odd_docs.where("text is null").count()


def test_a_full_filter_changes_nothing(spark, odd_docs, monkeypatch):
    docs = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    everything = ld.lost_lines(ld.id_and_text(odd_docs), twice_bits=1 << 12)  # so small that it fills up
    want = {i for i, _, gone, _ in brute_lines(docs) if gone}
    assert {r["doc_id"] for r in everything.collect()} == want


def test_null_ids_count_as_one_document(spark):
    line = "a line that is long enough to be counted as a passage"
    docs = spark.createDataFrame([(None, line)] * 5 + [(1, line), (2, line), (3, line)], "doc_id long, text string")
    assert ld.dedup_lines(docs).agg({"n_dropped": "sum"}).first()[0] == 0
    docs = docs.unionByName(spark.createDataFrame([(4, line)], "doc_id long, text string"))
    got = ld.dedup_lines(docs)
    assert got.where("n_dropped = 0").select("doc_id").collect()[0][0] == 4
    assert got.agg({"n_dropped": "sum"}).first()[0] == 8


def brute_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", lower(text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(prints):
    ids = [i for i, _ in prints]
    parent = {i: i for i in ids}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for n, (i, a) in enumerate(prints):
        for j, b in prints[:n]:
            if bin(a ^ b).count("1") <= 2:
                x, y = sorted((find(i), find(j)))
                parent[y] = x
    return {i: find(i) for i in ids}


def test_fingerprints_and_components_match_brute_force(spark, odd_docs, no_docs):
    docs = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    want = {(i, f"{brute_print(t):016x}") for i, t in docs}
    got = sh.near_duplicates(odd_docs).collect()
    assert len(got) == len(docs) and {(r["doc_id"], r["fingerprint"]) for r in got} == want
    groups = brute_components(sorted({(i, brute_print(t)) for i, t in docs if i is not None}))
    assert {r["doc_id"]: r["component_id"] for r in got} == {**groups, None: None}
    assert sh.near_duplicates(no_docs).count() == 0


def test_spark_xxhash64_agrees(spark):
    from pyspark.sql import functions as F
    df = spark.createDataFrame([("ab é",), ("",), ("x" * 100,)], "t string")
    for r in df.select("t", F.xxhash64("t").alias("h")).collect():
        assert r["h"] % (1 << 64) == xxhash.xxh64_intdigest(r["t"].encode(), seed=42)


@pytest.mark.parametrize("max_bits", [1, 2, 3])
def test_links_of_random_fingerprints(spark, max_bits):
    rng = random.Random(max_bits)
    prints = {rng.getrandbits(64) for _ in range(40)}
    for p in list(prints):  # chains, dense balls and far ones
        for _ in range(rng.randrange(30)):
            for _ in range(rng.randrange(1, max_bits + 2)):
                p ^= 1 << rng.randrange(64)
            prints.add(p)
    hub = rng.getrandbits(64)
    prints |= {hub ^ (1 << a) ^ (1 << b) for a in range(16) for b in range(16)}
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    links = sh.similar_links(spark.createDataFrame([(p,) for p in signed], "fp long"), max_bits)
    comp = {r["node"]: r["component"] for r in connected_components(links).collect()}
    parent = {p: p for p in signed}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    raw = np.array(signed, dtype=np.int64).view(np.uint64)
    for i, p in enumerate(signed):
        for j in np.flatnonzero(np.bitwise_count(raw[:i] ^ raw[i]) <= max_bits):
            x, y = sorted((find(p), find(signed[j])))
            parent[y] = x
    for p in signed:
        assert comp.get(p, p) == find(p)


def test_components_of_a_long_chain_and_a_hub(spark):
    links = [(i, i + 1) for i in range(60)] + [(1000, j) for j in range(1001, 1400)] + [(5, 5), (2, 1)]
    got = {r["node"]: r["component"] for r in
           connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{j: 1000 for j in range(1000, 1400)}}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_one_document_of_each_group_stays(spark, odd_docs):
    groups = sh.near_duplicates(odd_docs)
    kept = sh.first_of_each_group(odd_docs, groups)
    assert kept.columns == odd_docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    want = {r["component_id"] for r in groups.collect() if r["doc_id"] is not None}
    assert sorted(i for i in ids if i is not None) == sorted(want)
    assert ids.count(None) == 2


def test_near_copies_meet(spark):
    rng = random.Random(9)
    base = [f"w{rng.randrange(5000)}" for _ in range(1500)]
    docs = [(0, " ".join(base))]
    for i in range(1, 30):
        copy = list(base)
        copy[rng.randrange(1500)] = "changed"
        docs.append((i, " ".join(copy)))
    docs += [(100 + i, sentence(rng, 300, 5000)) for i in range(30)]
    prints = [(i, brute_print(t)) for i, t in docs]
    got = sh.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == brute_components(prints)
