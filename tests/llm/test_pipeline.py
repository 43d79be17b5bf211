"""The pipeline's stages on odd rows, and run() against the stages by brute force."""

import pytest

import corpus_pipeline as cp
from lanternqa.llm import mixing, packing, queries

from .test_dedup import brute_components, brute_lines, brute_print
from .test_quality_url_secret import brute_measures

SF001 = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name, stage", cp.STAGES)
def test_stage_on_odd_rows(spark, odd_docs, no_docs, name, stage):
    out = stage(spark, odd_docs, "")
    assert out.count() > 0
    if (name, stage) != cp.STAGES[-1]:
        assert out.columns == odd_docs.columns and out.dtypes == odd_docs.dtypes
    assert stage(spark, no_docs, "").count() == 0


def brute_kept(text):
    n, chars, symbols, _, repeated, _, letters, capitals = brute_measures(text)
    return not (n < 50 or 100 * repeated > 50 * n or 100 * symbols > 10 * n or 100 * capitals > 30 * letters
                or chars < 2 * n or chars > 20 * n)


def test_run_matches_brute_force(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF001}/documents.parquet").collect()]
    docs = [(i, t) for i, t in docs if brute_kept(t)]
    gone = {i: n for i, _, n, _ in brute_lines(docs)}
    stage = spark.createDataFrame(docs, "doc_id long, text string")
    from lanternqa.llm import line_dedup
    lines = [(r["doc_id"], r["text"]) for r in line_dedup.deduplicated_documents(stage).collect()]
    assert sum(len((t or "").split("\n")) for _, t in lines) + sum(gone.values()) \
        == sum(len((t or "").split("\n")) for _, t in docs)
    groups = brute_components([(i, brute_print(t)) for i, t in lines])
    kept = [(i, t) for i, t in lines if groups[i] == i]
    source = {r["doc_id"]: r for r in spark.read.parquet(f"{SF001}/documents.parquet").collect()}
    sampled = mixing.mixed_documents(spark.createDataFrame(
        [(i, t, source[i]["lang"], source[i]["source"]) for i, t in kept],
        "doc_id long, text string, lang string, source string"))
    from tokenizers import Tokenizer
    tokenizer = Tokenizer.from_file(packing.vocabulary_path())
    want = {r["doc_id"]: 1 + len(tokenizer.encode(r["text"] or "", add_special_tokens=False).ids) for r in sampled.collect()}
    got: dict = {}
    for r in cp.run(spark, SF001).collect():
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + r["length"]
    assert got == want


def test_one_query_for_each_operator():
    numbers = sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES)
    assert numbers == list(range(1, 14))
    assert len(cp.STAGES) == 5 and cp.ORACLE_SQL is None
