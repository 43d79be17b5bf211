"""Segments, deletions and versions of the term index; retrieval by parts and by bounds."""

import random

import pytest
from pyspark.sql import functions as F

from lanternqa.operators import index as ix
from lanternqa.operators import pruned as pr
from lanternqa.operators import retrieve as rt
from lanternqa.sources import segments as sg


def corpus(spark, n=120, seed=1, first=0):
    rng = random.Random(seed)
    texts = [" ".join(f"w{int(rng.paretovariate(0.7)) % 60}" for _ in range(rng.randrange(0, 25))) for _ in range(n)]
    rows = [(first + i, t) for i, t in enumerate(texts)] + [(first + n, None), (first + n + 1, ""), (first + n + 2, "the of")]
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(3)


def tables(index):
    kept = [index.postings.select("doc_id", "term", "tf", "dl"), index.terms, index.docs]
    return [sorted(tuple(r) for r in t.collect()) for t in kept] + [(index.n, index.total)]


def fresh(spark, docs):
    index = ix.build_index(docs, unicode_form=None)
    return tables(ix.TermIndex(index.postings, index.docs, stored_terms=index.terms, n=docs.count(),
                               total=index.docs.agg(F.sum("dl")).first()[0] or 0))


def test_segments_and_deletions_equal_a_fresh_index(spark, tmp_path):
    one, two = corpus(spark, seed=1), corpus(spark, seed=2, first=1000)
    path = f"{tmp_path}/index"
    before = {t.name for t in spark.catalog.listTables()}
    first = sg.build_segments(one, path, unicode_form=None)
    assert tables(first) == fresh(spark, one)
    second = first.append(two)
    both = one.unionByName(two)
    assert tables(second) == fresh(spark, both)
    gone = both.where("doc_id % 3 = 0").select("doc_id").unionByName(spark.createDataFrame([(77_777,)], "doc_id long"))
    third = second.delete(gone)
    assert tables(third) == fresh(spark, both.where("doc_id % 3 <> 0"))
    again = third.delete(gone)  # nothing left to delete
    assert tables(again) == tables(third)
    back = again.append(both.where("doc_id % 3 = 0"))  # deleted ids may come back
    assert tables(back) == fresh(spark, both)
    packed = back.compact()
    assert tables(packed) == fresh(spark, both) and len(packed.manifest["segments"]) == 1
    # every version stays as it was
    assert tables(sg.open_index(spark, path, 1)) == fresh(spark, one)
    assert sg.open_index(spark, path).version == packed.version == 6
    with pytest.raises(RuntimeError, match="another writer"):
        third.append(two)
    assert {t.name for t in spark.catalog.listTables()} == before


def test_runs_across_batches_and_string_ids(spark, tmp_path):
    docs = corpus(spark).withColumn("doc_id", F.concat(F.lit("d"), F.col("doc_id").cast("string")))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        index = sg.build_segments(docs, f"{tmp_path}/index", unicode_form=None)
        assert tables(index) == fresh(spark, docs)
        assert index.blocks.groupBy("seg", "term", "range").count().where("count > 1").count() == 0
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")


def test_empty_index(spark, tmp_path):
    none = spark.createDataFrame([], "doc_id long, text string")
    for index in (sg.create_index(spark, f"{tmp_path}/a", 4), sg.build_segments(none, f"{tmp_path}/b")):
        assert tables(index) == [[], [], [], (0, 0)]
        questions = spark.createDataFrame([(1, "w1")], "query_id long, question string")
        assert pr.retrieve_terms(index, questions).count() == 0 == pr.retrieve_bounded(index, questions).count()


QUESTIONS = [(1, "w1 w2 w2 w30"), (2, "w5"), (3, "the of"), (4, "w7 w8 w9 w10 w11 w12"), (5, "unknown"), (6, "w41 w1")]


@pytest.mark.parametrize("ranker", rt.RANKERS)
def test_pruned_retrieval_equals_the_full_product(spark, tmp_path, monkeypatch, ranker):
    monkeypatch.setattr(sg, "RANGE_DOCS", 4)
    one, two = corpus(spark, 300, 3), corpus(spark, 200, 4, first=1000)
    index = sg.build_segments(one, f"{tmp_path}/index", unicode_form=None).append(two) \
        .delete(one.where("doc_id % 5 = 0"))
    questions = spark.createDataFrame(QUESTIONS, "query_id long, question string")
    plain = ix.build_index(one.where("doc_id % 5 <> 0").unionByName(two), unicode_form=None)
    for k in (1, 5, 1000):  # scores tie often; more than there are
        want = sorted(tuple(r) for r in rt.retrieve(plain, questions, k, ranker).collect())
        assert sorted(tuple(r) for r in pr.retrieve_terms(index, questions, k, ranker).collect()) == want
        assert sorted(tuple(r) for r in pr.retrieve_bounded(index, questions, k, ranker).collect()) == want
    report = pr.pruning_report(index, questions, 1, ranker).agg(F.sum("of_terms"), F.sum("scored")).first()
    assert report[1] < 0.8 * report[0]


def test_bounds_hold(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sg, "RANGE_DOCS", 16)
    index = sg.build_segments(corpus(spark, 300, 5), f"{tmp_path}/index", unicode_form=None)
    vectors = pr.question_vectors(index, spark.createDataFrame(QUESTIONS, "query_id long, question string"))
    ranges = index.exploded(index.blocks.where(F.col("part") == sg.DOCUMENTS_PART), "range").select("doc_id", "range")
    scores = pr.score_terms(index, vectors).join(ranges, "doc_id").groupBy("query_id", "range").agg(F.max("score").alias("best"))
    both = scores.join(pr.range_bounds(index, vectors), ["query_id", "range"])
    assert both.where("best > bound + 1e-9").count() == 0 and both.count() > 20


def leaves(plan):
    """The leaf nodes of a finished plan, below its query stages."""
    if plan.nodeName() == "AdaptiveSparkPlan":
        return leaves(plan.executedPlan())
    if "QueryStage" in plan.nodeName():
        return leaves(plan.plan())
    children = plan.children()
    found = [leaf for i in range(children.size()) for leaf in leaves(children.apply(i))]
    return found or [plan]


def test_only_the_parts_of_the_questions_are_read(spark, tmp_path):
    index = sg.build_segments(corpus(spark, 400, 6), f"{tmp_path}/index", parts=32, unicode_form=None)
    vectors = pr.question_vectors(index, spark.createDataFrame([(1, "w19 w23"), (2, "w23 w31")], "query_id long, question string"))
    top = rt.top_k(pr.score_terms(index, vectors), 5)
    assert top.count() and len(top.collect()) == 10
    done = top._jdf.queryExecution().executedPlan()
    text = done.toString()
    assert "dynamicpruning" in text and "WindowGroupLimit" in text and "Arrow" not in text
    scans = [leaf for leaf in leaves(done) if "max_tf" not in leaf.toString() and "docs" in leaf.toString() and "Scan" in leaf.nodeName()]
    files = index.blocks.select(F.input_file_name()).distinct().count()
    read = [int(s.metrics().get("numFiles").get().value()) for s in scans]
    assert len(read) == 1 and 0 < read[0] <= 3 < files


def test_a_hot_term_is_dealt_on(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sg, "RANGE_DOCS", 16)
    monkeypatch.setattr(sg, "SLAB_RANGES", 4)
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("hot").alias("text"))
    index = sg.build_segments(docs, f"{tmp_path}/index", unicode_form=None)
    hot = index.blocks.where("term = 'hot'")
    assert hot.agg(F.max("n")).first()[0] < 60  # ranges are small, whatever the term's frequency
    assert hot.select(F.input_file_name()).distinct().count() > 4


def test_a_task_has_so_many_documents(spark, tmp_path, monkeypatch):
    """Sums and blocks are dealt by the number of documents, whatever the session's number of partitions."""
    monkeypatch.setattr(sg, "DOCS_PER_TASK", 50)
    monkeypatch.setattr(pr, "DOCS_PER_TASK", 50)
    index = sg.build_segments(corpus(spark, 2000, 6), f"{tmp_path}/index", parts=16, unicode_form=None)
    vectors = pr.question_vectors(index, spark.createDataFrame([(1, "w19 w23"), (2, "w23 w31")], "query_id long, question string"))
    scores = pr.score_terms(index, vectors)
    assert scores.rdd.getNumPartitions() == -(-index.n // 50) >= 40
    plan = scores._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(query_id" not in plan and "doc_id" not in "".join(x for x in plan.splitlines() if "Exchange" in x)


def test_deletions_meet_blocks_not_postings(spark, tmp_path, monkeypatch):
    """Beyond the bytes of a broadcast, blocks are moved, not a row for every posting; results are the same."""
    docs = corpus(spark, 600, 6)
    built = sg.build_segments(docs, f"{tmp_path}/index", parts=16, unicode_form=None).delete(docs.where("doc_id % 3 = 0"))
    want = sg.build_segments(docs.where("doc_id % 3 <> 0"), f"{tmp_path}/want", parts=16, unicode_form=None)
    moved = docs.where("doc_id % 3 = 1")
    for fits in (True, False):
        monkeypatch.setattr(sg, "fits_broadcast", lambda *_: fits)
        got = sg.open_index(spark, built.path, 2)
        assert sorted(map(tuple, got.postings.collect())) == sorted(map(tuple, want.postings.collect()))
        assert sorted(map(tuple, got.terms.collect())) == sorted(map(tuple, want.terms.collect())) and got.n == want.n
    plan = got.postings._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate inline") < plan.index("CoGroup")  # read from the top: blocks meet deletions, then are exploded
    twice, wanted = got.delete(moved), want.delete(moved)
    assert sorted(map(tuple, twice.terms.collect())) == sorted(map(tuple, wanted.terms.collect())) and twice.n == wanted.n
    assert sorted(map(tuple, twice.postings.collect())) == sorted(map(tuple, wanted.postings.collect()))


def test_a_build_moves_blocks_not_postings(spark, tmp_path, monkeypatch):
    """A range's documents meet before they are parsed: what is dealt by term has a row for each term and range."""
    monkeypatch.setattr(sg, "RANGE_DOCS", 64)
    seen, real = [], sg.SegmentIndex._with_segment

    def watched(self, rows, *rest):
        seen.append(rows)
        return real(self, rows, *rest)

    monkeypatch.setattr(sg.SegmentIndex, "_with_segment", watched)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")  # ranges go on in the next batch
    try:
        docs = corpus(spark, 700, 6)
        docs = docs.unionByName(docs.where("doc_id % 7 = 0"))  # ids may repeat
        index = sg.build_segments(docs, f"{tmp_path}/index", unicode_form=None)
        assert tables(index.compact()) == tables(index) == fresh(spark, docs)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    assert "Generate" not in seen[0]._jdf.queryExecution().optimizedPlan().toString()
    blocks, postings = seen[0].count(), index.postings.count()
    assert blocks == index.blocks.count() == index.blocks.select("term", "range").distinct().count() < postings / 3


def test_a_build_moves_no_text_unless_a_partition_holds_most(spark, tmp_path, monkeypatch):
    seen, real = [], sg.SegmentIndex._with_segment

    def watched(self, rows, *rest):
        seen.append(rows._jdf.queryExecution().optimizedPlan().toString())
        return real(self, rows, *rest)

    monkeypatch.setattr(sg.SegmentIndex, "_with_segment", watched)
    monkeypatch.setattr(sg, "DOCS_PER_TASK", 40)
    spark.range(600).select(F.col("id").alias("doc_id"), F.expr("concat('w', id % 7, ' v', id % 13)").alias("text")) \
        .repartition(20).write.parquet(f"{tmp_path}/docs")
    docs = spark.read.parquet(f"{tmp_path}/docs")
    for rows, moved in ((spark.range(600, numPartitions=20).join(F.broadcast(docs), F.col("id") == F.col("doc_id")).drop("id"), False),
                        (docs.coalesce(1), True)):
        index = sg.build_segments(rows, f"{tmp_path}/{moved}", unicode_form=None)
        assert tables(index) == fresh(spark, docs)
        assert ("Repartition" in seen[-1].split("MapInArrow", 1)[1].replace("Repartition 1, false", "")) == moved


def test_rows_of_an_id_are_in_one_range(spark, tmp_path, monkeypatch):
    """Scores are added up within a range, so rows that repeat an id score as one document, wherever they lie."""
    monkeypatch.setattr(sg, "RANGE_DOCS", 8)
    docs = spark.createDataFrame([(None if i % 10 == 9 else i % 150, f"w{i % 7} v{i % 13}") for i in range(200)], "doc_id long, text string").repartition(5)
    index = sg.build_segments(docs, f"{tmp_path}/index", unicode_form=None)
    ids = index.exploded(index.blocks.where(F.col("part") == sg.DOCUMENTS_PART), "range").groupBy("doc_id")
    assert ids.agg(F.count_distinct("range").alias("n")).where("n > 1").count() == 0 and index.n == 200
    assert index.docs.where("doc_id IS NULL").count() == 20
    want = docs.select("doc_id", F.explode(F.split("text", " ")).alias("term"))
    got = index.postings.select("doc_id", "term")
    assert got.exceptAll(want).count() == 0 == want.exceptAll(got).count()


def test_deletions_are_sent_to_the_blocks(spark, tmp_path, monkeypatch):
    """Beyond a broadcast of rows, ids alone are sent, and no block is moved."""
    monkeypatch.setattr(sg, "fits_broadcast", lambda df, most=32 << 20: most > 32 << 20)
    for kind, step in (("long", 1), ("long", 1_000_003), ("string", 1)):  # ids that lie close, lie apart, aren't numbers
        one, two = (corpus(spark, 300, seed, first).withColumn("doc_id", (F.col("doc_id") * step).cast(kind)) for seed, first in ((6, 0), (7, 1000)))
        both = one.unionByName(two)
        gone = both.where("xxhash64(doc_id) % 3 = 0")
        index = sg.build_segments(one, f"{tmp_path}/{kind}-{step}", parts=16, unicode_form=None).append(two).delete(gone)
        assert tables(index) == fresh(spark, both.where("xxhash64(doc_id) % 3 <> 0"))
        plan = index.postings._jdf.queryExecution().optimizedPlan().toString()
        assert "MapInArrow" in plan and "CoGroup" not in plan and "Repartition" not in plan and "Join" not in plan


def test_a_build_leaves_no_shuffle_files(spark, tmp_path):
    def files():
        found = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {found.apply(i).getName() for i in range(found.size()) if found.apply(i).getName().startswith("shuffle_")}

    docs = spark.createDataFrame([(i, f"w{i % 7} v{i % 13}") for i in range(300)], "doc_id long, text string")
    before = files()
    index = sg.build_segments(docs, f"{tmp_path}/index", unicode_form=None).delete(docs.where("doc_id % 2 = 0").select("doc_id"))
    assert len(files() - before) <= 4 and index.n == 150  # of the two aggregates that are read by the driver
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"
