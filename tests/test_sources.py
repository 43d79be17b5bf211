"""Golden tests for the sources that have no SQL oracle."""

import json
import sqlite3
import tempfile

from lanternqa.sources import documents, jsonl, sqlite

from .conftest import SF001


def test_sqlite_scan_matches_parquet(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet").select("doc_id", "text")
    d = tempfile.mkdtemp(prefix="lq-sqlite-")
    path = f"{d}/docs.db"
    con = sqlite3.connect(path)
    con.execute("CREATE TABLE documents (id TEXT PRIMARY KEY, text TEXT)")
    con.executemany("INSERT INTO documents VALUES (?, ?)",
                    [(str(r.doc_id), r.text) for r in docs.toLocalIterator()])
    con.commit()
    con.close()
    sqlite.register(spark)
    got = spark.read.format("sqlite_docs").option("path", path).option("numPartitions", "4").load()
    assert got.count() == docs.count()
    expected = docs.selectExpr("cast(doc_id as string) as id", "text")
    assert got.exceptAll(expected).count() == 0


def test_line_ids_follow_file_order(spark):
    d = tempfile.mkdtemp(prefix="lq-lines-")
    with open(f"{d}/q.jsonl", "w") as f:
        for i in range(50):
            f.write(json.dumps({"question": f"q{i}", "answer": [f"a{i}"]}) + "\n")
    got = jsonl.read_questions(spark, f"{d}/q.jsonl").orderBy("query_id").collect()
    assert [r.question for r in got] == [f"q{i}" for i in range(50)]
    assert [r.query_id for r in got] == list(range(50))


def test_entity_map_scan(spark):
    d = tempfile.mkdtemp(prefix="lq-map-")
    with open(f"{d}/map.json", "w") as f:
        json.dump({"1": "E1", "20": "E3"}, f)
    got = sorted(tuple(r) for r in jsonl.read_entity_map(spark, f"{d}/map.json").collect())
    assert got == [("1", "E1"), ("20", "E3")]


def test_entity_map_over_many_lines(spark, tmp_path):
    rows = [(str(i), f"E{i % 5}") for i in range(500)]
    jsonl.write_entity_map(spark.createDataFrame(rows, "key string, value string").repartition(4), f"{tmp_path}/map")
    assert sorted(tuple(r) for r in jsonl.read_entity_map(spark, f"{tmp_path}/map", lines=True).collect()) == sorted(rows)


def test_line_ids_over_many_files_and_empty_ones(spark, tmp_path):
    for n in range(4):
        (tmp_path / f"part-{n}.txt").write_text("".join(f"{n}:{i}\n" for i in range(n * 3)))
    got = jsonl.with_line_ids(spark, str(tmp_path)).orderBy("query_id").collect()
    assert [r.value for r in got] == [f"{n}:{i}" for n in range(4) for i in range(n * 3)]
    assert [r.query_id for r in got] == list(range(18))
    (tmp_path / "empty").mkdir()
    (tmp_path / "empty" / "e.txt").write_text("")
    assert jsonl.with_line_ids(spark, f"{tmp_path}/empty").count() == 0
    assert jsonl.read_questions(spark, f"{tmp_path}/empty").count() == 0


def test_files_without_question_ids(spark, tmp_path):
    """The exchanged formats: no ids, text document ids, one JSON array per line, empty lists."""
    (tmp_path / "x.pdocs").write_text(json.dumps({"query": "a", "doc_ids": ["Doc A", "7"], "doc_scores": [2.5, 1.0]}) + "\n"
                                      + json.dumps({"query": "b", "doc_ids": [], "doc_scores": []}) + "\n")
    assert [tuple(r) for r in jsonl.read_pdocs(spark, f"{tmp_path}/x.pdocs").orderBy("query_id", "rank").collect()] == \
        [(0, 1, "Doc A", 2.5), (0, 2, "7", 1.0)]
    assert jsonl.read_pdocs_lists(spark, f"{tmp_path}/x.pdocs").count() == 2
    pred = {"query": "a", "span": "s", "score": 1.5, "docs": ["Doc A"], "start_idx": [3], "end_idx": [4]}
    (tmp_path / "x.preds").write_text(json.dumps([pred]) + "\n[]\n" + json.dumps([pred, pred]) + "\n")
    got = jsonl.read_preds(spark, f"{tmp_path}/x.preds").orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.rank, r.docs) for r in got] == [(0, 1, ["Doc A"]), (2, 1, ["Doc A"]), (2, 2, ["Doc A"])]
    assert jsonl.read_preds_lists(spark, f"{tmp_path}/x.preds").count() == 3
    (tmp_path / "x.ents").write_text('{"entities": ["Q1", ""]}\n{"entities": []}\n')
    assert [tuple(r) for r in jsonl.read_entities(spark, f"{tmp_path}/x.ents").collect()] == [(0, 1, "Q1"), (0, 2, "")]
    assert jsonl.read_entities_lists(spark, f"{tmp_path}/x.ents").count() == 2


def test_empty_lists_survive_writing(spark, tmp_path):
    questions = spark.createDataFrame([(5, "a"), (9, "b"), (7, "c")], "query_id long, question string")
    retrieved = spark.createDataFrame([(9, 2, 4, 1.0), (9, 1, 8, 2.0)], "query_id long, rank long, doc_id long, score double")
    jsonl.write_pdocs(retrieved, questions, f"{tmp_path}/p")
    lists = jsonl.read_pdocs_lists(spark, f"{tmp_path}/p").orderBy("query_id").collect()
    assert [(r.query, r.doc_ids) for r in lists] == [("a", []), ("c", []), ("b", ["8", "4"])]
    spans = spark.createDataFrame([], "query_id long, rank long, span string, score double, docs array<string>, "
                                  "start_idx array<long>, end_idx array<long>")
    jsonl.write_preds(spans, questions, f"{tmp_path}/s")
    assert [r.value for r in spark.read.text(f"{tmp_path}/s").collect()] == ["[]"] * 3
    entities = spark.createDataFrame([(7, 1, "Q")], "query_id long, rank long, entity string")
    jsonl.write_entities(entities, f"{tmp_path}/e", questions)
    assert [r.entities for r in jsonl.read_entities_lists(spark, f"{tmp_path}/e").orderBy("query_id").collect()] == [[], ["Q"], []]


def test_texts_by_decomposed_ids(spark):
    """Ids are looked up in decomposed form; unknown ids keep a NULL text and are reported."""
    docs = spark.createDataFrame([("e\u0301a", "found"), ("b", "plain")], "doc_id string, text string")
    ids = spark.createDataFrame([("\u00e9a",), ("b",), ("x",)], "doc_id string")
    got = {r.doc_id: r.text for r in documents.fetch_text(ids, docs, normalize_ids=True).collect()}
    assert got == {"\u00e9a": "found", "b": "plain", "x": None}
    assert [r.doc_id for r in documents.missing_ids(ids.where("doc_id <> '\u00e9a'"), docs).collect()] == ["x"]
