"""One JSON object, read in byte ranges of any size, is what Python's parser makes of it."""

import json
import random

import pytest
from pyspark.sql import functions as F

from lanternqa.sources import json_object as jo


def members(n, seed=1):
    rng = random.Random(seed)
    odd = ['a,b', 'quote " inside', 'back\\slash\\', '\\",', '{', '}', '[1, 2]', '": "', '', ' ', 'é𝄞', '\n\t', ',,,,"', "x" * 500]
    return {f"{i}{rng.choice(odd)}": rng.choice(odd) * rng.randrange(1, 3) for i in range(n)}


@pytest.fixture
def split_bytes(spark):
    keep = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.openCostInBytes", "1")

    def of(n):
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(n))
    yield of
    for k, v in keep.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("layout", [{}, {"indent": 2}, {"ensure_ascii": False, "separators": (",", ":")}])
def test_byte_ranges_find_the_members(spark, tmp_path, split_bytes, layout):
    want = members(400)
    (tmp_path / "map.json").write_text(json.dumps(want, **layout))
    size = (tmp_path / "map.json").stat().st_size
    for n in (size + 10, 3001, 517):
        split_bytes(n)
        read = jo.read_json_object(spark, f"{tmp_path}/map.json")
        assert {r.key: r.value for r in read.collect()} == want and read.count() == len(want)
    ranges = jo._pieces(spark, f"{tmp_path}/map.json").select("block").distinct().count()
    assert ranges > size / 1100


def test_written_as_one_object(spark, tmp_path, split_bytes):
    want = members(300, 2)
    rows = spark.createDataFrame(list(want.items()), "key string, value string").repartition(5)
    jo.write_json_object(rows, f"{tmp_path}/out")
    files = [p for p in (tmp_path / "out").iterdir() if p.name.startswith("part-")]
    assert len(files) == 1 and json.loads(files[0].read_text()) == want
    split_bytes(1000)
    assert {r.key: r.value for r in jo.read_json_object(spark, f"{tmp_path}/out").collect()} == want


def test_small_and_repeated(spark, tmp_path):
    cases = {"{}": {}, " { } ": {}, '{"a": "b"}': {"a": "b"}, '{"a": "1", "a": "2"}': {"a": "2"}, '{"a": 1, "b": null, "c": true}':
             {"a": "1", "b": None, "c": "true"}, '{"a": "[x", "b": "{y"}': {"a": "[x", "b": "{y"}}
    for n, (text, want) in enumerate(cases.items()):
        (tmp_path / f"{n}.json").write_text(text)
        assert {r.key: r.value for r in jo.read_json_object(spark, f"{tmp_path}/{n}.json").collect()} == want
    jo.write_json_object(spark.createDataFrame([], "key string, value string"), f"{tmp_path}/none")
    assert jo.read_json_object(spark, f"{tmp_path}/none").count() == 0


@pytest.mark.parametrize("text", ['["a", "b"]', '{"a": ["b", "c"]}', '{"a": {"b": "c"}}', '{"a": "b"', '{"a" "b"}', '{"a": "b",}'])
def test_other_text_raises(spark, tmp_path, text):
    (tmp_path / "x.json").write_text(text)
    with pytest.raises(Exception, match="not a member"):
        jo.read_json_object(spark, f"{tmp_path}/x.json").agg(F.count("key")).collect()
