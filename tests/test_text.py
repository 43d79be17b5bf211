"""Golden unit tests for the text operators (FIXTURES.md section 3)."""

import unicodedata

import pytest
import numpy as np
from pyspark.sql import functions as F

from lanternqa.functions import arrow, patterns
from lanternqa.functions import text as tx
from lanternqa.operators import tokens as tk


def one(spark, expr, value, schema="s string"):
    return spark.createDataFrame([(value,)], schema).select(expr.alias("out")).collect()[0][0]


def test_tokenize_splits_punctuation(spark):
    assert one(spark, tx.tokenize("s"), "Don't stop, 3.5%!") == \
        ["Don", "'", "t", "stop", ",", "3", ".", "5", "%", "!"]


def test_offsets_and_untokenize(spark):
    df = spark.createDataFrame([(1, "a  b\n")], "doc_id long, text string")
    out = [(r.start, r.end) for r in tk.token_offsets(df).orderBy("pos").collect()]
    assert out == [(0, 1), (3, 4)]
    df = spark.createDataFrame([(1, "ab  cd ef")], "doc_id long, text string")
    spans = tk.with_token_spans(df)
    got = spans.select(tk.untokenize(F.col("text"), F.col("toks"), F.lit(0), F.lit(2))).collect()[0][0]
    assert got == "ab  cd"


def test_empty_text_has_no_tokens_or_ngrams(spark):
    assert one(spark, tx.tokenize("s"), "") == []
    df = spark.createDataFrame([("",)], "s string").select(tx.words(tx.tokenize("s")).alias("w"))
    assert df.select(tx.ngrams("w", 2)).collect()[0][0] == []


def test_bigrams_order(spark):
    df = spark.createDataFrame([("x y z",)], "s string").select(tx.words(tx.tokenize("s")).alias("w"))
    assert df.select(tx.ngrams("w", 2)).collect()[0][0] == ["x", "x y", "y", "y z", "z"]


@pytest.mark.parametrize("gram,expected", [
    (["the", "cat"], {"any": True, "all": False, "ends": True}),
    (["cat", "of", "rome"], {"any": True, "all": False, "ends": False}),
])
def test_filter_modes(spark, gram, expected):
    df = spark.createDataFrame([(gram,)], "g array<string>")
    for mode, drop in expected.items():
        assert df.select(tx.filter_ngram(F.col("g"), mode)).collect()[0][0] == drop


def test_filter_word_symbols_and_punctuation(spark):
    df = spark.createDataFrame([(w,) for w in ["$", "`", "-", "..."]], "w string")
    got = dict(df.select("w", tx.is_filtered_word(F.col("w"))).collect())
    assert got == {"$": False, "`": False, "-": True, "...": True}


def test_invalid_filter_mode():
    with pytest.raises(ValueError):
        tx.filter_ngram(F.col("g"), "some")


def test_unigram_terms_equal_general_path(spark):
    text = "The cat, of Rome -- sat; don't 'll!"
    df = spark.createDataFrame([(text,)], "s string")
    fast = df.select(tx.unigram_terms("s")).collect()[0][0]
    general = df.select(tx.ngrams(tx.words(tx.tokenize("s"), uncased=True), 1,
                                  filter_fn=lambda g: tx.filter_ngram(g, "any"))).collect()[0][0]
    assert fast == general == ["cat", "rome", "sat"]


def test_term_frequencies_in_row(spark):
    df = spark.createDataFrame([(1, ["b", "a", "b", "c", "b"]), (2, [])], "doc_id long, terms array<string>")
    got = sorted(tuple(r) for r in tx.term_frequencies(df, "terms").collect())
    assert got == [(1, "a", 1), (1, "b", 3), (1, "c", 1)]


def test_normalize_answer(spark):
    assert one(spark, tx.normalize_answer("s"), "The  U.S. Army!") == "us army"


def test_nfd_article_with_combining_mark(spark):
    s = unicodedata.normalize("NFD", "à la")
    got = one(spark, tx.normalize_answer(arrow.nfd(F.col("s"))), s)
    assert got == "̀ la"


def test_strip_whitespace(spark):
    assert one(spark, tx.strip_whitespace("s"), " a b\tc\n") == "abc"


def test_murmur3_seed0():
    rows = np.frombuffer(b"foobar", dtype=np.uint8).reshape(2, 3)
    assert arrow.murmur3_32(rows).tolist()[0] == 4138058784


def test_murmur3_of_a_column(spark):
    got = spark.createDataFrame([("foo",), ("",), (None,), ("hello world!!",), ("abcdefgé",)], "s string") \
        .select("s", arrow.murmur3_unsigned("s").alias("h")).collect()
    assert {r["s"]: r["h"] for r in got} == {"foo": 4138058784, "": 0, None: None, "hello world!!": 3804944959,
                                             "abcdefgé": 881327236}


def test_unigrams_lower_each_token_by_itself(spark):
    # the sigma ends its token, whatever follows the dot
    got = one(spark, tx.parse_terms("s"), "ΟΔΟΣ.ΑΒΓ")
    want = one(spark, tx.words(tx.tokenize("s"), uncased=True), "ΟΔΟΣ.ΑΒΓ")
    assert got == [w for w in want if w != "."] and got[0].endswith("ς")


def test_regex_dialect():
    assert patterns.java_pattern("(?=x)") is None
    assert patterns.java_pattern(r"\p{L}+.") == r"\p{L}+[^\n]"
    assert patterns.java_pattern("(?P<a_b>1|2)?$") == r"(?:[\x{31}]|[\x{32}])?(?![^\n])"
    assert patterns.java_pattern(r"(?P<a_b>red)-(?P=a_b)") is None


def test_contains_token_run(spark):
    df = spark.createDataFrame([(["a", "party", "b"], ["art"]), (["x"], []), (["a", "b", "c"], ["b", "c"])],
                               "d array<string>, a array<string>")
    assert [r[0] for r in df.select(tx.contains_token_run(F.col("d"), F.col("a"))).collect()] == \
        [False, True, True]


def test_stored_annotations(spark):
    df = spark.createDataFrame([(1, "New York is big.", ["ENT", "ENT", "O", "O", "O"]), (2, "No tags", None)],
                               "doc_id long, text string, ner array<string>")
    got = {r.doc_id: r for r in tk.stored_annotations(df).collect()}
    assert got[1].ner_tags == ["ENT", "ENT", "O", "O", "O"] and got[1].pos_tags is None and got[2].ner_tags is None
    groups = [(r.doc_id, r.text, r.tag) for r in tk.entity_groups(df, tags_col="ner").collect()]
    assert groups == [(1, "New York", "ENT")]
    with pytest.raises(Exception, match="not one value per token"):
        tk.stored_annotations(df.withColumn("ner", F.array(F.lit("O")))).collect()


def test_entity_groups(spark):
    df = spark.createDataFrame([(1, "New York is in the United States.")], "doc_id long, text string")
    from lanternqa.plans.fixtures import fixture_ner_tag
    got = [(r.text, r.tag) for r in tk.entity_groups(df, fixture_ner_tag).orderBy("group_idx").collect()]
    assert got == [("New York", "ENT"), ("United States", "ENT")]
