"""Answer patterns: Java's hits equal those of the regex package, whatever the pattern."""

import random
import unicodedata

import pytest
import regex


from lanternqa.functions import patterns
from lanternqa.operators import evaluate as ev

FLAGS = regex.IGNORECASE | regex.UNICODE | regex.MULTILINE


def hits(spark, answer_patterns, text):
    questions = spark.createDataFrame([(i, [p]) for i, p in enumerate(answer_patterns)], "query_id long, answer array<string>")
    retrieved = questions.selectExpr("query_id", "1L as rank", "0L as doc_id")
    docs = spark.createDataFrame([(0, text)], "doc_id long, text string")
    found = ev.answer_hits(retrieved, docs, questions, match="regex", unicode_form=None)
    return [r.hit for r in found.orderBy("query_id").collect()]


def expected(pattern, text):
    try:
        return regex.compile(pattern, FLAGS).search(text) is not None
    except regex.error:
        return False


MIXED = [
    "a{b", "[[]x", r"(?<my_name>t)ext", r"\mtext", "(?|(a)|(t))ext", "(", "*a", "a**", "", "^", "$", "^$", r"\bx\b", "x++y", "(?i)TEXT",
    r"(t)e\1", r"(?P<n>t)e.(?P=n)", r"(?<=te)xt", "(?:te|xt){2}", "(te|xt)*!", "[a-c&&b]", "[^a-z]+$", "^the end$", r"\p{Lu}", r"\p{M}",
    r"[\p{M}]", r"\p{L}+ \p{N}", "a{,2}b", "a{2,1}", "[b-A]", "x{0}", "te??xt", r"\.", r"\N{DIGIT ONE}", r"\X", "straße", "STRASSE", "ſ",
    "ı", "İ", "i", "K", "k", "(?x) t e x t", "#", " ", "text\nthe end", r"text\nthe", r"t.xt", r"t[\-\]e]xt", "(?>te)xt", "x{1,3}{2}",
    "(((((t)))))", "(?s:t.*d)", "|", "a|", "(?!)", "(?#c)text", r"[[:alpha:]]+", r"[\w--[a-z]]", r"\d", r"\s", "text" * 300]


def test_every_dialect_form_gives_the_package_s_answer(spark):
    text = "Some text a{b [x\nthe END\nstraße K ſ ı İ 1 te?xt tet x text te.xt"
    assert hits(spark, MIXED, text) == [expected(p, text) for p in MIXED]
    forms = {p: patterns.java_pattern(p) for p in MIXED if expected(p, "") is not None}
    assert forms["(?:te|xt){2}"] and forms["straße"] and forms["[^a-z]+$"]  # carried over
    assert not any(forms[p] for p in ("a{b", "[[]x", r"\mtext", r"(t)e\1", "(te|xt)*!", "x++y", r"\bx\b", r"\p{M}", "text" * 300))


def random_pattern(rng, depth=2):
    letters = ["a", "B", "i", "k", "s", "ß", "é", "ı", "Σ", "ς", " ", "1", r"\.", "_", "ͅ", "Ⅷ", r"\n", "."]
    parts = []
    for _ in range(rng.randrange(1, 4)):
        atom = rng.choice([*letters, "[ab]", "[^a-c]", "[i-k1]", r"[\p{L}\p{M}]", r"[^\p{N}\p{Z}]", r"\p{L}", r"\p{P}", "^", "$"]
                          + (["(" + random_pattern(rng, depth - 1) + ")"] * 3 if depth else []))
        parts.append(atom + rng.choice(["", "", "", "?", "+", "*", "{1,2}", "+?", "{2}"]))
    return "".join(parts) + ("|" + random_pattern(rng, depth - 1) if depth and rng.random() < 0.3 else "")


def test_random_patterns_agree(spark):
    rng = random.Random(11)
    found = [p for p in (random_pattern(rng) for _ in range(1500))]
    alphabet = "aAbBiIıİkKKsSſßẞéÉΣσς 1._\nⅧⅷͅιΙ\U0001e4d0"  # the last: assigned after Java's Unicode version
    for _ in range(3):
        text = "".join(rng.choice(alphabet) for _ in range(12))
        got = hits(spark, found, text)
        wrong = [(p, text, g) for p, g in zip(found, got, strict=True) if g != expected(p, text)]
        assert not wrong
    assert sum(patterns.java_pattern(p) is not None for p in found if expected(p, "") is not None) > 300


@pytest.mark.parametrize("letters", ["ikstafßéσµǆΐ"])
def test_case_variants_are_complete(letters):
    """Against every character there is; texts with later ones never go to Java."""
    points = [chr(i) for i in range(0x110000) if unicodedata.category(chr(i)) not in ("Cn", "Cs")]
    for c in letters:
        literal = regex.compile(c, FLAGS)
        assert list(patterns.case_variants(c)) == [v for v in points if literal.fullmatch(v)]


def test_only_rows_of_the_package_send_their_text(spark):
    questions = spark.createDataFrame([(0, ["te.t"]), (1, [r"\bte"])], "query_id long, answer array<string>")
    retrieved = questions.selectExpr("query_id", "1L as rank", "0L as doc_id")
    docs = spark.createDataFrame([(0, "text")], "doc_id long, text string")
    plan = ev.answer_hits(retrieved, docs, questions, match="regex", unicode_form=None)._jdf.queryExecution().optimizedPlan().toString()
    # both arguments of the UDF are NULL where Java answers
    call = plan[plan.index("regex_found("):].split("\n")[0]
    assert call.count("CASE WHEN (coalesce(valid") == 2 and "RLIKE(CASE WHEN (isnotnull(java" in plan
