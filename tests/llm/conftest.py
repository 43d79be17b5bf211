import random

import pytest

COLUMNS = ("doc_id long, text string, lang string, source string, n_chars long, key string, h string, fp string, "
           "component string, shard string, slot string, size string, failures string, kept string, topic string, "
           "tokens string, weight string, probability string, length string, sequence_id string, spans string, "
           "lost string, score string, held_out string, node string, tie string, toxic string")


def sentence(rng: random.Random, n: int, words: int = 400) -> str:
    return " ".join(f"w{rng.randrange(words)}" for _ in range(n))


def odd_texts() -> list[tuple[int | None, str | None]]:
    """Null and empty texts and ids, white space, repeated rows, copies, near copies, one very long text."""
    rng = random.Random(5)
    base = sentence(rng, 300)
    shared = "This very line is shared by a number of documents, Really."
    texts: list[tuple[int | None, str | None]] = [
        (1, None), (2, ""), (3, "   \n\t\n"), (4, "one"), (5, "one two"), (6, "One  two\tthree"),
        (None, base), (None, None), (7, base), (7, base), (8, base), (9, base + " tail"), (10, "é" * 50),
        (11, "\x1c odd\u00a0space \u2003x \x85 <|endoftext|> naïve Straße İ K"), (12, sentence(rng, 60_000, 30_000)),
        (2**40, sentence(rng, 500) + "\r\n" + "\x0b\x0c"), (-3, "negative id " * 30)]
    for i in range(20, 28):
        texts.append((i, f"{sentence(rng, 40)}\n  {shared.upper() if i % 2 else shared} \t\n{sentence(rng, 30)}"))
    texts += [(30, f"{shared}\n{shared}\nshort"), (31, "x" * 39 + "\n" + "y" * 40)]
    texts += [(40 + i, f"{'y' * 40}\n{sentence(rng, 80)}") for i in range(5)]
    return texts


@pytest.fixture(scope="session")
def odd_docs(spark):
    """``documents`` of odd rows, with extra columns named like the operators' own."""
    rows = [(i, t, ["en", None, "de", ""][n % 4], ["a", "a", None, "b"][n % 4], n) + ("clash",) * 22
            for n, (i, t) in enumerate(odd_texts())]
    assert len(rows[0]) == len(COLUMNS.split(","))
    return spark.createDataFrame(rows, COLUMNS).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], COLUMNS)
