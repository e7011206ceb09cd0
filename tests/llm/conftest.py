import random

import pytest

WORDS = "the of and model data token river stone bright quick under seven éclair über niño 東京 x1 y2".split()


@pytest.fixture(scope="session")
def shipped(spark):
    from confluo.session import ship

    ship(spark)
    return spark


@pytest.fixture
def rng():
    return random.Random(20)


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", ",", ".", "\n"]) for _ in range(n))


#: Null, empty, blank and odd texts, a very long one, and rows that occur twice.
ODD = [None, "", " \n\t ", "a", "word", "ÀÉ ß ſ K", "\x00 \x1f    ", "AKIA" + "A" * 30, "<|endoftext|> x", "x" * 5000, "a b " * 3000, "same text here", "same text here", "🙂 🙂🙂 done"]


@pytest.fixture
def odd(spark):
    rows = [(i, t, "en" if i % 3 else None, None if i % 4 == 0 else "s", len(t or "")) for i, t in enumerate(ODD)] + [(None, "null id", None, None, 7), (11, "same text here", "en", "s", 14)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


@pytest.fixture
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


def documents(spark, texts, lang="en"):
    return spark.createDataFrame([(i, t, lang, "s", len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
