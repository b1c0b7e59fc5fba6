import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def awkward(spark):
    """Nulls in every column, empty, blank and very long texts, ties, repeated rows, letters of many scripts."""
    long_text = "word " * 60_000
    rows = [
        (1, "The quick brown fox jumps over the lazy dog again", "en", "a"), (1, "The quick brown fox jumps over the lazy dog again", "en", "a"),
        (2, None, "en", "a"), (3, "", None, None), (4, " \t\n ", "fr", "b"), (None, "no id here at all, none", "fr", "b"), (None, None, None, None),
        (5, long_text, "en", "b"), (6, "x" * 100_000, None, "c"), (7, "é ü ß 漢字 😀 \u0301 \x00 end", "de", "c"), (8, "!!! ??? ...", "de", None), (9, "12345", "es", "d"), (10, "a b c", "es", "d"),
        (11, "The quick brown fox jumps over the lazy dog again", "en", "e"), (10, "another text under the same number", "es", "d"),
    ]
    return spark.createDataFrame([(*r, None if r[1] is None else len(r[1])) for r in rows], DOCS)


@pytest.fixture(scope="session")
def clashing(awkward):
    """The same with columns named like results and helpers."""
    from pyspark.sql import functions as F

    names = ["id", "score", "held_out", "predicted", "size", "taken", "target", "rank", "start", "base", "key", "class", "bands", "task", "word", "n", "n_tokens", "feature", "component_id", "kept", "verdict", "host"]
    return awkward.select("*", *[F.lit(k).alias(n) for k, n in enumerate(names)])


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture()
def rng():
    return random.Random(5)


def rows(df):
    return [tuple(r) for r in df.collect()]
