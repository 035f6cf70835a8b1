from __future__ import annotations

import pytest
from pyspark.sql import functions as F

#: The columns of documents, some whose names operators use inside, and such as these return.
COLUMNS = "text string, lang string, source string, n_chars long, id string, tree int, node string"
TAKEN = ["key", "copy", "score", "text_hash", "__key", "__copy", "__score", "of", "starts", "size", "each", "times", "n_hit", "words", "label", "n_lines_"]
SCHEMA = f"doc_id long, {COLUMNS}"
LONG = "word " * 40_000 + "end " + "x" * 70_000
#: Nulls, empty, blank and very long texts, repeated rows, a null id, and columns whose names the operators use inside.
ODD = [
    (1, None, None, None, None, "a", 1, "n"), (2, "", "en", "s", 0, None, None, None), (3, " \n\t ", "en", "s", 4, "c", 3, "n"), (4, LONG, "en", "s", len(LONG), "d", 4, "n"),
    (5, "Same text, told twice. It has some words in it, and a second line.\nA third line of it is here too, for the windows.", "en", "s", 1, "e", 5, "n"),
    (5, "Same text, told twice. It has some words in it, and a second line.\nA third line of it is here too, for the windows.", "en", "s", 1, "e", 5, "n"),
    (6, "Same text, told twice. It has some words in it, and a second line.\nA third line of it is here too, for the windows.", "en", None, 1, "f", 6, "n"),
    (None, "a row without an id", None, "t", 1, "g", 7, "n"), (8, "!!! ... 123", None, "t", 1, "h", 8, "n"), (9, "één Привет 漢字 😀 ünïcödé", "nl", "t", 1, "i", 9, "n"),
]


def crowded(df):
    return df.withColumns({c: F.lit(f"own {c}") for c in TAKEN})


@pytest.fixture(scope="session")
def odd(spark):
    return crowded(spark.createDataFrame(ODD, SCHEMA))


@pytest.fixture(scope="session")
def odd_named(spark):
    """The same rows with texts as ids."""
    return crowded(spark.createDataFrame([(None if r[0] is None else f"doc {r[0]}", *r[1:]) for r in ODD], f"doc_id string, {COLUMNS}"))


@pytest.fixture(scope="session")
def nothing(spark):
    return crowded(spark.createDataFrame([], SCHEMA))
