import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, g int, h string, held_out string, ids string, _found string"


def frame(spark, rows):
    """Documents with columns whose names clash with the operators' own; rows are (doc_id, text)."""
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t), 7, "x", "y", "z", "w") for i, t in rows], SCHEMA)


EDGES = [
    (None, "a row without id, a row without id, a row without id, and some more words to be long enough"),
    (1, None),
    (2, ""),
    (3, "   \n\t "),
    (4, "one two three four five six seven eight nine ten"),
    (4, "one two three four five six seven eight nine ten"),
    (5, "one two three four five six seven eight nine ten"),
    (6, "Ünïcode wörds für alle — 日本語 text with ünïcode and 😀 emoji " * 3),
    (7, "word " * 30000),
    (8, "x" * 50000),
]


@pytest.fixture
def make(spark):
    return lambda rows: frame(spark, rows)


@pytest.fixture
def edges(spark):
    return frame(spark, EDGES)


@pytest.fixture
def none(spark):
    return frame(spark, [])
