import pytest

LONG = " ".join(f"word{i % 997} other{i % 31}" for i in range(60_000))
#: Nulls, empty and blank texts, repeated rows, a very long text, characters of all sizes, and columns whose names clash.
AWKWARD = [
    (1, None, "en"),
    (2, "", "en"),
    (3, " \t\n ", None),
    (4, "one two", "en"),
    (4, "one two", "en"),
    (5, LONG, "en"),
    (6, LONG, "de"),
    (None, "a text without an id of its own, mail a@b.co", "en"),
    (7, "ünïcode 字符 \U0001f600 x\ny\n\nx\n", "fr"),
    (8, "the same words " * 40, "en"),
]


@pytest.fixture
def awkward(spark):
    rows = [(*r, i, i, "k", float(i)) for i, r in enumerate(AWKWARD)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, row long, n_words long, key string, kept double").repartition(3)


@pytest.fixture
def nothing(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
