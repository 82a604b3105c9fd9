import pytest

#: Rows with nulls, empties, copies, ties and a column that clashes with names operators use.
TEXTS = [
    (1, "The quick brown fox jumps over the lazy dog and runs far away from here today.", "a"),
    (2, "The quick brown fox jumps over the lazy dog and runs far away from here today.", "a"),
    (3, "THE QUICK, brown fox jumps over the lazy dog and runs far away from here today", None),
    (4, "", "b"),
    (5, None, "b"),
    (None, "a text without any id but with words", "c"),
    (7, "one two", "c"),
    (7, "one two", "c"),
    (8, "é è ñ ß 漢字 'tis don't <|endoftext|> x.y,z 12 34", "é"),
    (9, "word " * 3000 + "end.", "a"),
    (10, " \t\n ", None),
]


@pytest.fixture(scope="session")
def docs(spark):
    rows = [(*r, "en", len(r[1] or ""), k, "x") for k, r in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long, size long, score string")


@pytest.fixture(scope="session")
def empty(docs):
    return docs.where("false")
