import pytest

#: Nulls in any column, empty and blank texts, repeated rows, ties, a long text, odd characters.
ROWS = [
    (1, "one two three four five six seven", "a"),
    (2, "one two  three four five six seven", "b"),
    (3, "One two three four five six seven", None),
    (4, None, "a"),
    (5, "", "c"),
    (6, " \t\n", "c"),
    (6, " \t\n", "c"),
    (7, "word " * 9000, "a"),
    (8, "é à 中文 <|endoftext|> don't x　y", "d"),
    (9, None, None),
    (None, "no id", "a"),
    (None, None, None),
    (10, "line\nline\nother\n\nline", "b"),
    (11, "one two three four five six seven", "zz"),
]


@pytest.fixture(scope="session")
def docs(spark):
    """With a null key, repeated rows and columns whose names clash with those the operators use inside."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(ROWS, "doc_id long, text string, source string")
    return df.withColumns({"lang": F.lit("en"), "n_chars": F.length("text").cast("long"), "size": F.lit(1), "label": F.lit("x"), "rid": F.lit(2), "set_id": F.lit(3)})


@pytest.fixture(scope="session")
def empty(docs):
    return docs.where("false")
