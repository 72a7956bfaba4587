import pytest
from pyspark.sql import functions as F

#: Names that the operators use in tables of their own.
CLASHING = "row item key hash held spans node fp h value term rank side part bin fold y k c n docs shown copies doc statistics norm first tie id file start block length".split()
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Nulls, empty and long texts, repeats, odd characters; columns with clashing names.
TEXTS = [
    (1, "The quick brown fox jumps over the lazy dog and runs away from the big bad wolf today."),
    (2, "the quick brown fox jumps over the lazy dog and runs away from the big bad wolf today."),
    (3, None),
    (4, ""),
    (5, "  \t\n"),
    (6, "Ünïcödé wörds, 12 3½ — ñandú! don't we'll <|endoftext|> x"),
    (7, "a b c d e f g h i j " * 4000),
    (8, "one"),
    (9, "The quick brown fox jumps over the lazy dog and runs away from the big bad cat today."),
    (9, "The quick brown fox jumps over the lazy dog and runs away from the big bad cat today."),
    (None, "no id here\nbut two lines"),
    (11, "12 34 !!"),
    (12, "but two lines\nNO id  here!"),
]


@pytest.fixture(scope="session")
def odd(spark):
    rows = [(i, t, "en" if i and i % 2 else None, None if i == 4 else f"s{(i or 0) % 2}", None if t is None else len(t)) for i, t in TEXTS]
    docs = spark.createDataFrame(rows, DOCS)
    clashing = {name: F.lit(k) for k, name in enumerate(CLASHING)}
    return docs.withColumns(clashing).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def some(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")
