import pytest
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, rows):
    """Rows of (doc_id, text) or whole rows."""
    full = [(*r, *("en", "s0", None)[len(r) - 2:]) if len(r) < 5 else r for r in rows]
    return spark.createDataFrame(full, SCHEMA)


@pytest.fixture(scope="session")
def words():
    return [f"w{i}" for i in range(5000)]


@pytest.fixture(scope="session")
def odd(spark, words):
    """Nulls in every column, empty and very long texts, ties, repeated rows, and columns whose names operators use themselves."""
    long_text = " ".join(words[i * 7919 % 5000] for i in range(120_000))
    rows = [
        (1, "alpha beta", "en", "s0", 10), (2, "alpha  beta", "en", "s0", 11), (2, "alpha  beta", "en", "s0", 11),
        (3, None, None, None, None), (4, "", "fr", "s1", 0), (5, " \n\t ", "de", None, 4), (6, long_text, "en", "s1", None),
        (7, long_text + " tail", None, "s1", 1), (None, "no id here", "en", "s0", 3), (None, None, None, None, None), (8, "x", "en", "s0", 1),
        (9, "1234 5678 !!", "es", "s2", 12), (10, "é" * 3000, "fr", "s2", 3000),
    ]
    clash = ["kept", "score", "h", "head", "salt", "body", "blob", "id", "rules", "host", "n", "sig", "set_id", "place", "hot", "toxic", "length", "rank",
             "n_words", "spans", "part", "bucket", "__gone", "kind", "words"]
    return documents(spark, rows).withColumns({c: F.lit("clash") for c in clash})


@pytest.fixture(scope="session")
def nothing(spark):
    return documents(spark, [])


def by_id(df, *columns):
    return {r["doc_id"]: tuple(r[c] for c in columns) if len(columns) > 1 else r[columns[0]] for r in df.collect()}
