import pytest
from pyspark.sql import types as T

WORDS = "the quick brown fox jumps over a lazy dog while nine wise owls watch from tall green pines near the silver lake every cold night in winter and nobody knows why they never sleep at all".split()


def passage(n, k=0):
    return " ".join(WORDS[(i * (k % 5 + 1) + k + i // 7) % len(WORDS)] + ("" if i % 3 else str((i + k) % 50)) for i in range(n))


@pytest.fixture(scope="session")
def edge_rows():
    """Nulls in every column, empty, blank and long texts, ties, repeated rows, copies, and a text under several ids."""
    long_ = passage(9000, 2)
    rows = [
        (1, passage(300, 1), "en", "web"), (2, passage(300, 1), "en", None), (3, passage(300, 1).replace("fox", "cat", 1), None, "web"), (4, None, None, None), (5, "", "en", "web"), (6, "  \n\t ", "de", "books"),
        (None, passage(80, 3), "en", "web"), (8, long_, "en", "books"), (9, "start " + long_[5000:30000] + " end", "en", "books"), (10, "one", "en", "web"), (11, "one", "en", "web"), (12, "Ünï çödé " * 90, "de", "news"),
        (13, passage(120, 4), "en", "news"), (13, passage(120, 4), "en", "news"), (14, "x" * 5000, "en", "web"), (15, "ab " * 700, "en", "web"), (16, passage(49, 1), "en", "web"), (17, "ONE", "fr", "web"), (18, passage(60, 7) + " wide space", "en", "web"),
    ]
    return [(i, t, lang, s, len(t) if t is not None else None, 7, "clash") for i, t, lang, s in rows]


@pytest.fixture(scope="session")
def schema():
    return T.StructType([T.StructField(n, t) for n, t in (("doc_id", T.LongType()), ("text", T.StringType()), ("lang", T.StringType()), ("source", T.StringType()), ("n_chars", T.LongType()), ("size", T.IntegerType()), ("component_id", T.StringType()))])


@pytest.fixture(scope="session")
def edges(spark, edge_rows, schema):
    return spark.createDataFrame(edge_rows, schema)


@pytest.fixture(scope="session")
def empty(spark, schema):
    return spark.createDataFrame([], schema)
