"""Posting lists against a full scan with the plain similarity."""

import random

import pytest
from pyspark.sql import functions as F

from placefabric.functions import text as t
from placefabric.operators import search
from placefabric.operators.text_index import TrigramIndex, grams, may_match, needed

PLACES = "id long, name string, category string, primary_type string, city string, country string, lat double, lng double, visibility double, popularity double"


@pytest.fixture(scope="module")
def texts():
    r = random.Random(5)
    words = ["blue", "bleu", "café", "cafe", "ring", "rings", "Ring-road", "東京", "a", "42", "42nd", "o'hara", "x"]
    out = {" ".join(r.choice(words) for _ in range(r.choice([1, 2, 3, 6]))) for _ in range(150)}
    return [*out, "", " ", "--", None, "common " * 200, "zzz"] + [f"common name {k}" for k in range(100)]


def test_needed_share():
    assert [needed(n) for n in (1, 3, 4, 10, 11)] == [1, 1, 2, 3, 4]


def test_grams_equal_the_plain_ones(spark, texts):
    rows = spark.createDataFrame([(x,) for x in texts], "x string").select("x", grams(F.col("x")).alias("g")).collect()
    for r in rows:
        assert set(r.g) == set(t.ordered_trigrams(r.x or "")) and len(r.g) == len(set(r.g))


@pytest.mark.parametrize("floor", [0.3, 0.6, 1.0])
def test_matches_equal_a_full_scan(spark, texts, tmp_path, floor):
    queries = ["blue ring", "cafe", "rin", "東京", "common name 7", "a", "", "!!", "zz", "nothing like it", "42", None, "blue ring"]
    index = TrigramIndex.build(spark.createDataFrame([(x,) for x in texts], "text string"), str(tmp_path / "i"))
    asked = spark.createDataFrame([(q,) for q in queries], "q string")
    got = {(r.q, r.text): r.similarity for r in index.matches(asked, floor).collect()}
    want = {(q, x): t.extent_similarity(q, x) for q in queries if q for x in set(texts) if x is not None and t.extent_similarity(q, x) >= floor}
    assert got == want
    for q in queries:
        if q is not None:  # the filter for one query keeps all that match
            kept = {r.x for r in spark.createDataFrame([(x,) for x in texts], "x string").where(may_match(F.col("x"), q, floor)).collect()}
            assert {x for (p, x) in want if p == q} <= kept


def test_only_rare_lists_are_read(spark, tmp_path):
    texts = [f"common name {k}" for k in range(300)] + ["common zebra"]
    index = TrigramIndex.build(spark.createDataFrame([(x,) for x in texts], "text string"), str(tmp_path / "i"))
    assert index.candidates(spark.createDataFrame([("common zebra",)], "q string"), 0.8).count() == 1


def test_search_with_and_without_index(spark, tmp_path):
    rows = [
        (1, "Blue Ring", "shop", "store", "A", "X", 44.4, 26.1, 50.0, None), (2, "blue rink", None, "store", "A", "X", 44.4, 26.2, None, 10.0), (3, "cafe", "blue", "ring", "A", "X", 44.4, 26.3, 90.0, 90.0),
        (4, None, None, "blue ring", "A", "X", 44.5, 26.1, 10.0, 10.0), (5, "green", "shop", "store", "B", "X", 44.5, 26.1, 99.0, 99.0),
    ]
    p = spark.createDataFrame(rows, PLACES)
    index = TrigramIndex.build(p.select(t.norm(F.col("name")).alias("text")), str(tmp_path / "i"))
    with_, without = ([(r.id, round(r.search_score, 6)) for r in search.search(p, "Blue ring", city="a", index=i).collect()] for i in (index, None))
    assert with_ == without and [i for i, _ in with_] == [1, 2, 4]
    # name 1, prefix and equal name, city, half of the visibility's eight points
    assert with_[0][1] == pytest.approx(100 + 30 + 15 + 12 + 4)
