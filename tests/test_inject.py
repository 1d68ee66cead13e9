"""Injection by hand: amounts of the three modes, the gates, and where the places stand."""

import math

import pytest

from placefabric.operators.inject import Injection, amounts, injected, taste_focus, theme_balance

SEEDS = "user_id long, theme string, type string"
POOL = "user_id long, place_id long, theme string, type string, tags array<string>, axis double, overlap double, quality double"
RANKED = "user_id long, place_id long, position int"


def seeds(spark):
    rows = [(1, "food", "cafe")] * 4 + [(2, "food", "cafe"), (2, "art", "museum")] + [(3, "food", "cafe")] * 3 + [(3, "art", "museum")] + [(4, None, None)]
    return spark.createDataFrame(rows, SEEDS)


def pool(spark):
    rows = []
    for u in (1, 2, 3, 4, 5):
        rows += [(u, k, "food", "cafe", [], 0.9, 0.9, 0.1) for k in range(10)]
        rows += [(u, 20, "art", "museum", [], 0.9, 0.1, 0.0), (u, 21, "art", "museum", [], 0.8, 0.2, 0.9), (u, 22, "art", "casino ", [], 1.0, 1.0, 1.0), (u, 23, "art", "museum", ["Gambling"], 1.0, 1.0, 1.0)]
        rows += [(u, 24, "art", "museum", None, 0.5, 0.39, 1.0), (u, 25, None, "museum", [], 0.9, None, None)]
    return spark.createDataFrame(rows, POOL)


def test_balance(spark):
    got = {r.user_id: (r.dominant, r.balance) for r in theme_balance(seeds(spark)).collect()}
    assert got.keys() == {1, 2, 3} and got[1] == ("food", 0.0) and got[2] == ("art", pytest.approx(1.0))
    assert got[3] == ("food", pytest.approx(-(0.75 * math.log(0.75) + 0.25 * math.log(0.25)) / math.log(2)))


def test_focus(spark):
    got = {r.user_id: r.focus for r in taste_focus(seeds(spark).select("user_id", "type"), pool(spark).select("user_id", "type"), (0.0, 1.0)).collect()}
    q = {"cafe": 10 / 16, "museum": 5 / 16, "casino ": 1 / 16}
    p = {t: ((4 if t == "cafe" else 0) + 5 * x) / 9 for t, x in q.items()}
    assert got[1] == pytest.approx(sum(x * math.log(x / (0.99 * q[t] + 0.01 * x)) for t, x in p.items()))
    assert all(0 <= x <= 1 for x in got.values()) and 5 not in got


def test_amounts_of_the_modes(spark):
    of = lambda how: {r.user_id: r.k for r in amounts(seeds(spark), pool(spark), how, 20).collect()}
    assert of(Injection("off")) == {1: 0, 2: 0, 3: 0}
    assert of(Injection("manual", share=0.25)) == {1: 5, 2: 5, 3: 5}
    assert of(Injection("manual", share=0.25, window=4)) == {1: 1, 2: 1, 3: 1}
    assert of(Injection("auto", most=0.2, narrow=(5.0, 9.0))) == {1: 4, 2: 0, 3: 1}


def test_lists(spark):
    ranked = spark.createDataFrame([(u, k, k) for u in (1, 2, 4, 5) for k in range(10)] + [(1, 21, 10)], RANKED)
    how = Injection("manual", share=0.5, window=6, deny_types=("Casino",), deny_tags=("gambling",))
    got = {}
    for r in injected(ranked, seeds(spark), pool(spark), how, 8).orderBy("user_id", "position").collect():
        got.setdefault(r.user_id, []).append((r.place_id, r.injected))
    # three at most; of 20 to 25 the casino and the gambling place are denied, 24 falls short of the floor by 0.005
    assert [p for p, _ in got[1]] == [0, 1, 21, 2, 20, 3, 25, 4]
    assert [p for p, i in got[1] if i] == [21, 20, 25]
    assert all(not i for _, i in got[4] + got[5]) and [p for p, _ in got[5]] == list(range(8))
    assert [p for p, i in got[2] if i] == [0, 1, 2]  # food is what is other for the second
    assert len({p for p, _ in got[2]}) == 8


def test_nothing_is_changed_without_a_mode(spark):
    ranked = spark.createDataFrame([(1, 7, 0), (1, 8, 1)], RANKED)
    rows = injected(ranked, seeds(spark), pool(spark), Injection(), 20).orderBy("position").collect()
    assert [(r.place_id, r.injected) for r in rows] == [(7, False), (8, False)]
