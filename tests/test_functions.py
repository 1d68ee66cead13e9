import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from placefabric.functions import geo, hours, text
from placefabric.operators import recommend, walk
from placefabric.operators.geo import score_floor, tile_cap
from placefabric.operators.ingest import parse_list
from placefabric.operators.search import bucket_keywords


def test_extent_similarity():
    assert text.extent_similarity("word", "two words") == pytest.approx(0.8)
    assert text.extent_similarity("cafe", "cafe") == 1.0
    assert text.extent_similarity("cafe", None) == 0.0
    assert text.extent_similarity("", "x") == 0.0


def test_merged_week_joins_and_wraps(spark):
    spans = [(600, 900), (900, 1000), (10_000, 10_300)]
    expected = hours.merge_spans(spans)
    assert (600, 1000) in expected and (10_000, 10_300) in expected and (-80, 220) in expected
    df = spark.createDataFrame([([(a, b) for a, b in spans],), (None,)], f"s {hours.SPANS}").select(hours.merged_week(F.col("s")).alias("m"))
    got = df.collect()
    assert [(x.open, x.close) for x in got[0].m] == expected and got[1].m is None


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 10_000), st.integers(1, 900)), max_size=6), st.integers(0, 20_000), st.integers(1, 120))
def test_wait_is_the_first_fit(spans, at, dwell):
    spans = [(a, a + n) for a, n in spans]
    got = walk.wait_for(tuple(spans), at, dwell, 30)
    t, merged = at % hours.WEEK, hours.merge_spans(spans)
    fits = [w for w in range(31) if any(a <= t + w and t + w + dwell <= b for a, b in merged)]
    assert (got is None and not fits) or got == fits[0]


def test_unknown_hours_are_open():
    assert walk.wait_for(None, 5, 600) == 0.0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.floats(-179, 179), st.floats(-85, 85)), min_size=1, max_size=20))
def test_polyline_round_trip(points):
    back = walk.polyline_points(walk.polyline(points))
    assert all(abs(a - c) <= 6e-6 and abs(b - d) <= 6e-6 for (a, b), (c, d) in zip(points, back, strict=True))


def test_polyline_known():
    assert walk.polyline([(-120.2, 38.5), (-120.95, 40.7), (-126.453, 43.252)]) == "_p~iF~ps|U_ulLnnqC_mqNvxq`@"


def test_tiles_shown_at_a_zoom_are_shown_below(spark, sf):
    from placefabric.operators.geo import tile_features
    from placefabric.plans.testmap import entity

    p = entity(spark, sf, "places")
    ids = {z: set() for z in (15, 16)}
    for r in tile_features(p, [15, 16]).select("z", "id").collect():
        ids[r.z].add(r.id)
    assert ids[15] <= ids[16]


def test_scalars():
    assert [score_floor(z) for z in (5, 10, 12, 14, 17, 18)] == [92, 86, 76, 66, 56, 0]
    assert [tile_cap(z) for z in (12, 15, 16, 17)] == [6, 10, 15, 25]
    assert geo.zoom_of_span(360) == 1 and geo.zoom_of_span(0) == 22
    assert bucket_keywords(["bar", "nightlife", "nope"])[:2] == ["bar", "pub"] and len(set(bucket_keywords(["bar", "nightlife"]))) == len(bucket_keywords(["bar", "nightlife"]))
    assert parse_list("['a', 'b', None, 'a']") == ["a", "b"] and parse_list("x; y,x") == ["x", "y"] and parse_list(None) == [] and parse_list('["p"]') == ["p"]


def quotas_by_rule(weights, limit):
    """One unit at a time, as the rule is told."""
    n = len(weights)
    if limit <= n:
        first = sorted(range(n), key=lambda i: (-weights[i], i))[:limit]
        return [1 if i in first else 0 for i in range(n)]
    share = [limit * w / sum(weights) for w in weights]
    have = {i: max(1, math.floor(share[i])) for i in range(n)}
    while sum(have.values()) > limit:
        top = max(have.values())
        have[max(i for i in have if have[i] == top)] -= 1
    order = sorted(have, key=lambda i: (share[i] - math.floor(share[i]), i))
    while sum(have.values()) < limit:
        have[order.pop()] += 1
    return [have[i] for i in range(n)]


def test_profile_quotas(spark):
    r = random.Random(3)
    users = {u: ([round(r.choice([r.uniform(0.01, 9), 1.0, 5.0]), 2) for _ in range(r.randint(1, 7))]) for u in range(120)}
    rows = [(u, k, w) for u, ws in users.items() for k, w in enumerate(ws)]
    df = spark.createDataFrame(rows, "user_id long, profile_id long, weight double")
    for limit in (1, 4, 7, 20, 33):
        got = {(x.user_id, x.profile_id): x.quota for x in recommend.profile_quotas(df, limit).collect()}
        assert got == {(u, k): q for u, ws in users.items() for k, q in enumerate(quotas_by_rule(ws, limit))}


def test_round_robin_backfills_with_the_best():
    lists = [[(0.9, 1), (0.8, 2), (0.2, 3)], [(0.7, 1), (0.6, 4), (0.5, 5), (0.4, 6)]]
    assert recommend.round_robin(lists, [1, 1], 2) == [1, 4]
    assert recommend.round_robin(lists, [1, 1], 5) == [1, 4, 2, 5, 6]  # the best scores left, whatever list they stand in
    assert recommend.round_robin(lists, [3, 1], 9) == [1, 4, 2, 3, 5, 6]


def test_interleave_by_the_rule():
    assert recommend.interleave([1, 2, 3, 4, 5, 6], [100, 101], 9) == [1, 2, 100, 3, 101, 4, 5, 6]
    assert recommend.interleave([1, 2], [9]) == [1, 2, 9] and recommend.interleave([1, 2, 3, 4, 5, 6, 7], [9], 4) == [1, 2, 9, 3, 4, 5, 6, 7]
    assert recommend.interleave([], [8, 9]) == [8, 9] and recommend.interleave([1], []) == [1]


@pytest.mark.parametrize("window", [0, 4, 9, 100])
def test_interleaved_frames(spark, window):
    keys = {k: (list(range(100 * k, 100 * k + n)), list(range(100 * k + 50, 100 * k + 50 + m))) for k, (n, m) in enumerate([(6, 2), (0, 2), (5, 0), (1, 3), (20, 4), (9, 1)])}
    frame = lambda at: spark.createDataFrame([(k, x, p) for k, v in keys.items() for p, x in enumerate(v[at])], "key int, item int, pos int")
    got = {}
    for x in recommend.interleaved(frame(0), frame(1), window).orderBy("position").collect():
        got.setdefault(x.key, []).append((x.position, x["item"]))
    for k, (base, picks) in keys.items():
        assert got[k] == list(enumerate(recommend.interleave(base, picks, window)))


def test_mmr_prefers_the_unlike():
    v = np.array([[1, 0], [1, 0.01], [0, 1]], float)
    assert recommend.mmr(np.array([1.0, 0.99, 0.8]), v, 2, 0.5) == [0, 2]


def test_profiles_split_two_directions():
    v = np.array([[1, 0.01 * k] for k in range(6)] + [[0.01 * k, 1] for k in range(6)], float)
    labels = recommend.profiles(v)
    assert len(set(labels[:6])) == 1 and len(set(labels[6:])) == 1 and labels[0] != labels[6]


def test_average_rank_percentile(spark):
    df = spark.createDataFrame([(1, 5.0), (2, 5.0), (3, 7.0), (4, None)], "id int, v double")
    got = {r.id: r.p for r in recommend.average_rank_percentile(df.where("v is not null"), "v", "p").collect()}
    assert got == {1: 0.5, 2: 0.5, 3: 1.0}


def test_haversine(spark):
    r = spark.range(1).select(geo.haversine_km(F.lit(52.52), F.lit(13.405), 44.4268, 26.1025).alias("d")).first()
    assert math.isclose(r.d, 1294, rel_tol=0.01)
