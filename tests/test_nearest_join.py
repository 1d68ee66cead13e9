"""The k nearest join against all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from placefabric.operators import nearest_join
from placefabric.operators.nearest_join import NearestJoin, resolve_cities

ROWS, ORIGINS = "rid long, lat double, lng double", "lid long, lat double, lng double, rank string"


def points(seed, n, first=0):
    """Clusters, a line, single far points, and a place that a third of all rows share."""
    r = random.Random(seed)
    out = []
    for k in range(first, first + n):
        kind = r.randrange(6)
        if kind < 2:
            out.append((k, 10.0, 20.0))
        elif kind < 4:
            out.append((k, 10 + r.gauss(0, 0.001), 20 + r.gauss(0, 0.001)))
        elif kind == 4:
            out.append((k, -5.0, r.randrange(40) * 0.25))
        else:
            out.append((k, r.uniform(-80, 80), r.uniform(-170, 170)))
    return out


def all_pairs(rows, origins, k):
    out = {}
    for lid, lat, lng in origins:
        best = sorted((float((b - lat) ** 2 + (c - lng) ** 2), a) for a, b, c in rows)[:k]
        out |= {(lid, n): a for n, (_, a) in enumerate(best, 1)}
    return out


@pytest.mark.parametrize(("k", "leaf"), [(1, 32), (3, 1), (7, 4), (40, 32)])
def test_equals_all_pairs(spark, monkeypatch, k, leaf):
    monkeypatch.setattr(nearest_join, "LEAF", leaf)
    rows, origins = points(k, 300), [*points(k + 100, 60, 1000), (1, 10.0, 20.0), (2, 89.0, -179.0), (3, 10.0005, 20.0)]
    edge = [(4, None, 1.0, ""), (5, 1.0, float("nan"), ""), (1, 10.0, 20.0, "")]
    join = NearestJoin(spark.createDataFrame([*rows, (9001, None, 1.0), (None, 10.0, 20.0), (9002, float("nan"), 2.0)], ROWS), k)
    got = join.join(spark.createDataFrame([(*o, "clash") for o in origins] + edge, ORIGINS))
    assert {(r.lid, r["rank"]): r.rid for r in got.collect()} == all_pairs(rows, origins, k)
    assert "CartesianProduct" not in got._jdf.queryExecution().toString() and "NestedLoop" not in got._jdf.queryExecution().toString()


def test_fewer_rows_than_asked_and_none(spark):
    origins = spark.createDataFrame([(1, 0.0, 0.0, "")], ORIGINS)
    one = NearestJoin(spark.createDataFrame([(7, 3.0, 4.0), (8, 3.0, 4.0)], ROWS), 5).join(origins)
    assert [(r.rid, r["rank"]) for r in one.orderBy("rank").collect()] == [(7, 1), (8, 2)]
    assert NearestJoin(spark.createDataFrame([], ROWS), 5).join(origins).count() == 0


def test_a_hot_place_is_not_joined_whole(spark):
    """A third of the rows at one place: no more of them are kept than may be asked for."""
    join = NearestJoin(spark.createDataFrame([(k, 1.0, 1.0) for k in range(3000)] + [(5000 + k, 1 + k * 1e-3, 1.0) for k in range(1, 100)], ROWS), 2)
    assert spark.read.parquet(f"{join.path}/rows").count() == 2 + 99


def test_guard(spark):
    places = spark.createDataFrame([(1, "A", "X", 10.0, 20.0)], "id long, city string, country string, lat double, lng double")
    origins = spark.createDataFrame([(1, 10.1, 20.0, ""), (2, 11.0, 20.0, "")], ORIGINS)
    assert [tuple(r) for r in resolve_cities(origins, places).collect()] == [(1, 1, "A", "X")]
    assert resolve_cities(origins, places, 200_000).select(F.count(F.lit(1))).first()[0] == 2
