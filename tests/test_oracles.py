"""Every query of the engine's own catalogue against its oracle, and the others for rows and a stable schema."""

import math
import os

import duckdb
import pandas as pd
import pytest

from placefabric.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: Empty at the smallest scale, where the places asked for don't exist.
MAY_BE_EMPTY = {"alg3_search_text", "agg20_median_outliers", "flt11_candidate_pool", "alg54_saved_state", "str5_fold_tiers", "win1_page_with_total", "jn16_id_translation", "flt2_bbox_in_city", "top6_distance_page"}


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        path = f"{sf}/{t}.parquet"
        c.execute(f"create view {t} as select * from '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return c


def value(v):
    if v is None or v is pd.NA or v is pd.NaT or isinstance(v, float) and math.isnan(v):
        return "null"
    if isinstance(v, bool) or type(v).__name__ in ("bool_", "bool"):
        return str(bool(v))
    if isinstance(v, int | float) or hasattr(v, "dtype"):
        return repr(round(float(v), 9))
    return str(v).removesuffix(" 00:00:00")


def rows(df):
    return sorted(tuple(value(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, sf, duck, name):
    got = catalogue.QUERIES[name](spark, sf).toPandas()
    if name in catalogue.ORACLES:
        expected = duck.execute(catalogue.ORACLES[name]).df()
        assert sorted(got.columns) == sorted(expected.columns)
        assert rows(got) == rows(expected)
    elif name not in MAY_BE_EMPTY:
        assert len(got)


def test_flagship(spark, sf):
    assert catalogue.QUERIES[catalogue.FLAGSHIP](spark, sf).count() >= 0
