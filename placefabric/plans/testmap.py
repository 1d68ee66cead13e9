"""Adapters from the star-schema test tables to the engine's entities.

Each mapping is one list of expressions that Spark SQL and the oracle's dialect read alike, so that an oracle can start
from the same entity by a common table expression.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

MAPPED: dict[str, tuple[str, str]] = {
    "places": (
        """p_partkey AS id, concat(p_partkey, '') AS source_id, 'catalog' AS source, p_name AS name, lower(p_type) AS primary_type, lower(p_brand) AS category,
        n_name AS city, r_name AS country,
        CASE WHEN p_partkey % 13 = 0 THEN NULL ELSE (p_size % 50) * 0.1e0 END AS rating,
        (p_partkey * 97) % 5000 AS reviews_count, 1e0 + (p_partkey % 41) * 0.1e0 AS google_rating, (p_partkey * 31) % 900 AS google_count,
        CASE WHEN p_partkey % 17 = 0 THEN NULL ELSE (p_partkey * 37) % 101 + 0e0 END AS visibility,
        CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE (p_partkey * 53) % 101 + 0e0 END AS popularity,
        44.43e0 + ((p_partkey * 7919) % 2000 - 1000) * 1.2e-5 AS lat, 26.10e0 + ((p_partkey * 104729) % 2000 - 1000) * 1.7e-5 AS lng,
        p_partkey % 5 AS price_level, CASE p_partkey % 4 WHEN 0 THEN 'low' WHEN 1 THEN 'medium' ELSE 'high' END AS confidence,
        concat('theme', p_size % 6) AS theme, CASE WHEN p_partkey % 19 = 0 THEN NULL ELSE concat('photos/', p_partkey % 1500, '.jpg') END AS photo_path, p_retailprice AS price""",
        "part JOIN nation ON n_nationkey = p_partkey % 25 JOIN region ON r_regionkey = n_regionkey",
    ),
    "photos": (
        """l_partkey AS photo_place, concat('photos/', l_partkey % 1500, '.jpg') AS path, concat('https://img.example.com/', l_orderkey, '/', l_linenumber) AS url,
        l_orderkey * 10 + l_linenumber AS photo_id, CASE WHEN l_linenumber % 5 = 0 THEN NULL ELSE l_linenumber END AS photo_index,
        CASE WHEN l_returnflag = 'A' THEN 'vibe' WHEN l_returnflag = 'N' THEN 'review' ELSE 'all' END AS photo_source""",
        "lineitem",
    ),
    "saves": (
        """o_custkey AS user_id, l_partkey AS place_id, o_orderdate AS created_at, o_orderpriority AS list_name,
        CASE WHEN o_orderpriority = '1-URGENT' THEN 'saved' WHEN o_orderpriority = '2-HIGH' THEN 'been' ELSE 'other' END AS slug, l_orderkey AS order_id, l_linenumber AS line""",
        "lineitem JOIN orders ON o_orderkey = l_orderkey",
    ),
    "reactions": (
        """o_custkey AS user_id, l_partkey AS place_id, CASE l_returnflag WHEN 'A' THEN 'favorite' WHEN 'N' THEN 'dislike' ELSE 'hide' END AS reaction,
        o_orderdate AS updated_at, l_orderkey AS order_id, l_linenumber AS line""",
        "lineitem JOIN orders ON o_orderkey = l_orderkey",
    ),
    "reviews": (
        """doc_id % 700 AS user_id, doc_id % 300 AS place_id, 1 + doc_id % 5 AS rating, n_chars AS body_length, doc_id AS review_id, (doc_id * 7) % 11 AS helpful""",
        "documents",
    ),
    "log": (
        """event_id, event_type, ts AS server_ts, user_id, user_id % 50 AS request_id, CAST(json_number AS BIGINT) AS place_id, value,
        CASE WHEN event_type IN ('view', 'click', 'purchase', 'signup') THEN true ELSE false END AS known_type""",
        "",
    ),
    "served": ("o_orderkey AS request_id, o_custkey AS served_user, o_orderstatus AS version, o_orderdate AS served_at", "orders"),
    "served_items": ("l_orderkey AS request_id, l_linenumber - 1 AS position, l_partkey AS place_id, l_extendedprice AS score", "lineitem"),
}

#: What differs between the dialects: a number out of a small JSON object.
_LOG_FROM = {"spark": "(SELECT *, get_json_object(props, '$.k') AS json_number FROM {0}) AS e", "oracle": "(SELECT *, json_extract_string(props, '$.k') AS json_number FROM events) AS e"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def entity(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A mapped entity as a DataFrame."""
    columns, source = MAPPED[name]
    frames = {t: table(spark, sf_dir, t) for t in ("part", "nation", "region", "lineitem", "orders", "documents", "events") if t in source or name == "log" and t == "events"}
    if name == "log":
        return spark.sql(f"SELECT {columns} FROM (SELECT *, get_json_object(props, '$.k') AS json_number FROM {{events}})", events=frames["events"])
    for t in frames:
        source = source.replace(t, f"{{{t}}}", 1) if t in source.split() else source
    return spark.sql(f"SELECT {columns} FROM {source}", **{k: v for k, v in frames.items() if f"{{{k}}}" in source})


def cte(*names: str) -> str:
    """WITH clause of the oracle for mapped entities."""
    parts = []
    for name in names:
        columns, source = MAPPED[name]
        parts.append(f"{name} AS (SELECT {columns} FROM {_LOG_FROM['oracle'] if name == 'log' else source})")
    return "WITH " + ", ".join(parts) + " "
