"""Type-strict differences of pairs of JSON documents, level by level.

Both sides are VARIANT values. A level compares the kinds of each pair of values and takes pairs of objects and of arrays
apart into the pairs below, by key and by position; no join is needed, as both sides travel in one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placefabric.sources import scratch

_COLUMNS = ["id", "path", "l", "r", "in_l", "in_r"]


def _kind(v: str, there: str) -> Column:
    of = F.schema_of_variant(F.col(v))
    kind = (
        F.when(F.col(v).isNull() | F.is_variant_null(F.col(v)), "null").when(F.startswith(of, F.lit("OBJECT")), "object").when(F.startswith(of, F.lit("ARRAY")), "array")
        .when(of == "STRING", "string").when(of == "BOOLEAN", "boolean").otherwise("number")
    )
    return F.when(F.col(there), kind).otherwise("missing")


def _child(path: Column, key: Column) -> Column:
    quoted = F.replace(F.replace(key, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    return F.when(key.rlike(r"^[A-Za-z_$][A-Za-z0-9_$]*$"), F.concat(path, F.lit("."), key)).otherwise(F.concat(path, F.lit('["'), quoted, F.lit('"]')))


def json_differences(pairs: DataFrame, ignore: list[str] | None = None, tolerance: float = 0.0) -> DataFrame:
    """pairs (id, left string, right string) -> id, path, kind, left, right: a row for each place where the two differ.

    kind: `type` where the kinds differ (the values as JSON, whatever is below them), `value` where scalars of one kind do,
    `missing` and `extra` where only left or only right has a key or a position; `invalid` at the root if a side is no JSON.
    Numbers may differ by the tolerance, and 1 equals 1.0. Keys to ignore are passed over at any depth. A null text is missing.
    A level is written to the shared folder and read again; there are as many as the documents are deep.
    """
    spark, path = pairs.sparkSession, scratch.folder(pairs.sparkSession, "json-diff")
    sides = pairs.select("id", F.lit("$").alias("path"), F.try_parse_json("left").alias("l"), F.try_parse_json("right").alias("r"), F.col("left").isNotNull().alias("in_l"), F.col("right").isNotNull().alias("in_r"))
    broken = (F.col("in_l") & F.col("l").isNull()) | (F.col("in_r") & F.col("r").isNull())
    pairs.select("id", F.lit("$").alias("path"), F.lit("invalid").alias("kind"), "left", "right", F.try_parse_json("left").alias("l"), F.try_parse_json("right").alias("r")).where(
        (F.col("left").isNotNull() & F.col("l").isNull()) | (F.col("right").isNotNull() & F.col("r").isNull())
    ).drop("l", "r").write.parquet(f"{path}/found/level=-1")
    sides.where(~broken).select(_COLUMNS).write.parquet(f"{path}/level-0")
    level = 0
    while True:
        rows = spark.read.parquet(f"{path}/level-{level}").withColumns({"kl": _kind("l", "in_l"), "kr": _kind("r", "in_r")})
        json = lambda v, there: F.when(F.col(there), F.coalesce(F.to_json(v), F.lit("null")))
        number = F.abs(F.try_variant_get("l", "$", "double") - F.try_variant_get("r", "$", "double")) <= tolerance
        same = F.when(F.col("kl") == "number", F.coalesce(number, F.lit(False)) | (json("l", "in_l") == json("r", "in_r"))).otherwise(json("l", "in_l") == json("r", "in_r"))
        kind = (
            F.when(F.col("kl") == F.col("kr"), F.when(F.col("kl").isin("object", "array", "null", "missing") | same, F.lit(None)).otherwise("value"))
            .when(F.col("kl") == "missing", "extra").when(F.col("kr") == "missing", "missing").otherwise("type")
        )
        found = rows.withColumn("kind", kind).where("kind is not null").select("id", "path", "kind", json("l", "in_l").alias("left"), json("r", "in_r").alias("right"))
        found.write.parquet(f"{path}/found/level={level}")
        maps = [F.try_variant_get(v, "$", "map<string,variant>") for v in ("l", "r")]
        objects = rows.where("kl = 'object' and kr = 'object'").select("id", "path", maps[0].alias("ml"), maps[1].alias("mr"))
        objects = objects.select("id", "path", "ml", "mr", F.explode(F.array_union(F.map_keys("ml"), F.map_keys("mr"))).alias("k")).where(~F.col("k").isin(list(ignore or [])))
        objects = objects.select("id", _child(F.col("path"), F.col("k")).alias("path"), F.try_element_at("ml", F.col("k")).alias("l"), F.try_element_at("mr", F.col("k")).alias("r"), F.map_contains_key("ml", F.col("k")).alias("in_l"), F.map_contains_key("mr", F.col("k")).alias("in_r"))
        lists = [F.try_variant_get(v, "$", "array<variant>") for v in ("l", "r")]
        arrays = rows.where("kl = 'array' and kr = 'array'").select("id", "path", lists[0].alias("al"), lists[1].alias("ar")).withColumn("n", F.greatest(F.size("al"), F.size("ar"))).where("n > 0")
        arrays = arrays.select("id", "path", "al", "ar", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("k"))
        arrays = arrays.select("id", F.concat("path", F.lit("["), "k", F.lit("]")).alias("path"), F.get("al", F.col("k")).alias("l"), F.get("ar", F.col("k")).alias("r"), (F.col("k") < F.size("al")).alias("in_l"), (F.col("k") < F.size("ar")).alias("in_r"))
        below = objects.unionByName(arrays)
        below.write.parquet(f"{path}/level-{level + 1}")
        level += 1
        if spark.read.parquet(f"{path}/level-{level}").isEmpty():
            break
    return spark.read.parquet(f"{path}/found").drop("level")
