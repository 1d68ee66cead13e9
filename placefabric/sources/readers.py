"""Readers with declared schemas; ids stay strings."""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

PLACES = T.StructType([
    T.StructField("source_id", T.StringType()), T.StructField("name", T.StringType()), T.StructField("primary_type", T.StringType()), T.StructField("city", T.StringType()),
    T.StructField("latitude", T.DoubleType()), T.StructField("longitude", T.DoubleType()), T.StructField("rating", T.DoubleType()), T.StructField("opening_hours", T.StringType()),
])


def csv(spark: SparkSession, paths: str | list[str], schema: T.StructType) -> DataFrame:
    """CSV with header, byte order mark and quoted line breaks; values aren't trimmed, an empty one is null."""
    df = spark.read.csv(paths, schema=schema, header=True, multiLine=True, quote='"', escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False, enforceSchema=True, encoding="UTF-8")
    return df


def jsonl(spark: SparkSession, paths: str | list[str], schema: T.StructType) -> DataFrame:
    """JSON lines; blank and broken lines are left out. line_order rises within the input."""
    lines = spark.read.text(paths).where(F.trim("value") != "")
    return lines.select(F.monotonically_increasing_id().alias("line_order"), F.from_json("value", schema).alias("r")).where("r is not null").select("line_order", "r.*")


def matrix(files: DataFrame, ids: DataFrame) -> DataFrame:
    """.npy matrices, (path, content) as the binaryFile source reads them, with (path, row, place_id) -> (place_id, vector).

    Files are read by the executors, in slices of rows. Every row must have one id and every id one row, ids must be
    distinct and values finite; else it is an error. Only the counts of these checks reach the driver.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                m = np.load(io.BytesIO(content.as_py()), allow_pickle=False)
                if m.ndim != 2:
                    raise ValueError(f"{path} is not a matrix")
                for k in range(0, len(m), 4096):
                    part = np.ascontiguousarray(m[k : k + 4096], dtype=np.float32)
                    vectors = pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1) * m.shape[1], pa.int32()), pa.array(part.ravel()))
                    yield pa.RecordBatch.from_arrays([pa.array([path] * len(part)), pa.array(np.arange(k, k + len(part))), vectors], names=["path", "row", "vector"])

    read = files.select("path", "content").mapInArrow(rows, "path string, row long, vector array<float>")
    joined = read.join(ids.select("path", "row", "place_id"), ["path", "row"], "full_outer")
    bad = F.exists("vector", lambda x: F.isnan(x) | (F.abs(x) == float("inf")))
    found = joined.agg(F.count(F.when(F.col("vector").isNull() | F.col("place_id").isNull(), 1)).alias("unmatched"), (F.count(F.lit(1)) - F.count_distinct("place_id")).alias("repeated"), F.count(F.when(bad, 1)).alias("broken")).first()
    if any(found):
        raise ValueError(f"the matrix and its ids don't match: {found.asDict()}")
    return joined.select("place_id", "vector")


def aligned(places: DataFrame, features: DataFrame, key: str = "place_id") -> DataFrame:
    """One row of counts: keys only in places, only in features, and in both."""
    a, b = places.select(key, F.lit(1).alias("a")).distinct(), features.select(key, F.lit(1).alias("b")).distinct()
    j = a.join(b, key, "full_outer")
    n = lambda c: F.count(F.when(c, 1))
    return j.agg(n(F.col("b").isNull()).alias("only_places"), n(F.col("a").isNull()).alias("only_features"), n(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("both"))


def from_json_array(df: DataFrame, column: str, ddl: str) -> DataFrame:
    """A JSON array parameter as rows."""
    return df.select(F.explode(F.from_json(column, f"array<struct<{ddl}>>")).alias("r")).select("r.*")


def with_ordinality(df: DataFrame, column: str) -> DataFrame:
    """An array as rows with places from 1."""
    return df.select("*", F.posexplode(column).alias("_p", "item")).withColumn("ordinality", F.col("_p") + 1).drop("_p")
