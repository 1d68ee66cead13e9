"""Sinks: partitioned Parquet, CSV, JSON lines, and an immutable bundle with a manifest."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placefabric.operators.ingest import row_hash


def parquet_by_day(df: DataFrame, path: str, day: str = "event_date") -> None:
    """Each day written replaces that day alone."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(day).parquet(path)


def csv(df: DataFrame, path: str) -> None:
    """Null as an empty string; nested columns as JSON."""
    flat = [F.to_json(c).alias(c) if df.schema[c].dataType.typeName() in ("array", "map", "struct") else F.col(c) for c in df.columns]
    df.select(*flat).write.mode("overwrite").option("header", True).option("nullValue", "").option("emptyValue", '""').option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def batch_requests(df: DataFrame, path: str, model: str) -> None:
    """(custom_id, text) as JSON lines of embedding requests."""
    body = F.struct(F.lit(model).alias("model"), F.col("text").alias("input"))
    df.select("custom_id", F.lit("POST").alias("method"), F.lit("/v1/embeddings").alias("url"), body.alias("body")).write.mode("overwrite").json(path)


def check_requests(requests: DataFrame) -> DataFrame:
    """One row: requests, distinct ids, methods and models."""
    return requests.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("custom_id").alias("n_ids"), F.array_sort(F.collect_set("method")).alias("methods"), F.array_sort(F.collect_set("body.model")).alias("models"))


def _rename(spark: SparkSession, old: str, new: str) -> None:
    """One rename in the file system of the path; an existing target is an error."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(old).getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(path(new)) or not fs.rename(path(old), path(new)):
        raise FileExistsError(new)


def _digests(spark: SparkSession, path: str) -> DataFrame:
    """(name, bytes, sha256) of the Parquet files below a path."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def bundle(df: DataFrame, path: str, key: str = "id", rows_per_file: int = 1_000_000) -> dict:
    """An immutable bundle: Zstandard Parquet, a manifest with counts, extent and an order-free content digest, and the digest of every file.

    All is written to a staging folder beside the path, which one rename turns into the bundle; an existing bundle stays and is an error.
    """
    spark, staging = df.sparkSession, f"{path}.staging-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").option("maxRecordsPerFile", rows_per_file).parquet(f"{staging}/catalog")
    stored = spark.read.parquet(f"{staging}/catalog")
    h = F.conv(F.substring(row_hash(stored, stored.columns), 1, 15), 16, 10).cast("decimal(38,0)")
    row = stored.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct(key).alias("keys"), F.min("lat").alias("south"), F.max("lat").alias("north"), F.min("lng").alias("west"), F.max("lng").alias("east"), F.sum(h).alias("digest")).first()
    manifest = {k: (str(v) if k == "digest" else v) for k, v in row.asDict().items()}
    spark.createDataFrame([(json.dumps(manifest, sort_keys=True),)], "value string").coalesce(1).write.text(f"{staging}/manifest")
    _digests(spark, f"{staging}/catalog").write.json(f"{staging}/files")
    _rename(spark, staging, path)
    return manifest


def changed_files(spark: SparkSession, path: str) -> DataFrame:
    """Files of a bundle that are missing, new or not as their digest says."""
    listed = spark.read.schema("name string, bytes long, sha256 string").json(f"{path}/files").withColumnsRenamed({"bytes": "bytes_listed", "sha256": "listed"})
    both = _digests(spark, f"{path}/catalog").join(listed, "name", "full_outer")
    return both.where(~F.col("sha256").eqNullSafe(F.col("listed")) | ~F.col("bytes").eqNullSafe(F.col("bytes_listed")))
