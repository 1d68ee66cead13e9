"""A keyed table on files: rows lie by a bucket of their key's hash, and a merge rewrites the buckets that it hits.

A merge reads the buckets of its own keys and writes them anew; Spark puts the new files of a bucket in the place of the old when
the job commits, and files of other buckets stay as they are, names and all. A merge that fails before leaves the table unchanged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from placefabric.operators.events import retention


class BucketedTable:
    """key: the columns that name a row, never null. buckets is fixed when the table is made."""

    def __init__(self, spark: SparkSession, path: str, key: list[str], buckets: int = 64):
        self.spark, self.path, self.key, self.buckets = spark, path, key, buckets

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int").alias("bucket")

    def create(self, rows: DataFrame) -> None:
        """The first rows, one for each key; a table that is there is an error."""
        rows.select("*", self._bucket()).repartition(self.buckets, "bucket").write.mode("errorifexists").partitionBy("bucket").parquet(self.path)

    def read(self) -> DataFrame:
        return self.spark.read.parquet(self.path).drop("bucket")

    def hit(self, keys: DataFrame) -> list[int]:
        """Buckets of the keys, as many as the table has at most."""
        return sorted(r["bucket"] for r in keys.select(self._bucket()).distinct().collect())

    def merge(self, changes: DataFrame, deleted: str | None = None) -> list[int]:
        """Puts changes in: new rows, and rows of known keys in the place of the old. Returns the buckets written.

        changes: the table's columns, one row for each key, and if `deleted` names one a boolean column that takes a row out. Rows with
        a null in the key are left out. A bucket that loses its last row loses its files.
        """
        changes = changes.where(" and ".join(f"`{k}` is not null" for k in self.key))
        hit = self.hit(changes)
        if not hit:
            return []
        old = self.spark.read.parquet(self.path).where(F.col("bucket").isin(hit))  # the others are not opened
        gone = F.coalesce(F.col(deleted), F.lit(False)) if deleted else F.lit(False)
        kept = old.join(changes.select(*self.key), self.key, "left_anti").drop("bucket").withColumn("_gone", F.lit(False))
        new = changes.withColumn("_gone", gone).select(kept.columns)
        rows = kept.unionByName(new).where(~F.col("_gone")).drop("_gone").select("*", self._bucket())
        left = {r["bucket"] for r in rows.select("bucket").distinct().collect()} if deleted else set(hit)
        rows.repartition(len(hit), "bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(self.path)
        for b in sorted(set(hit) - left):
            _delete(self.spark, f"{self.path}/bucket={b}")
        return hit


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def drop_archived_days(spark: SparkSession, path: str, archived: DataFrame, today: str, keep_days: int, day: str = "event_date") -> list[str]:
    """Deletes the day partitions of a log that are old enough and whose three archives exist; returns these days.

    archived: day, dataset. Days come from the partitions' names, no file is read; other days keep their files.
    """
    days = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(path).select(F.col(day).cast("date").alias("day")).distinct()
    old = [str(r["day"]) for r in retention(days, archived, today, keep_days).where("deleted").collect()]  # days
    for d in sorted(old):
        _delete(spark, f"{path}/{day}={d}")
    return sorted(old)
