"""An append-only event store in which an id is stored once, for ever.

Events lie in Parquet files by a bucket of their id's hash, in the order of their arrival, so that reading a day skips what
came on others. Beside the files stands a Bloom filter of the ids of each. A batch asks the filters of its own buckets alone, reads the ids of those files that may hold one of its events, and
adds the rest. A file without a filter, as a writer that was stopped may leave it, is read whenever its bucket is asked
and gets its filter with the next batch; so a batch that is delivered again, at once or after years, adds nothing.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 16
BITS, HASHES = 32, 12  # of a filter for each id: about one in a million others passes
FILE_ROWS = 4_000_000  # of a file at most, as one task makes its filter


def _name(path: str) -> Column:
    """A file by bucket and name; a name alone stands in several buckets."""
    return F.regexp_extract(path, "([^/]+/[^/]+)$", 1).alias("file")


def _bits(first: np.ndarray, second: np.ndarray, size: int) -> np.ndarray:
    """Places of each id in a filter of so many bits: one row for each id."""
    with np.errstate(over="ignore"):
        at = first.astype(np.uint64)[:, None] + np.arange(HASHES, dtype=np.uint64) * (second.astype(np.uint64)[:, None] | np.uint64(1))
    return at % np.uint64(size)


def _filter(pdf: pd.DataFrame) -> pd.DataFrame:
    """Filters of one file's ids."""
    size = max(64, BITS * len(pdf))
    bits = np.zeros(size, bool)
    bits[_bits(pdf.h1.to_numpy(), pdf.h2.to_numpy(), size).ravel()] = True
    return pd.DataFrame({"bucket": [int(pdf.bucket.iloc[0])], "file": pd.Series([pdf.file.iloc[0]], dtype=object), "n": [len(pdf)], "size": [size], "bits": [np.packbits(bits).tobytes()]})


def _hits(ids: pd.DataFrame, filters: pd.DataFrame) -> pd.DataFrame:
    """Files of one bucket whose filter passes one of the ids."""
    found = []
    if len(ids):
        for file, size, data in zip(filters.file, filters["size"], filters.bits, strict=True):
            at = _bits(ids.h1.to_numpy(), ids.h2.to_numpy(), size)
            byte = np.frombuffer(data, np.uint8)
            if ((byte[at >> np.uint64(3)] >> (np.uint64(7) - (at & np.uint64(7))).astype(np.uint8)) & 1).all(1).any():
                found.append(file)
    return pd.DataFrame({"file": pd.Series(found, dtype=object)})


class EventStore:
    """buckets is fixed when the store begins; more of them mean fewer and smaller filters for a batch to ask."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark, self.path, self.buckets = spark, path, buckets
        self.filters_path = f"{path}/_filters"  # readers of the store pass over names with an underscore

    def _exists(self, path: str) -> bool:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        fs = p.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return fs.exists(p) and len(fs.listStatus(p)) > 0

    def _keys(self, event_id: str = "event_id") -> list[Column]:
        return [F.pmod(F.xxhash64(event_id), F.lit(self.buckets)).cast("int").alias("bucket"), F.xxhash64(event_id, F.lit(1)).alias("h1"), F.xxhash64(event_id, F.lit(2)).alias("h2")]

    def files(self) -> DataFrame:
        """path, file (its last two parts) and bucket of what is stored; names alone are read."""
        found = self.spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(self.path)
        return found.select("path", _name("path"), F.regexp_extract("path", "/bucket=([0-9]+)/", 1).cast("int").alias("bucket"))

    def filters(self) -> DataFrame:
        columns = "bucket int, file string, n long, size long, bits binary"
        if not self._exists(self.filters_path):
            return self.spark.createDataFrame([], columns)
        return self.spark.read.schema(columns).parquet(self.filters_path)

    def to_read(self, ids: DataFrame) -> DataFrame:
        """ids (event_id) -> path of each file that may hold one of them."""
        own = ids.select(*self._keys())
        buckets = own.select("bucket").distinct()
        kept = self.filters()
        hit = own.groupBy("bucket").cogroup(kept.join(buckets, "bucket", "left_semi").groupBy("bucket")).applyInPandas(_hits, "file string")
        files = self.files()
        bare = files.join(buckets, "bucket", "left_semi").join(kept.select("file"), "file", "left_anti")
        return files.join(hit, "file", "left_semi").select("path").unionByName(bare.select("path"))

    def held(self, ids: DataFrame) -> DataFrame:
        """Those of the ids (event_id) that are stored. The paths of the files to read reach the driver, as for any read."""
        nothing = self.spark.createDataFrame([], "event_id string")
        if not self._exists(self.path):
            return nothing
        paths = [r["path"] for r in self.to_read(ids).collect()]
        if not paths:
            return nothing
        stored = self.spark.read.schema("event_id string").option("basePath", self.path).parquet(*paths).select("event_id")
        return stored.join(ids.select("event_id"), "event_id", "left_semi").distinct()

    def append(self, batch: DataFrame) -> dict[str, int]:
        """Adds the events (event_id string, server_ts, ...) whose id isn't stored: counts of accepted, inserted and duplicates.

        Of events of one id in the batch the one that arrived first stays, ties by their content. Events without id are
        refused and count as neither.
        """
        batch = batch.where("event_id is not null")
        accepted = batch.count()
        if self._exists(self.path):
            self.index()  # of a writer that was stopped
        before = self.size()
        row = F.struct(*batch.columns)
        one = batch.groupBy("event_id").agg(F.min_by(row, F.struct("server_ts", F.to_json(row))).alias("_row")).select("_row.*")
        fresh = one.join(self.held(batch.select("event_id").distinct()), "event_id", "left_anti")
        dealt = fresh.select("*", self._keys()[0]).repartition("bucket").sortWithinPartitions("bucket", "server_ts")
        dealt.write.mode("append").option("maxRecordsPerFile", FILE_ROWS).partitionBy("bucket").parquet(self.path)
        self.index()
        inserted = self.size() - before
        return {"accepted": accepted, "inserted": inserted, "duplicates": accepted - inserted}

    def size(self) -> int:
        """Events of files with a filter."""
        return self.filters().agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]

    def index(self) -> None:
        """Makes the filters of files that have none."""
        bare = [r["path"] for r in self.files().join(self.filters().select("file"), "file", "left_anti").select("path").collect()]
        if bare:
            ids = self.spark.read.schema("event_id string").option("basePath", self.path).parquet(*bare).select(*self._keys(), _name("_metadata.file_path"))
            ids.groupBy("file").applyInPandas(_filter, "bucket int, file string, n long, size long, bits binary").write.mode("append").partitionBy("bucket").parquet(self.filters_path)
