"""Merges on files rewrite what they hit and nothing else; days go when their archives are there."""

import pytest
from pyspark.sql import functions as F

from placefabric.sources.bucketed import BucketedTable, drop_archived_days

ROW = "id long, name string"


def files(path):
    return {str(f.relative_to(path)) for f in path.rglob("*.parquet")}


def rows(t):
    return {(r.id, r.name) for r in t.read().collect()}


def test_untouched_files_keep_their_names(spark, tmp_path):
    t = BucketedTable(spark, str(tmp_path / "t"), ["id"], 16)
    t.create(spark.range(500).select("id", F.concat(F.lit("n"), "id").alias("name")))
    before = files(tmp_path / "t")
    changes = spark.createDataFrame([(3, "three"), (7, None), (None, "no key")], ROW)
    hit = t.merge(changes)
    after = files(tmp_path / "t")
    assert 1 <= len(hit) <= 2
    assert {f for f in before if int(f.split("/")[0][7:]) not in hit} == {f for f in after if int(f.split("/")[0][7:]) not in hit}
    assert not {f for f in before if int(f.split("/")[0][7:]) in hit} & after
    assert rows(t) == {(k, {3: "three", 7: None}.get(k, f"n{k}")) for k in range(500)}
    assert t.merge(changes.where("id is null")) == [] and files(tmp_path / "t") == after


def test_inserts_deletes_and_emptied_buckets(spark, tmp_path):
    t = BucketedTable(spark, str(tmp_path / "t"), ["id"], 4)
    t.create(spark.range(6).select("id", F.lit("x").alias("name")))
    with pytest.raises(Exception, match="ALREADY_EXISTS|already exists"):
        t.create(spark.range(1).select("id", F.lit("y").alias("name")))
    gone = spark.createDataFrame([(k, "x", True) for k in range(6)] + [(99, "new", False), (98, "newer", None)], ROW + ", gone boolean")
    t.merge(gone, "gone")
    assert rows(t) == {(99, "new"), (98, "newer")}


def test_only_archived_old_days_go(spark, tmp_path):
    log = spark.createDataFrame([(k, f"2024-01-0{1 + k % 5}") for k in range(50)], "id int, day string").select("id", F.col("day").cast("date").alias("event_date"))
    log.write.partitionBy("event_date").parquet(str(tmp_path / "log"))
    before = files(tmp_path / "log")
    archived = spark.createDataFrame([(d, s) for d in ("2024-01-01", "2024-01-02", "2024-01-05") for s in "abc"] + [("2024-01-03", "a")], "d string, dataset string").select(F.col("d").cast("date").alias("day"), "dataset")
    assert drop_archived_days(spark, str(tmp_path / "log"), archived, "2024-01-06", 2) == ["2024-01-01", "2024-01-02"]
    assert files(tmp_path / "log") == {f for f in before if "-01-01/" not in f and "-01-02/" not in f}
