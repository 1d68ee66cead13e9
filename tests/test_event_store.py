"""The event store: ids are unique for ever, a batch reads few files, a stopped writer does no harm."""

import random

import pytest
from pyspark.sql import functions as F

from placefabric.streaming.event_store import EventStore

EVENT = "event_id string, server_ts timestamp, value string"


def batch(spark, ids, day, value="x"):
    return spark.createDataFrame([(i, None, value) for i in ids], EVENT).withColumn("server_ts", F.to_timestamp(F.lit(day)))


def test_resending_after_years_adds_nothing(spark, tmp_path):
    store = EventStore(spark, str(tmp_path / "s"), 4)
    ids = [f"id{k}" for k in range(300)]
    assert store.append(batch(spark, ids, "2020-01-01 10:00:00")) == {"accepted": 300, "inserted": 300, "duplicates": 0}
    assert store.append(batch(spark, ids[:200] + ["new", "new", None], "2024-06-01 10:00:00", "again")) == {"accepted": 202, "inserted": 1, "duplicates": 201}
    assert store.append(batch(spark, ids, "2030-01-01 10:00:00", "again"))["inserted"] == 0
    rows = spark.read.parquet(store.path).collect()
    assert sorted(r.event_id for r in rows) == sorted([*ids, "new"]) and {r.value for r in rows if r.event_id != "new"} == {"x"}


def test_first_arrival_of_a_batch_stays(spark, tmp_path):
    store = EventStore(spark, str(tmp_path / "s"), 2)
    store.append(batch(spark, ["a"], "2024-01-02 00:00:00", "late").unionByName(batch(spark, ["a"], "2024-01-01 00:00:00", "b")).unionByName(batch(spark, ["a"], "2024-01-01 00:00:00", "a")))
    assert spark.read.parquet(store.path).first().value == "a"


def test_a_batch_reads_few_files(spark, tmp_path):
    store = EventStore(spark, str(tmp_path / "s"), 4)
    for k in range(6):
        store.append(batch(spark, [f"{k}-{j}" for j in range(200)], f"202{k}-01-01 00:00:00"))
    files = store.files().count()
    assert files == 24
    new = batch(spark, [f"fresh{j}" for j in range(2000)], "2029-01-01 00:00:00")
    assert store.to_read(new).count() <= 1  # 12,000 tests of files, one in a million passes
    old = batch(spark, ["2-17"], "2029-01-01 00:00:00")
    assert store.to_read(old).count() == 1
    assert [r.event_id for r in store.held(old.unionByName(new)).collect()] == ["2-17"]


def test_files_without_filter_are_read_and_mended(spark, tmp_path):
    store = EventStore(spark, str(tmp_path / "s"), 2)
    store.append(batch(spark, ["a", "b", "c"], "2024-01-01 00:00:00"))
    lost = batch(spark, ["d", "e"], "2024-01-02 00:00:00")  # what a writer that was stopped after its files leaves
    lost.select("*", store._keys()[0]).write.mode("append").partitionBy("bucket").parquet(store.path)
    assert store.append(batch(spark, ["a", "d", "e", "f"], "2024-01-03 00:00:00"))["inserted"] == 1
    assert store.files().join(store.filters(), "file", "left_anti").count() == 0
    assert store.append(lost)["inserted"] == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_random_deliveries_equal_a_set(spark, tmp_path, seed):
    r = random.Random(seed)
    store, seen = EventStore(spark, str(tmp_path / "s"), 3), set()
    for k in range(4):
        ids = [f"id{r.randrange(120)}" for _ in range(r.choice([0, 1, 40, 90]))]
        got = store.append(batch(spark, ids, f"2024-0{k + 1}-01 00:00:00"))
        assert got == {"accepted": len(ids), "inserted": len(set(ids) - seen), "duplicates": len(ids) - len(set(ids) - seen)}
        seen |= set(ids)
