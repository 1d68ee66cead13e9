import json

import pytest
from pyspark.sql import functions as F

from placefabric.operators.events import EVENT
from placefabric.sources import readers, sinks
from placefabric.streaming import intake


def test_csv_round_trip(spark, tmp_path):
    path = tmp_path / "p.csv"
    path.write_bytes('﻿source_id,name,primary_type,city,latitude,longitude,rating,opening_hours\n18000000000000459302,"Two\nlines ""q""",cafe,,44.5,26.1,4.5,\n'.encode())
    r = readers.csv(spark, str(path), readers.PLACES).collect()
    assert len(r) == 1 and r[0].source_id == "18000000000000459302" and r[0].name == 'Two\nlines "q"' and r[0].city is None
    sinks.csv(spark.createDataFrame([(1, ["a", "b"], None)], "id int, tags array<string>, x string"), str(tmp_path / "out"))
    assert '["a","b"]' in spark.read.csv(str(tmp_path / "out"), header=True, escape='"').first().tags


def test_jsonl_skips_blank_and_broken(spark, tmp_path):
    from pyspark.sql.types import StringType, StructField, StructType

    (tmp_path / "a.jsonl").write_text('{"cid": "1"}\n\n  \n{"cid": "2"}\n')
    assert [r.cid for r in readers.jsonl(spark, str(tmp_path / "a.jsonl"), StructType([StructField("cid", StringType())])).orderBy("line_order").collect()] == ["1", "2"]


def test_matrix_checks_ids(spark, tmp_path):
    import numpy as np
    import pytest

    np.save(tmp_path / "m.npy", np.arange(6, dtype="float32").reshape(3, 2))
    files = spark.read.format("binaryFile").load(str(tmp_path / "m.npy"))
    path = files.first().path
    ids = lambda names: spark.createDataFrame([(path, k, n) for k, n in enumerate(names)], "path string, row long, place_id string")
    got = readers.matrix(files, ids(["a", "b", "c"])).collect()
    assert {(r.place_id, *r.vector) for r in got} == {("a", 0, 1), ("b", 2, 3), ("c", 4, 5)}
    for wrong in (["a", "a", "c"], ["a", "b"], ["a", "b", "c", "d"]):
        with pytest.raises(ValueError):
            readers.matrix(files, ids(wrong))


def test_parquet_by_day_replaces_one_day(spark, tmp_path):
    df = spark.createDataFrame([(1, "2024-01-01"), (2, "2024-01-02")], "id int, event_date string")
    sinks.parquet_by_day(df, str(tmp_path / "x"))
    sinks.parquet_by_day(df.where("id = 2").withColumn("id", F.lit(9)), str(tmp_path / "x"))
    assert sorted(r.id for r in spark.read.parquet(str(tmp_path / "x")).collect()) == [1, 9]


def test_bundle_manifest(spark, sf, tmp_path):
    from placefabric.plans.testmap import entity

    m = sinks.bundle(entity(spark, sf, "places"), str(tmp_path / "b"))
    again = sinks.bundle(entity(spark, sf, "places").orderBy(F.desc("id")), str(tmp_path / "c"))
    assert m["rows"] == m["keys"] and m == again
    assert json.loads(spark.read.text(str(tmp_path / "b/manifest")).first().value) == m
    assert sinks.changed_files(spark, str(tmp_path / "b")).count() == 0
    with pytest.raises(FileExistsError):
        sinks.bundle(entity(spark, sf, "places"), str(tmp_path / "b"))
    part = next((tmp_path / "b/catalog").glob("*.parquet"))
    part.rename(part.with_name("other.parquet"))
    assert sinks.changed_files(spark, str(tmp_path / "b")).count() == 2


def test_batch_requests(spark, tmp_path):
    sinks.batch_requests(spark.createDataFrame([("location_1_x", "a"), ("location_2_x", "b")], "custom_id string, text string"), str(tmp_path / "r"), "m")
    c = sinks.check_requests(spark.read.json(str(tmp_path / "r"))).first()
    assert (c.n, c.n_ids, c.methods, c.models) == (2, 2, ["POST"], ["m"])


def _event(k, kind="view"):
    return json.dumps({"event_id": f"00000000-0000-4000-8000-{k:012d}", "event_type": kind, "client_ts": "2024-01-01T00:00:00Z"})


def test_intake_stream_is_idempotent(spark, tmp_path):
    src, store = tmp_path / "in", str(tmp_path / "store")
    src.mkdir()
    for name, lines in (("a", [_event(1), _event(2), _event(2), "nope", "[1]"]), ("b", [_event(2), _event(3, "brand_new")])):
        (src / f"{name}.jsonl").write_text("\n".join(lines))
        q = intake.accepted(intake.json_lines(spark, str(src))).writeStream.foreachBatch(intake.store_batch(store)).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination(120)
    got = spark.read.parquet(store)
    assert got.count() == 3 and got.where("not known_type").count() == 1
    assert EVENT.split()[0] in got.columns


def test_windowed_stream(spark, sf, tmp_path):
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    s = spark.readStream.schema(schema).parquet(f"{sf}/events.parquet*")
    q = intake.windowed_counts(s, "ts", "1 hour").writeStream.format("memory").queryName("w").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.sql("select sum(n) as n from w").first().n == spark.read.parquet(f"{sf}/events.parquet").count()


def test_dedupe_within_watermark(spark, tmp_path):
    src = tmp_path / "in"
    spark.createDataFrame([("a", "2024-01-01 00:00:00"), ("a", "2024-01-01 00:00:05"), ("b", "2024-01-01 00:00:01")], "event_id string, t string").select("event_id", F.col("t").cast("timestamp").alias("server_ts")).write.parquet(str(src))
    s = spark.readStream.schema("event_id string, server_ts timestamp").parquet(str(src))
    q = intake.deduplicated(s).writeStream.format("memory").queryName("d").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.sql("select * from d").count() == 2
