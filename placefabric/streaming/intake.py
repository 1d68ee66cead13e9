"""Structured Streaming intake of the interaction log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placefabric.operators.events import validated
from placefabric.streaming.event_store import BUCKETS, EventStore

HORIZON = "3 days"  # of deduplication in state; the event store has none


def json_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.text(path)


def accepted(lines: DataFrame) -> DataFrame:
    """Valid events with their arrival time."""
    return validated(lines).where("reject_reason is null").withColumn("server_ts", F.current_timestamp())


def rejected(lines: DataFrame) -> DataFrame:
    return validated(lines).where("reject_reason is not null")


MOST_EVENTS, MOST_BYTES = 500, 1 << 20  # of a batch


def batch_events(lines: DataFrame) -> DataFrame:
    """Batches as JSON text -> parsed events with batch_id and reject_reason (null if accepted).

    A batch that is no object with an array of events, holds over MOST_EVENTS or MOST_BYTES is refused as one row;
    a bad event is refused alone, and its batch stays.
    """
    b = F.from_json("value", "batch_id string, events array<string>")
    refused = F.when(F.octet_length("value") > MOST_BYTES, "too_large").when(b["events"].isNull(), "not_a_batch").when(F.size(b["events"]) > MOST_EVENTS, "too_many_events")
    rows = lines.select(b["batch_id"].alias("batch_id"), b["events"].alias("events"), refused.alias("refused"))
    each = rows.select("batch_id", "refused", F.explode_outer(F.when(F.col("refused").isNull(), F.col("events"))).alias("value")).where("refused is not null or value is not null")
    own = validated(each.withColumn("value", F.struct("value", "batch_id", "refused")), "value.value", keep=["value.batch_id", "value.refused"])
    return own.withColumn("reject_reason", F.coalesce("refused", "reject_reason")).drop("refused")


def to_end(stream: DataFrame, path: str, mode: str = "append") -> DataFrame:
    """Runs a stream over all that is there now, and returns what it wrote as a table. Batches are written again under their number, so a retried one adds nothing."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/out/{'all' if mode == 'complete' else f'batch={number}'}")

    run = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/progress").trigger(availableNow=True).foreachBatch(write).start()
    run.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/out/*")


def deduplicated(events: DataFrame, ts: str = "server_ts", horizon: str = HORIZON) -> DataFrame:
    """First event of each id within the horizon; state older than it is dropped."""
    return events.withWatermark(ts, horizon).dropDuplicatesWithinWatermark(["event_id"])


def windowed_counts(events: DataFrame, ts: str, width: str, slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    w = F.window(ts, width, slide) if slide else F.window(ts, width)
    events = events.withColumn(ts, F.col(ts).cast("timestamp"))  # event time has a zone; UTC sessions read it as it is
    return events.withWatermark(ts, late).groupBy(w.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


def store_batch(path: str, buckets: int = BUCKETS):
    """A foreachBatch sink into an event store: ids that it holds, from whenever, are left out; a retried batch adds nothing."""

    def write(batch: DataFrame, epoch: int) -> None:
        EventStore(batch.sparkSession, path, buckets).append(batch)

    return write


def actions_joined(impressions: DataFrame, actions: DataFrame, keys: list[str], within: str, late: str) -> DataFrame:
    """Streams of impressions (keys, event_id, ts) and actions (keys, event_id, ts) -> each impression with each action up to `within` after it.

    An impression without action comes once, with nulls, when the watermark says that none can follow. State is held for an
    impression until then and for an action until no earlier impression can arrive; both sides may be late by `late`.
    Events without one of the keys are never joined, and those of the actions don't move the watermark.
    """
    shown = impressions.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("event_id").alias("impression"), F.col("ts").alias("shown_at")).withWatermark("shown_at", late)
    done = actions.select(*keys, F.col("event_id").alias("action"), F.col("ts").alias("done_at")).withWatermark("done_at", late)
    match = (F.col("done_at") >= F.col("shown_at")) & (F.col("done_at") <= F.col("shown_at") + F.expr(f"interval {within}"))
    for k in keys:
        match = match & (F.col(k) == F.col(f"_{k}"))
    joined = shown.join(done, match, "left_outer").drop(*keys)
    return joined.select(*[F.col(f"_{k}").alias(k) for k in keys], "impression", "shown_at", "action", "done_at")
