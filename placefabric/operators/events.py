"""The interaction log: validation, deduplication, identity, serving receipts, daily export and labelled impressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Fixed values.
KNOWN_TYPES = ("view", "click", "purchase", "signup")
RETENTION_FLOOR_DAYS = 2
_UUID = r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"


def day_slice(events: DataFrame, start: str, end: str) -> DataFrame:
    """start <= server_ts < end, in UTC."""
    return events.where((F.col("server_ts") >= F.lit(start).cast("timestamp")) & (F.col("server_ts") < F.lit(end).cast("timestamp")))


EVENT = "event_id string, event_type string, client_ts string, seq bigint, anon_id string, session_id string, surface string, context struct<request_id:string,position:int>, place_id string, payload string"


def validated(raw: DataFrame, column: str = "value", keep: list[str] | None = None) -> DataFrame:
    """JSON text -> parsed event with reject_reason (null if accepted), in the order object, id, type, time, and the columns to keep."""
    body = F.trim(F.col(column))
    e = F.from_json(F.when(F.startswith(body, F.lit("{")), F.col(column)), EVENT)
    reason = (
        F.when(~F.coalesce(F.startswith(body, F.lit("{")), F.lit(False)), "not_an_object")
        .when(~F.coalesce(e["event_id"].rlike(_UUID), F.lit(False)), "bad_event_id")
        .when(~F.coalesce(e["event_type"].rlike(r"^[a-z][a-z0-9_]{0,63}$"), F.lit(False)), "bad_event_type")
        .when(F.try_to_timestamp(e["client_ts"]).isNull(), "bad_client_ts")
    )
    kept = [F.col(c).alias(c.rpartition(".")[2]) for c in keep or []]
    return raw.select(e.alias("e"), reason.alias("reject_reason"), *kept).select("e.*", "reject_reason", *[c.rpartition(".")[2] for c in keep or []], F.coalesce(F.col("e.event_type").isin(*KNOWN_TYPES), F.lit(False)).alias("known_type"))


def batch_outcome(accepted: DataFrame, store: DataFrame) -> DataFrame:
    """accepted, inserted and duplicates of a batch against the store (duplicates within the batch count too)."""
    fresh = accepted.dropDuplicates(["event_id"]).join(store.select("event_id"), "event_id", "left_anti")
    n, k = accepted.agg(F.count(F.lit(1)).alias("accepted")), fresh.agg(F.count(F.lit(1)).alias("inserted"))
    return n.crossJoin(k).withColumn("duplicates", F.col("accepted") - F.col("inserted"))  # one row each


def link_identities(events: DataFrame) -> DataFrame:
    """First link of every pair of an anonymous id and a user."""
    return events.where("anon_id is not null and user_id is not null").groupBy("anon_id", "user_id").agg(F.min("server_ts").alias("linked_at"))


def stitched(events: DataFrame, links: DataFrame) -> DataFrame:
    """Events with the user of their anonymous id where they have none: the latest link, ties by user."""
    last = links.groupBy("anon_id").agg(F.max_by("user_id", F.struct("linked_at", "user_id")).alias("linked_user"))
    return events.join(last, "anon_id", "left").withColumn("user_id", F.coalesce("user_id", "linked_user")).drop("linked_user")


def event_days(events: DataFrame, served: DataFrame) -> DataFrame:
    return events.select(F.to_date("server_ts").alias("day")).union(served.select(F.to_date("served_at"))).distinct()


def served_with_items(served: DataFrame, items: DataFrame) -> DataFrame:
    return served.join(items, "request_id")


def first_impressions(events: DataFrame, impression: str = "view") -> DataFrame:
    """First impression of each (request, place), ties by event id."""
    first = Window.partitionBy("request_id", "place_id").orderBy("server_ts", "event_id")
    return events.where(F.col("event_type") == impression).withColumn("_rn", F.row_number().over(first)).where("_rn = 1").drop("_rn")


def labelled_impressions(day: DataFrame, all_events: DataFrame, served: DataFrame, items: DataFrame, dwell_of: str = "click") -> DataFrame:
    """Impressions of a day with their serving receipt and what followed at any time, for training.

    The actions are aggregated by (request, place) before the join, so that it has one row for a key; a place served
    twice in a request keeps both positions.
    """
    shown = first_impressions(day).select("request_id", "place_id", "user_id", "server_ts", "event_id")
    other = all_events.where(F.col("event_type") != "view")
    actions = other.groupBy("request_id", "place_id").agg(
        F.array_join(F.array_sort(F.collect_set("event_type")), ",").alias("actions"),
        F.max(F.when(F.col("event_type") == dwell_of, F.col("value"))).alias("max_dwell"),
        F.count(F.lit(1)).alias("n_actions"),
    )
    out = shown.join(served, "request_id", "left").join(items, ["request_id", "place_id"], "left").join(actions, ["request_id", "place_id"], "left")
    return out.select("request_id", "place_id", F.coalesce("user_id", "served_user").alias("user_id"), "event_id", "version", "position", "score", F.coalesce("actions", F.lit("")).alias("actions"), "max_dwell", F.coalesce("n_actions", F.lit(0)).alias("n_actions"))


def weighted_labels(impressions: DataFrame, weights: dict[str, float]) -> DataFrame:
    """Label of each impression: the largest price among its actions."""
    prices = F.create_map(*[x for k, v in weights.items() for x in (F.lit(k), F.lit(float(v)))])
    best = F.array_max(F.transform(F.split("actions", ","), lambda a: F.coalesce(F.try_element_at(prices, a), F.lit(0.0))))
    return impressions.withColumn("label", best)


def export_day(df: DataFrame, path: str, day: Column) -> None:
    """Writes rows into their day's partition; a day that is written again replaces itself."""
    df.withColumn("event_date", day).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("event_date").parquet(path)


def retention(days: DataFrame, archived: DataFrame, today: str, keep_days: int) -> DataFrame:
    """day, deleted: a day goes when it is old enough (never under two days) and its three archives exist."""
    keep = max(keep_days, RETENTION_FLOOR_DAYS)
    full = archived.groupBy("day").agg(F.count_distinct("dataset").alias("n")).where("n = 3").select("day", F.lit(True).alias("full"))
    old = F.col("day") < F.date_sub(F.lit(today).cast("date"), keep)
    return days.join(full, "day", "left").select("day", (old & F.coalesce("full", F.lit(False))).alias("deleted"))
