"""Saves, lists, reactions and reviews: upserts, set differences, totals and nested aggregates.

Tables are DataFrames and every write is a function from old rows and new rows to the rows that stand afterwards, so a
caller can overwrite a partition or merge into a table format.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def newest_reaction() -> list[Column]:
    """By time, then order and line; the name decides what is left."""
    return [F.desc("updated_at"), F.desc("order_id"), F.desc("line"), F.asc("reaction")]


def latest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """First row of each key under an order."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_rn = 1").drop("_rn")


def upsert(old: DataFrame, new: DataFrame, keys: list[str], keep: list[str] | None = None) -> DataFrame:
    """Rows of new replace rows of old with their key, but for the columns to keep; all columns of old. new must be unique by key."""
    keep = keep or []
    o, n = old.alias("o"), new.withColumn("_new", F.lit(True)).alias("n")
    joined = o.join(n, keys, "full_outer")
    has = F.coalesce(F.col("_new"), F.lit(False))
    cols = [F.col(c) if c in keys else (F.coalesce(F.col(f"o.{c}"), F.col(f"n.{c}")) if c in keep else F.when(has, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}"))).alias(c) for c in old.columns]
    return joined.select(*cols)


def insert_new(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of new whose key old doesn't hold, one for each key; what `on conflict do nothing` would insert."""
    return new.dropDuplicates(keys).join(old.select(*keys), keys, "left_anti")


def fill_missing(old: DataFrame, staged: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Values from staging only where old has none."""
    s = staged.select(*keys, *[F.col(c).alias(f"_s_{c}") for c in columns])
    return old.join(s, keys, "left").withColumns({c: F.coalesce(c, f"_s_{c}") for c in columns}).drop(*[f"_s_{c}" for c in columns])


def delete(old: DataFrame, keys: DataFrame) -> DataFrame:
    return old.join(keys, keys.columns, "left_anti")


def membership_diff(current: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """keys with change: add or remove."""
    add = wanted.select(*keys).distinct().join(current, keys, "left_anti").withColumn("change", F.lit("add"))
    return add.unionByName(current.select(*keys).distinct().join(wanted, keys, "left_anti").withColumn("change", F.lit("remove")))


def complete_reorder(existing: DataFrame, given: DataFrame, list_key: str, item: str) -> DataFrame:
    """For each list whether the given items are exactly the existing ones, each once."""
    g = given.groupBy(list_key).agg(F.count(F.lit(1)).alias("n_given"), F.count_distinct(item).alias("n_distinct"))
    both = existing.select(list_key, item).distinct().join(given.select(list_key, item).distinct(), [list_key, item]).groupBy(list_key).agg(F.count(F.lit(1)).alias("n_both"))
    e = existing.groupBy(list_key).agg(F.count_distinct(item).alias("n_existing"))
    joined = e.join(g, list_key, "left").join(both, list_key, "left")
    ok = (F.col("n_given") == F.col("n_existing")) & (F.col("n_distinct") == F.col("n_existing")) & (F.col("n_both") == F.col("n_existing"))
    return joined.select(list_key, F.coalesce(ok, F.lit(False)).alias("complete"))


def reorder(items: DataFrame, list_key: str, item: str, order: list) -> DataFrame:
    """sort_order from the place in an array; items outside keep theirs."""
    spark = items.sparkSession
    ranks = spark.createDataFrame([(x, k) for k, x in enumerate(order)], f"{item} {items.schema[item].dataType.simpleString()}, _rank int")
    return items.join(F.broadcast(ranks), item, "left").withColumn("sort_order", F.coalesce("_rank", "sort_order").cast("int")).drop("_rank")


def adopt_slugs(lists: DataFrame, names: dict[str, str]) -> DataFrame:
    """Gives each user's first list of a known name (trimmed, lower case) its slug, and each user exactly one default list.

    A slug that a user has already is not given again. The default is the list with slug `saved`, else the oldest.
    """
    known = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    wanted = F.coalesce(F.col("slug"), F.try_element_at(known, F.lower(F.trim("name"))))
    by_slug = Window.partitionBy("user_id", "wanted").orderBy(F.col("slug").isNull(), "created_at", "list_id")
    out = lists.withColumn("wanted", wanted).withColumn("rn", F.row_number().over(by_slug))
    out = out.withColumn("slug", F.when(F.col("rn") == 1, F.col("wanted")).otherwise(F.col("slug"))).drop("wanted", "rn")
    by_user = Window.partitionBy("user_id").orderBy(F.coalesce(F.col("slug") == "saved", F.lit(False)).desc(), "created_at", "list_id")
    return out.withColumn("is_default", F.row_number().over(by_user) == 1)


def page_with_total(df: DataFrame, order: list[Column], offset: int, limit: int) -> DataFrame:
    """A page with the total beside each row; a page past the end has no rows. The count is a scalar of its own, so no task sees all rows."""
    total = df.agg(F.count(F.lit(1)).alias("total"))
    return df.orderBy(*order).offset(offset).limit(limit).crossJoin(F.broadcast(total))  # one row


def place_reviews(places: DataFrame, reviews: DataFrame, users: DataFrame) -> DataFrame:
    """Every place with its reviews and their authors' names; a place without any keeps one row of nulls."""
    return places.select("id").join(reviews, F.col("id") == F.col("place_id"), "left").join(users, "user_id", "left")


def signal_rows(saves: DataFrame, reactions: DataFrame) -> DataFrame:
    """One row for each user: saves, wanted and reactions as sorted nested lists, empty lists where there is none."""
    s = saves.groupBy("user_id").agg(F.sort_array(F.collect_set("place_id")).alias("saved"), F.sort_array(F.collect_set(F.when(F.col("slug") == "saved", F.col("place_id")))).alias("wanted"))
    r = reactions.groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("reaction", "place_id"))).alias("reactions"))
    return s.join(r, "user_id", "full_outer").select("user_id", F.coalesce("saved", F.array().cast("array<bigint>")).alias("saved"), F.coalesce("wanted", F.array().cast("array<bigint>")).alias("wanted"), F.coalesce("reactions", F.array().cast("array<struct<reaction:string,place_id:bigint>>")).alias("reactions"))


def dashboard(saves: DataFrame, previews: int = 3) -> DataFrame:
    """For each user's list its size and the latest places."""
    one = latest(saves, ["user_id", "list_name", "place_id"], [F.desc("created_at"), F.desc("order_id"), F.desc("line")])
    ranked = one.withColumn("rn", F.row_number().over(Window.partitionBy("user_id", "list_name").orderBy(F.desc("created_at"), "place_id")))
    return ranked.groupBy("user_id", "list_name").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("rn") <= previews, F.struct("rn", "place_id")))), lambda x: x["place_id"].cast("string")), ",").alias("previews"))


def saved_state(page: DataFrame, saves: DataFrame, reactions: DataFrame, user_id: int) -> DataFrame:
    """A page of places with is_saved, the user's lists and their reaction."""
    own = saves.where(F.col("user_id") == user_id).groupBy("place_id").agg(F.array_join(F.sort_array(F.collect_set("list_name")), ",").alias("lists"))
    last = latest(reactions.where(F.col("user_id") == user_id), ["place_id"], newest_reaction()).select("place_id", "reaction")
    joined = page.join(own, page["id"] == own["place_id"], "left").drop("place_id").join(last, page["id"] == last["place_id"], "left").drop("place_id")
    return joined.withColumn("is_saved", F.col("lists").isNotNull())


def reactions_by_kind(reactions: DataFrame) -> DataFrame:
    """For each user the places of each kind of latest reaction, sorted."""
    last = latest(reactions, ["user_id", "place_id"], newest_reaction())
    kind = lambda k: F.array_join(F.sort_array(F.collect_list(F.when(F.col("reaction") == k, F.col("place_id")))), ",").alias(k)
    return last.groupBy("user_id").agg(kind("favorite"), kind("dislike"), kind("hide"))


def onboarding(picks: DataFrame, places: DataFrame) -> DataFrame:
    """For each user how many distinct known places they picked."""
    known = picks.join(places.select(F.col("id").alias("place_id")), "place_id", "left_semi")
    return known.select("user_id", "place_id").distinct().groupBy("user_id").agg(F.count(F.lit(1)).alias("n_picks"))
