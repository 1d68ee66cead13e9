"""Feeds: the quality-ranked fallback, and the personal one from a user's signals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from placefabric.functions import geo, text
from placefabric.operators.geo import clamp
from placefabric.operators.search import category_filter


def feed_score(country: str | None, distance: Column | None) -> Column:
    same = F.when(text.norm(F.col("country")) == country, 10).otherwise(0) if country else F.lit(0)
    near = 25 / (1 + distance) if distance is not None else F.lit(0.0)
    return F.coalesce("visibility", F.lit(0.0)) + 0.20 * F.coalesce(F.col("rating") * 20, F.lit(0.0)) + 0.15 * F.coalesce("popularity", F.lit(0.0)) + same + near


def scored_feed(places: DataFrame, city: str | None = None, country: str | None = None, lat: float | None = None, lng: float | None = None, keywords: list[str] | None = None) -> DataFrame:
    """All places of a city with their feed_score, in no order and without a cut."""
    distance = geo.haversine_km(F.col("lat"), F.col("lng"), lat, lng) if lat is not None and lng is not None else None
    if city is not None:
        places = places.where(text.norm(F.col("city")) == city.lower())
    if keywords:
        places = places.where(category_filter(keywords))
    return places.withColumn("feed_score", feed_score(country.lower() if country else None, distance))


def fallback_feed(places: DataFrame, city: str | None = None, country: str | None = None, lat: float | None = None, lng: float | None = None, keywords: list[str] | None = None, limit: int | None = None) -> DataFrame:
    """Best places of a city: ranked on narrow columns, cut, and only the winners joined back to their full rows."""
    ranked = scored_feed(places, city, country, lat, lng, keywords).select("id", "feed_score", "visibility", "rating", "reviews_count")
    order = [F.desc("feed_score"), F.desc_nulls_last("visibility"), F.desc_nulls_last("rating"), F.desc_nulls_last("reviews_count"), F.asc("id")]
    top = ranked.orderBy(*order).limit(clamp(limit, 50, 200)).select("id", "feed_score")  # 200 rows at most
    return places.join(F.broadcast(top), "id").orderBy(*order)


def card(places: DataFrame) -> DataFrame:
    """The card of a row: blurb, up to four tags, a whole score of 0 to 100, and why it is shown."""
    tags = F.slice(F.filter(F.array("category", "primary_type", "theme", "confidence"), lambda t: t.isNotNull() & (F.trim(t) != "")), 1, 4)
    whole = F.floor(F.least(F.lit(100.0), F.greatest(F.lit(0.0), F.coalesce("visibility", F.lit(0.0)))) + 0.5).cast("int")
    why = F.when(F.col("rating") >= 4, "Highly rated").when(F.col("popularity") >= 80, "Popular").otherwise("Nearby")
    return places.select("id", F.coalesce("name", "category", F.lit("Place")).alias("title"), tags.alias("tags"), whole.alias("score"), why.alias("why"))


def eligible(pool: DataFrame, min_visibility: float | None = None, city: str | None = None, theme: str | None = None, low_confidence: bool = False) -> DataFrame:
    """The candidate pool: confidence, visibility, city and theme, each only if asked for."""
    if not low_confidence:
        pool = pool.where(F.coalesce(F.lower("confidence"), F.lit("")) != "low")
    if min_visibility is not None:
        pool = pool.where(F.coalesce("visibility", F.lit(0.0)) >= min_visibility)
    if city is not None:
        pool = pool.where(F.coalesce(F.lower("city"), F.lit("")) == city.lower())
    if theme is not None:
        pool = pool.where(F.coalesce("theme", F.lit("")) == theme)
    return pool


def not_denied(pool: DataFrame, types: list[str], tags: list[str]) -> DataFrame:
    own = F.transform(F.filter(F.array("category", "theme"), lambda t: t.isNotNull()), lambda t: F.lower(t))
    return pool.where(~F.coalesce(F.col("primary_type").isin(types), F.lit(False)) & ~F.arrays_overlap(own, F.array(*[F.lit(t) for t in tags])))


def page_by_distance(snapshot: DataFrame, lat: float, lng: float, offset: int, limit: int) -> DataFrame:
    """A page of a snapshot (with position) nearest first; rows without a place last; position decides ties and stays as it is."""
    d = geo.haversine_km(F.col("lat"), F.col("lng"), lat, lng)
    return snapshot.withColumn("distance_km", d).orderBy(F.asc_nulls_last("distance_km"), "position").offset(offset).limit(limit)


def signals(saves: DataFrame, reactions: DataFrame) -> DataFrame:
    """For each user and place one signal: favourite, want_to_go, dislike or hide.

    A reaction is the latest one. Favourites are favourite reactions and the saves that are neither wanted nor only been;
    if a user has neither derived saves nor wanted ones, all saves are favourites. A disliked or hidden place is no other.
    """
    last = Window.partitionBy("user_id", "place_id").orderBy(F.desc("updated_at"), F.desc("order_id"), F.desc("line"), "reaction")
    latest = reactions.withColumn("rn", F.row_number().over(last)).where("rn = 1").select("user_id", "place_id", "reaction")
    lists = saves.groupBy("user_id", "place_id").agg(F.max((F.col("slug") == "saved").cast("int")).alias("wanted"), F.min((F.col("slug") == "been").cast("int")).alias("only_been"))
    per_user = Window.partitionBy("user_id")
    lists = lists.withColumn("any", F.max(F.when((F.col("wanted") == 1) | (F.col("only_been") == 0), 1).otherwise(0)).over(per_user))
    kind = F.when(F.col("wanted") == 1, "want_to_go").when((F.col("only_been") == 0) | (F.col("any") == 0), "favourite")
    derived = lists.select("user_id", "place_id", kind.alias("derived"))
    joined = derived.join(latest, ["user_id", "place_id"], "full_outer")
    signal = F.when(F.col("reaction").isin("dislike", "hide"), F.col("reaction")).when(F.col("reaction") == "favorite", "favourite").otherwise(F.col("derived"))
    return joined.select("user_id", "place_id", signal.alias("signal")).where("signal is not null")
