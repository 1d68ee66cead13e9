"""Ranked fuzzy search and category browse."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placefabric.functions import geo, text
from placefabric.operators.geo import clamp, resolve_city
from placefabric.operators.text_index import TrigramIndex, may_match

SIMILAR = 0.3
MOST = 50

#: Keywords of the browse buckets.
BUCKETS = {
    "cafe": ("cafe", "coffee", "coffee shop", "bakery", "tea house"),
    "restaurant": ("restaurant", "bistro", "pizzeria", "food"),
    "bar": ("bar", "pub", "wine bar", "cocktail bar", "brewery"),
    "museum": ("museum", "gallery", "art gallery"),
    "park": ("park", "garden", "botanical garden"),
    "nightlife": ("night club", "club", "bar"),
    "shopping": ("shop", "store", "market", "shopping mall"),
}


def bucket_keywords(buckets: list[str]) -> list[str]:
    """Union of the buckets' keywords, first occurrence kept; unknown buckets add nothing."""
    return list(dict.fromkeys(k for b in buckets for k in BUCKETS.get(b, ())))


def category_filter(keywords: list[str]) -> Column:
    """A keyword as whole words of the category or of the primary type, each on its own."""
    return text.has_keyword(text.norm(F.col("category")), keywords) | text.has_keyword(text.norm(F.col("primary_type")), keywords)


def haystack_filter(keywords: list[str]) -> Column:
    """The looser form over category and type joined, where a keyword may span the seam."""
    return text.has_keyword(F.concat_ws(" ", text.norm(F.col("category")), text.norm(F.col("primary_type"))), keywords)


def search_score(distance: Column | None, city: str | None, country: str | None, q: str) -> Column:
    near = 10 / (1 + distance) if distance is not None else F.lit(0.0)
    at = lambda c, v: F.when(text.norm(F.col(c)) == v, 1).otherwise(0) if v else F.lit(0)
    return (
        100 * F.greatest("name_similarity", 0.6 * F.greatest("category_similarity", "type_similarity"))
        + F.when(F.col("name_norm") == q, 30).otherwise(0) + F.when(F.startswith("name_norm", F.lit(q)), 15).otherwise(0)
        + 12 * at("city", city) + 6 * at("country", country) + near
        + 8 * F.coalesce("visibility", F.lit(0.0)) / 100 + 5 * F.coalesce("popularity", F.lit(0.0)) / 100
    )


def search(places: DataFrame, q: str | None, lat: float | None = None, lng: float | None = None, city: str | None = None, country: str | None = None, keywords: list[str] | None = None, radius_m: float | None = None, limit: int | None = None, index: TrigramIndex | None = None) -> DataFrame:
    """One of four plans: text, browse by city, browse by distance, browse by score; none without a query and keywords.

    The text plan looks for the best run of trigrams only in rows whose name has enough of the query's, which a count of the
    row's own trigrams tells, or an index of the folded names.
    """
    q = " ".join((q or "").lower().split())
    q = q if len(q) >= 2 else ""
    n = clamp(limit, 20, MOST)
    distance = geo.haversine_km(F.col("lat"), F.col("lng"), lat, lng) if lat is not None and lng is not None else None
    if city is None and distance is not None:
        found = resolve_city(places, lat, lng).first()  # one row
        city = found["city"] if found else None
    city = city.lower().strip() if city else None
    rows = places.withColumn("distance_km", distance if distance is not None else F.lit(None).cast("double"))
    if keywords:
        rows = rows.where(category_filter(keywords))
    if city:
        rows = rows.where(text.norm(F.col("city")) == city)
    if radius_m is not None and distance is not None:
        rows = rows.where(F.col("distance_km") * 1000 <= radius_m)
    if not q:
        if not keywords:
            return rows.limit(0).withColumn("search_score", F.lit(None).cast("double"))
        keys = [F.asc_nulls_last("distance_km")] if distance is not None else []
        return rows.withColumn("search_score", F.coalesce("visibility", F.lit(0.0))).orderBy(*keys, F.desc("search_score"), "id").limit(n)
    similar, typed = text.word_similarity(q), text.has_keyword(text.norm(F.col("primary_type")), [q])
    if index is None:
        rows = rows.where(may_match(text.norm(F.col("name")), q, SIMILAR) | typed)
    else:
        asked = places.sparkSession.createDataFrame([(q,)], "q string")
        named = index.candidates(asked, SIMILAR).select(F.col("text").alias("_name"), F.lit(True).alias("_named"))
        rows = rows.join(named, text.norm(F.col("name")) == F.col("_name"), "left").where(F.col("_named") | typed).drop("_name", "_named")
    rows = rows.withColumns({"name_norm": text.norm(F.col("name")), "name_similarity": similar(text.norm(F.col("name"))), "category_similarity": similar(text.norm(F.col("category"))), "type_similarity": similar(text.norm(F.col("primary_type")))})
    rows = rows.where((F.col("name_similarity") >= SIMILAR) | typed)
    reason = F.when(F.col("name_similarity") >= F.greatest("category_similarity", "type_similarity"), "name").when(F.col("category_similarity") >= F.col("type_similarity"), "category").otherwise("type")
    rows = rows.withColumn("search_score", search_score(distance, city, country.lower() if country else None, q)).withColumn("match_reason", reason)
    return rows.orderBy(F.desc("search_score"), "id").limit(n)


def keyword_search(places: DataFrame, query: str, limit: int = 20) -> DataFrame:
    """Rows by how many words of the query occur in their text, then by visibility."""
    words = query.lower().split()
    hay = F.lower(F.concat_ws(" ", "name", "category", "primary_type", "city"))
    scored = places.withColumn("matched", text.words_matched(hay, words)).where("matched > 0")
    return scored.orderBy(F.desc("matched"), F.desc_nulls_last("visibility"), "id").limit(limit)


def tiered_search(places: DataFrame, query: str, limit: int = 20) -> DataFrame:
    """Tiers: equal name, name begins with it, all words in the name, all words anywhere; then visibility, name, id."""
    q = " ".join(query.lower().split())
    words = q.split()
    name, hay = text.fold(F.col("name")), text.fold(F.concat_ws(" ", "name", "category", "primary_type"))
    every = lambda h: text.words_matched(h, words) == len(words)
    tier = F.when(name == q, 0).when(F.startswith(name, F.lit(q)), 1).when(every(name), 2).when(every(hay), 3)
    return places.withColumn("tier", tier).where("tier is not null").orderBy("tier", F.desc_nulls_last("visibility"), "name", "id").limit(limit)


def list_categories(places: DataFrame, query: str, limit: int = 20) -> DataFrame:
    return places.where(F.contains(F.col("primary_type"), F.lit(query.lower()))).groupBy("primary_type").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "primary_type").limit(limit)
