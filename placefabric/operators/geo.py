"""Map and catalog lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from placefabric.functions import geo
from placefabric.functions.text import stable_jitter

#: Score floors by largest zoom, and pins of a tile by largest zoom.
SCORE_FLOORS = ((9, 92), (11, 86), (13, 76), (15, 66), (17, 56))
TILE_CAPS = ((12, 6), (15, 10), (16, 15))
MOST_PINS, MOST_ROWS = 400, 1000


def clamp(limit: int | None, default: int, most: int) -> int:
    return min(max(default if limit is None else limit, 1), most)


def score_floor(zoom: int) -> int:
    return next((s for z, s in SCORE_FLOORS if zoom <= z), 0)


def tile_cap(zoom: int) -> int:
    return next((n for z, n in TILE_CAPS if zoom <= z), 25)


def tile_cap_of(zoom: Column) -> Column:
    """tile_cap of a column."""
    out: Column = F.lit(25)
    for z, n in reversed(TILE_CAPS):
        out = F.when(zoom <= z, n).otherwise(out)
    return out


def visibility_order() -> list[Column]:
    """The six keys of map pins; a total order."""
    return [F.desc_nulls_last(c) for c in ("visibility", "rating", "popularity", "google_rating", "google_count")] + [F.asc("id")]


def bbox(places: DataFrame, box: tuple[float, float, float, float], min_score: float | None = None, city: str | None = None, limit: int | None = None) -> DataFrame:
    """Places in (sw_lat, sw_lng, ne_lat, ne_lng), best first."""
    found = places.where(geo.in_box(F.col("lat"), F.col("lng"), *box))
    if min_score is not None:
        found = found.where(F.col("visibility") >= min_score)
    if city is not None:
        found = found.where(F.col("city") == city)
    return found.orderBy(*visibility_order()).limit(clamp(limit, 200, MOST_ROWS))


def legacy_order(places: DataFrame, box: tuple[float, float, float, float], limit: int | None = None) -> DataFrame:
    """The older ranking by rating and the logarithm of reviews."""
    rank = F.coalesce(F.col("rating"), F.lit(0.0)) * 10 + F.least(5 * F.log10(F.col("reviews_count") + 1), F.lit(20.0))
    return places.where(geo.in_box(F.col("lat"), F.col("lng"), *box)).withColumn("rank_score", rank).orderBy(F.desc("rank_score"), "id").limit(clamp(limit, 200, MOST_ROWS))


def with_primary_photo(places: DataFrame, photos: DataFrame) -> DataFrame:
    """Left join on source, place and path. photos must be unique on these."""
    p = photos.select(F.col("source").alias("_s"), F.col("photo_place").alias("_p"), F.col("path").alias("_path"), "url")
    return places.join(p, (F.col("source") == F.col("_s")) & (F.col("id") == F.col("_p")) & (F.col("photo_path") == F.col("_path")), "left").drop("_s", "_p", "_path")


def within(places: DataFrame, lat: float, lng: float, metres: float) -> DataFrame:
    """Places at most so far away with distance_km; a box prunes first."""
    dy, dx = geo.around(lat, metres / 1000)
    found = places.where(geo.in_box(F.col("lat"), F.col("lng"), lat - dy, lng - dx, lat + dy, lng + dx))
    return found.withColumn("distance_km", geo.haversine_km(F.col("lat"), F.col("lng"), lat, lng)).where(F.col("distance_km") * 1000 <= metres)


def nearest(places: DataFrame, lat: float, lng: float, limit: int) -> DataFrame:
    return places.withColumn("distance_km", geo.haversine_km(F.col("lat"), F.col("lng"), lat, lng)).orderBy("distance_km", "id").limit(limit)


def resolve_city(places: DataFrame, lat: float, lng: float, guard_m: float = 50_000) -> DataFrame:
    """City and country of the row nearest in planar degrees; no row if it is beyond the guard."""
    planar = F.pow(F.col("lat") - lat, 2) + F.pow(F.col("lng") - lng, 2)
    one = places.where("lat is not null and lng is not null").withColumn("_d", planar).orderBy("_d", "id").limit(1)
    return one.where(geo.haversine_km(F.col("lat"), F.col("lng"), lat, lng) * 1000 <= guard_m).select("city", "country", "id")


def tile_features(places: DataFrame, zooms: list[int]) -> DataFrame:
    """For every tile of every zoom: its best pins, with coordinates in the tile. The catalogue is read once and shuffled once, by tile."""
    each = []
    for z in zooms:
        x, y = geo.tile_local(F.col("lat"), F.col("lng"), z)
        each.append(F.struct(F.lit(z).alias("z"), geo.tile_x(F.col("lng"), z).alias("x"), geo.tile_y(F.col("lat"), z).alias("y"), x.alias("px"), y.alias("py")))
    t = places.select("*", F.explode(F.array(*each)).alias("_t")).select("*", "_t.*").drop("_t")
    rank = F.row_number().over(Window.partitionBy("z", "x", "y").orderBy(*visibility_order()))
    t = t.withColumn("rn", rank).where(F.col("rn") <= max(map(tile_cap, zooms), default=0)).where(F.col("rn") <= tile_cap_of(F.col("z")))
    return t.select("z", "x", "y", "rn", "id", "name", "category", "primary_type", "price_level", "visibility", "photo_path", "px", "py")


def pin_score() -> Column:
    return (
        2 * F.coalesce("visibility", F.lit(0.0)) + F.coalesce("rating", F.lit(0.0)) + 0.4 * F.coalesce("popularity", F.lit(0.0))
        + F.least(5 * F.log10(F.col("reviews_count") + 1), F.lit(20.0)) + 5 * F.coalesce("google_rating", F.lit(0.0)) + stable_jitter(F.col("source_id"))
    )


def map_pins(places: DataFrame, box: tuple[float, float, float, float], zoom: int | None = None, limit: int | None = None) -> DataFrame:
    """Pins spread over a grid of the viewport: the best of each cell, then the second best, and so on."""
    zoom = geo.zoom_of_span(box[3] - box[1]) if zoom is None else zoom
    found = bbox(places, box, score_floor(zoom), limit=MOST_PINS)
    side = geo.grid_side(zoom)
    cell = geo.grid_cell(F.col("lat"), box[0], box[2], side) * side + geo.grid_cell(F.col("lng"), box[1], box[3], side)
    found = found.withColumn("cell", cell).withColumn("pin_score", F.round(pin_score(), 6))
    found = found.withColumn("rn", F.row_number().over(Window.partitionBy("cell").orderBy(F.desc("pin_score"), *visibility_order())))
    return found.orderBy("rn", "cell").limit(clamp(limit, 100, MOST_PINS)).withColumn("priority", F.row_number().over(Window.orderBy("rn", "cell")))


def hydrate(places: DataFrame, ids: list[str], lat: float | None = None, lng: float | None = None, limit: int | None = None) -> DataFrame:
    """The rows of the given source ids in the given order (first occurrence), with distance if an origin is given."""
    spark = places.sparkSession
    ranked = spark.createDataFrame([(i, k + 1) for k, i in enumerate(dict.fromkeys(x.strip() for x in ids if x.strip()))][:200], "source_id string, input_rank int")
    found = places.join(F.broadcast(ranked), "source_id")
    distance = geo.haversine_km(F.col("lat"), F.col("lng"), lat, lng) if lat is not None and lng is not None else F.lit(None).cast("double")
    return found.withColumn("distance_km", distance).orderBy("input_rank", "id").limit(clamp(limit, 200, 200))


def city_counts(places: DataFrame) -> DataFrame:
    named = places.where((F.trim("city") != "") & (F.trim("country") != ""))
    return named.groupBy("city", "country").agg(F.count(F.lit(1)).alias("n_places"))


def city_extent(places: DataFrame) -> DataFrame:
    return places.groupBy("city").agg(F.avg("lat").alias("lat"), F.avg("lng").alias("lng"), F.min("lat").alias("south"), F.max("lat").alias("north"), F.min("lng").alias("west"), F.max("lng").alias("east"))


def outliers(places: DataFrame, km: float) -> DataFrame:
    """Places farther than so many km from their city's median point."""
    middle = places.groupBy("city").agg(F.expr("percentile(lat, 0.5)").alias("mid_lat"), F.expr("percentile(lng, 0.5)").alias("mid_lng"))
    joined = places.join(middle, "city").withColumn("distance_km", geo.haversine_km(F.col("lat"), F.col("lng"), F.col("mid_lat"), F.col("mid_lng")))
    return joined.where(F.col("distance_km") > km)


def photo_rank(source: Column) -> Column:
    return F.when(source == "vibe", 0).when(source == "review", 1).otherwise(2)


def photo_keys(photos: DataFrame, most: int = 10) -> DataFrame:
    """Up to so many distinct paths of each place: vibe, review, the rest, each by index (missing 9999)."""
    key = F.struct(photo_rank(F.col("photo_source")).alias("r"), F.coalesce("photo_index", F.lit(9999)).alias("i"), F.col("photo_id").alias("n"), F.col("path").alias("path"))
    first = photos.groupBy("photo_place", "path").agg(F.min(key).alias("k"))  # a path counts where it comes first
    kept = first.withColumn("rn", F.row_number().over(Window.partitionBy("photo_place").orderBy("k"))).where(F.col("rn") <= most)
    return kept.groupBy("photo_place").agg(F.transform(F.sort_array(F.collect_list("k")), lambda k: k["path"]).alias("paths"))


def first_photos(photos: DataFrame) -> DataFrame:
    """Photo count and first photo of each place."""
    key = F.struct(F.coalesce("photo_index", F.lit(1 << 30)), F.col("photo_id"))
    return photos.groupBy("photo_place").agg(F.count(F.lit(1)).alias("n_photos"), F.min_by("url", key).alias("first_url"))
