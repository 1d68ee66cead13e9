"""The k nearest rows of many origins, by counts of a pyramid of grid cells.

The distance is planar, in degrees. Each level halves the cells of the one above; a cell that holds n rows, all
of them nearer than its far corner, gives a bound of an origin's k-th distance, and cells that begin beyond the bound are
dropped. All origins go down the pyramid together, each with the few cells that may still matter, and meet rows only in
the last level. The upper levels are small tables, which Spark may broadcast by their size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from placefabric.functions import geo
from placefabric.sources import scratch

LEAF = 32  # rows that a cell of the last level is to hold at most
DEEPEST = 22  # levels at most; a cell of the last is then a four-millionth of the extent


def _cell(x: str, low: float, side: float, level: Column | int, deepest: int) -> Column:
    at = F.least(F.lit((1 << deepest) - 1), F.greatest(F.lit(0), F.floor((F.col(x) - low) / side))).cast("long")
    return F.call_function("shiftright", at, (F.lit(deepest) - level).cast("int"))  # of a column of levels


class NearestJoin:
    """The pyramid over rows (rid long, lat, lng), written to the session's shared folder. Rows without coordinates are left out.

    Of rows at one and the same place only the k of smallest rid can be among an origin's k nearest; the others are not kept.
    """

    def __init__(self, rows: DataFrame, k: int):
        spark = rows.sparkSession
        self.spark, self.k, self.path = spark, k, scratch.folder(spark, "nearest")
        at = rows.where("rid is not null and lat is not null and lng is not null and not isnan(lat) and not isnan(lng)").select("rid", F.col("lat").cast("double").alias("lat"), F.col("lng").cast("double").alias("lng"))
        one = at.withColumn("_n", F.row_number().over(Window.partitionBy("lat", "lng").orderBy("rid"))).where(F.col("_n") <= k).drop("_n")
        box = one.agg(F.min("lat"), F.min("lng"), F.max("lat"), F.max("lng")).first()
        self.south, self.west = (box[0] or 0.0), (box[1] or 0.0)
        span = max((box[2] or 0.0) - self.south, (box[3] or 0.0) - self.west) * (1 + 1e-9) or 1.0
        finest = span / (1 << DEEPEST)
        cell = lambda level: F.struct(_cell("lng", self.west, finest, level, DEEPEST).alias("x"), _cell("lat", self.south, finest, level, DEEPEST).alias("y"))
        levels = one.select("*", F.explode(F.sequence(F.lit(0), F.lit(DEEPEST))).alias("level"))
        counts = levels.groupBy("level", cell(F.col("level")).alias("c")).agg(F.count(F.lit(1)).alias("n"))
        counts.select("level", "c.x", "c.y", "n").write.partitionBy("level").parquet(f"{self.path}/counts")
        fullest = {r["level"]: r["n"] for r in self._counts().groupBy("level").agg(F.max("n").alias("n")).collect()}  # a row for each level
        self.last = min((v for v, n in fullest.items() if n <= max(LEAF, k)), default=DEEPEST)
        self.side = finest * (1 << (DEEPEST - self.last))
        c = cell(F.lit(self.last))
        one.select("*", c["x"].alias("x"), c["y"].alias("y")).repartitionByRange("x", "y").write.parquet(f"{self.path}/rows")

    def _counts(self) -> DataFrame:
        return self.spark.read.schema("x long, y long, n long, level int").parquet(f"{self.path}/counts")

    def join(self, origins: DataFrame) -> DataFrame:
        """origins (lid, lat, lng) -> lid, rid, rank, distance_km: the k nearest rows in planar degrees, ties by rid.

        Origins without coordinates have none; those of one lid count as one. An origin may lie anywhere, also far outside.
        """
        k, far = self.k, F.lit(float("inf"))
        own = origins.where("lat is not null and lng is not null and not isnan(lat) and not isnan(lng)").select("lid", F.col("lat").cast("double").alias("lat"), F.col("lng").cast("double").alias("lng")).dropDuplicates(["lid"])
        front = own.select("*", F.lit(0).cast("long").alias("x"), F.lit(0).cast("long").alias("y"))
        for level in range(1, self.last + 1):
            side = self.side * (1 << (self.last - level))
            parts = F.array(*[F.struct((2 * F.col("x") + i).alias("x"), (2 * F.col("y") + j).alias("y")) for i in (0, 1) for j in (0, 1)])
            front = front.select("lid", "lat", "lng", F.explode(parts).alias("c")).select("lid", "lat", "lng", "c.x", "c.y")
            front = front.join(self._counts().where(F.col("level") == level).drop("level"), ["x", "y"])
            low = [self.west + F.col("x") * side - F.col("lng"), self.south + F.col("y") * side - F.col("lat")]
            gap = [F.greatest(F.lit(0.0), v, -v - side) for v in low]
            reach = [F.greatest(F.abs(v), F.abs(v + side)) for v in low]
            front = front.withColumns({"near": gap[0] * gap[0] + gap[1] * gap[1], "far": reach[0] * reach[0] + reach[1] * reach[1]})
            inside = Window.partitionBy("lid").orderBy("far").rowsBetween(Window.unboundedPreceding, 0)
            bound = F.min(F.when(F.col("upto") >= k, F.col("far"))).over(Window.partitionBy("lid"))
            front = front.withColumn("upto", F.sum("n").over(inside)).withColumn("bound", F.coalesce(bound, far))
            front = front.where(F.col("near") <= F.col("bound") * (1 + 1e-9)).select("lid", "lat", "lng", "x", "y")
        rows = self.spark.read.schema("rid long, lat double, lng double, x long, y long").parquet(f"{self.path}/rows").withColumnsRenamed({"lat": "rlat", "lng": "rlng"})
        met = front.join(rows, ["x", "y"])
        planar = F.pow(F.col("rlat") - F.col("lat"), 2) + F.pow(F.col("rlng") - F.col("lng"), 2)
        best = met.withColumn("rank", F.row_number().over(Window.partitionBy("lid").orderBy(planar, "rid"))).where(F.col("rank") <= k)
        return best.select("lid", "rid", "rank", geo.haversine_km(F.col("lat"), F.col("lng"), F.col("rlat"), F.col("rlng")).alias("distance_km"))


def resolve_cities(origins: DataFrame, places: DataFrame, guard_m: float = 50_000) -> DataFrame:
    """origins (lid, lat, lng) -> lid, id, city, country of the nearest place; no row if it is beyond the guard."""
    found = NearestJoin(places.select(F.col("id").alias("rid"), "lat", "lng"), 1).join(origins)
    near = found.where(F.col("distance_km") * 1000 <= guard_m).select("lid", F.col("rid").alias("id"))
    return near.join(places.select("id", "city", "country"), "id").select("lid", "id", "city", "country")

