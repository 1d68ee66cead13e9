"""Places of other themes set into the lists of users whose taste is of one theme, for all users at once."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from placefabric.operators import recommend as r

PRIOR, SMOOTHING, QUALITY = 5.0, 0.01, 0.15


@dataclass(frozen=True)
class Injection:
    """How much is set in: nothing (off), a given share (manual), or a share that falls with the balance of a user's themes
    and with how narrow their taste of types is against the pool (auto)."""

    mode: str = "off"
    share: float = 0.15  # manual
    most: float = 0.10  # auto, of a user with one theme and a broad taste
    floor: float = 0.45  # of the fit
    weights: tuple[float, float] = (0.5, 0.5)  # axis similarity and tag overlap in the fit, which knows no categories
    window: int = 0  # what a user sees of the list; 0: all of it
    narrow: tuple[float, float] = (0.3, 1.2)  # divergence from which a taste counts as narrow, and where it is wholly so
    deny_tags: tuple[str, ...] = ()
    deny_types: tuple[str, ...] = ()


def theme_balance(seeds: DataFrame) -> DataFrame:
    """seeds (user_id, theme) -> user_id, dominant, balance: the commonest theme (ties by name), and the entropy of the themes over that of equal shares, 0 for one theme."""
    n = seeds.where("theme is not null").groupBy("user_id", "theme").agg(F.count(F.lit(1)).alias("n"))
    total = n.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("user_id")))
    out = total.groupBy("user_id").agg(F.min(F.struct((-F.col("n")).alias("n"), "theme"))["theme"].alias("dominant"), (-F.sum(F.col("p") * F.log("p"))).alias("entropy"), F.count(F.lit(1)).alias("themes"))
    return out.select("user_id", "dominant", F.when(F.col("themes") > 1, F.col("entropy") / F.log("themes")).otherwise(0.0).alias("balance"))


def taste_focus(seeds: DataFrame, pool: DataFrame, narrow: tuple[float, float] = Injection.narrow) -> DataFrame:
    """(user_id, type) of seeds and pool -> user_id, focus from 0 to 1: the divergence of a user's shares of types, drawn towards the pool's, from the pool's.

    Users without typed seeds or typed pool have none.
    """
    typed = pool.where(F.trim("type") != "").groupBy("user_id", "type").agg(F.count(F.lit(1)).alias("n"))
    share = typed.select("user_id", "type", (F.col("n") / F.sum("n").over(Window.partitionBy("user_id"))).alias("q"))
    both = r.taste_target(seeds, pool, PRIOR).where("target > 0").join(share, ["user_id", "type"], "left")
    smooth = (1 - SMOOTHING) * F.coalesce("q", F.lit(0.0)) + SMOOTHING * F.col("target")
    kl = both.groupBy("user_id").agg(F.sum(F.col("target") * F.log(F.col("target") / smooth)).alias("kl"))
    low, high = narrow
    return kl.select("user_id", F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("kl") - low) / max(high - low, 1e-9))).alias("focus"))


def amounts(seeds: DataFrame, pool: DataFrame, how: Injection, limit: int) -> DataFrame:
    """seeds (user_id, theme, type), pool (user_id, type, ...) -> user_id, dominant, balance, focus, k: how many places are to be set in."""
    window = min(how.window, limit) if how.window > 0 else limit
    own = theme_balance(seeds).join(taste_focus(seeds.select("user_id", "type"), pool.select("user_id", "type"), how.narrow), "user_id", "left").withColumn("focus", F.coalesce("focus", F.lit(0.0)))
    if how.mode == "manual":
        share = F.lit(min(max(how.share, 0.0), 1.0))
    else:
        share = how.most * (1 - F.col("balance")) * (1 - F.col("focus")) if how.mode == "auto" else F.lit(0.0)
    return own.withColumn("k", F.bround(F.round(share * window, 9)).cast("int"))


def injected(ranked: DataFrame, seeds: DataFrame, pool: DataFrame, how: Injection, limit: int) -> DataFrame:
    """ranked (user_id, place_id, position from 0) -> user_id, place_id, position, injected: the first `limit` of each list with what is set in.

    seeds: user_id, theme, type. pool: user_id, place_id, theme, type, tags array<string>, axis, overlap, quality, a row for
    each candidate. Of the places of other themes that no list forbids those of most fit and quality are taken, if their fit
    reaches the floor; they stand at even distances within the window, and nowhere else. Ties go to the smaller id. Nulls
    count as 0; a place without theme is of another theme. Users without seeds keep their list.
    """
    base = ranked.where(F.col("position") < limit).select(F.col("user_id").alias("key"), F.col("place_id").alias("item"), F.col("position").alias("pos"))
    if how.mode not in ("auto", "manual"):
        return base.select(F.col("key").alias("user_id"), F.col("item").alias("place_id"), F.col("pos").cast("int").alias("position"), F.lit(False).alias("injected"))
    zero = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    fit = how.weights[0] * zero("axis") + how.weights[1] * zero("overlap")
    folded = lambda xs: [x.strip().lower() for x in xs if x.strip()]
    denied = F.lower(F.trim(F.coalesce("type", F.lit("")))).isin(folded(how.deny_types)) | F.exists(F.coalesce("tags", F.array().cast("array<string>")), lambda t: F.lower(F.trim(t)).isin(folded(how.deny_tags)))
    other = pool.join(amounts(seeds, pool, how, limit).where("k > 0"), "user_id").where(~F.col("theme").eqNullSafe(F.col("dominant")) & ~denied)
    other = other.withColumn("fit", fit).where(F.round("fit", 9) >= how.floor)
    rank = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc(F.round(F.col("fit") + QUALITY * zero("quality"), 9)), "place_id"))
    picks = other.withColumn("pos", rank - 1).where(F.col("pos") < F.col("k")).select(F.col("user_id").alias("key"), F.col("place_id").alias("item"), "pos")
    rest = base.join(picks.select("key", "item"), ["key", "item"], "left_anti")
    rest = rest.withColumn("pos", F.row_number().over(Window.partitionBy("key").orderBy("pos")) - 1)
    out = r.interleaved(rest, picks, how.window and min(how.window, limit)).join(picks.select("key", "item", F.lit(True).alias("injected")), ["key", "item"], "left")
    return out.where(F.col("position") < limit).select(F.col("key").alias("user_id"), F.col("item").alias("place_id"), "position", F.coalesce("injected", F.lit(False)).alias("injected"))
