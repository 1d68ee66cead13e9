"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Each document draws an exponential key scaled by its quality weight, -ln(u) / weight, with u from a hash of its columns,
so reruns agree. A source's target is first filled by complete epochs; the rest goes to the documents of least key, whose
sizes are prefix-summed up to the budget. Prefix sums come in three levels: sums of ranges of the key's logarithm, sums of
the ranges inside the one in which the budget ends, and the documents of that inner range, so that no task reads a whole
source. Only equal rows draw equal keys; of those at the cut as many are taken as the budget holds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from placefabric.llm.components import materialise

STEPS = 512  # ranges of an octave of the key
INNER = 1 << 12  # ranges inside one of these
COPIES = 1 << 20  # equal rows that one task writes
BROADCAST_ROWS = 10_000  # rows of a table by source up to which it is broadcast
SEED = 20_240_601
MOST = 3  # times its size that a source may be taken


def quality_weight(size: Column, text: Column) -> Column:
    """0.1 .. 1: how near the mean word length is to that of prose (six characters with the space). Empty texts weigh 0.1."""
    ratio = F.when(size > 0, F.length(text) / size / 6.0)
    return F.greatest(F.lit(0.1), F.coalesce(F.least(ratio, 1 / ratio), F.lit(0.1)))


def source_weights(names: list[str | None]) -> dict[str | None, int]:
    """By code point, null last: 1, 2, 3, repeating."""
    return {s: i % 3 + 1 for i, s in enumerate(sorted(names, key=lambda s: (s is None, s or "")))}


def targets(sizes: dict[str | None, int], weights: dict[str | None, float], most: float = MOST) -> dict[str | None, float]:
    """Shares of the total size by weight; a target stops at `most` times its source, and the excess is shared anew by weight."""
    out, left, open_ = {}, float(sum(sizes.values())), dict(weights)
    while open_:
        total = sum(open_.values())
        above = [s for s in open_ if left * open_[s] / total > most * sizes[s]]
        if not above:
            return out | {s: left * w / total for s, w in open_.items()}
        for s in above:
            out[s] = float(most * sizes[s])
            del open_[s]
        left -= sum(out[s] for s in above)
    return out


def _by_source(spark: SparkSession, rows: list[tuple], ddl: str) -> DataFrame:
    """One row for each source; broadcast if there are few."""
    table = spark.createDataFrame(rows, f"source string, {ddl}")
    return F.broadcast(table) if len(rows) <= BROADCAST_ROWS else table


def _beside(left: DataFrame, table: DataFrame, names: list[str], how: str = "inner") -> DataFrame:
    """left with the named columns of the row of its source; null is a source too."""
    l, r = left.alias("l"), table.alias("r")
    return l.join(r, F.col("l.source").eqNullSafe(F.col("r.source")), how).select("l.*", *[f"r.{c}" for c in names])


def _keyed(docs: DataFrame, keep: list[str]) -> DataFrame:
    """row (the columns to keep), doc_id, source, size, key, tie (a hash of the row: rows of one key and tie are equal), part, inner."""
    docs = docs.select(F.struct(*[F.col(f"`{c}`") for c in [*keep, "doc_id"]][: len(keep) or 1]).alias("row"), "doc_id", "text", F.col("source").cast("string").alias("source"))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    size = F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    u = (F.pmod(F.xxhash64("tie", F.lit(SEED)), F.lit(1 << 52)) + F.lit(0.5)) / F.lit(float(1 << 52))
    row = docs.schema["row"].dataType
    odd = any(x in row.simpleString() for x in ("map<", "variant"))  # which have no hash
    parts = [F.to_json(F.struct(F.col("row")[f.name])) if any(x in f.dataType.simpleString() for x in ("map<", "variant")) else F.col("row")[f.name] for f in row.fields] if odd else ["row"]
    out = docs.withColumn("size", size).withColumn("tie", F.xxhash64(*parts, "doc_id", "text", "source"))
    out = out.withColumn("key", -F.log(u) / quality_weight(F.col("size"), text)).drop("text")
    return _ranged(out)


def _ranged(df: DataFrame) -> DataFrame:
    level = F.log2("key") * STEPS
    return df.withColumn("part", F.floor(level).cast("int")).withColumn("inner", F.floor((level - F.floor(level)) * INNER).cast("int"))


def _crossing(sums: DataFrame, by: str) -> list[tuple]:
    """(source, range, words before it) of the range of each source in which its rest ends; sums: source, base, rest, range, words."""
    before = Window.partitionBy("source").orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
    edge = sums.withColumn("before", F.col("base") + F.coalesce(F.sum("words").over(before), F.lit(0)))
    return [tuple(r) for r in edge.where("before <= rest and rest < before + words").select("source", by, "before").collect()]


def _cuts(spark: SparkSession, narrow: DataFrame, sums: DataFrame, rests: list[tuple]) -> dict[str | None, tuple]:
    """source -> (part, inner, key, tie, copies): rows before this place are taken, and so many of the equal rows that stand on it."""
    rest = dict(rests)
    first = _crossing(_beside(sums, _by_source(spark, rests, "rest double"), ["rest"]).withColumn("base", F.lit(0)), "part")
    at = _by_source(spark, [(s, p, b, rest[s]) for s, p, b in first], "p long, base long, rest double")
    inside = _beside(narrow, at, ["p", "base", "rest"]).where("part = p")
    second = _crossing(inside.groupBy("source", "base", "rest", "inner").agg(F.sum("size").alias("words")), "inner")
    part = {s: p for s, p, _ in first}
    at = _by_source(spark, [(s, part[s], i, b, rest[s]) for s, i, b in second], "p long, i long, base long, rest double")
    inside = _beside(narrow, at, ["p", "i", "base", "rest"]).where("part = p and inner = i")
    same = inside.groupBy("source", "base", "rest", "part", "inner", "key", "tie", "size").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("source").orderBy("key", "tie").rowsBetween(Window.unboundedPreceding, -1)
    same = same.withColumn("before", F.col("base") + F.coalesce(F.sum(F.col("n") * F.col("size")).over(before), F.lit(0)))
    same = same.withColumn("m", F.when(F.col("size") > 0, F.greatest(F.lit(0), F.least(F.col("n"), F.floor((F.col("rest") - F.col("before")) / F.col("size") + 0.5)))).otherwise(F.col("n")).cast("long"))
    cut = same.where("m < n").groupBy("source").agg(F.min(F.struct("key", "tie", "part", "inner", "m")).alias("c")).select("source", "c.part", "c.inner", "c.key", "c.tie", "c.m")
    found = {r["source"]: tuple(r)[1:] for r in cut.collect()}
    # where the budget ends behind the last whole row of its inner range, the cut is the range's end
    return {s: found.get(s, (part[s], i + 1, 0.0, 0, 0)) for s, i, _ in second}


def mix_sources(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """docs (doc_id, text, source, ...) -> the columns to keep (doc_id if none are named) with size, source_size, target, taken,
    which replace columns of these names.

    size counts words, null texts have none. Sources are the values of source, null one of its own; one row for each
    source reaches the driver. taken is a multiple of size, at most three; a source's sum differs from its target by less
    than one document of it. Rows that repeat an id, null among them, are documents of their own. An empty table gives an
    empty result.
    """
    spark = docs.sparkSession
    keep = [c for c in keep or [] if c not in ("size", "source_size", "target", "taken")]
    keyed = _keyed(docs, keep)
    narrow = materialise(keyed.select("doc_id", "source", "size", "key", "tie", "part", "inner"))
    sums = narrow.groupBy("source", "part").agg(F.sum("size").alias("words"))
    sizes = {r["source"]: r["words"] for r in sums.groupBy("source").agg(F.sum("words").alias("words")).collect()}
    goal = targets(sizes, source_weights(list(sizes)))
    epochs = {s: min(MOST, int(goal[s] // n)) if n else 0 for s, n in sizes.items()}
    rests = [(s, goal[s] - epochs[s] * n) for s, n in sizes.items() if n and epochs[s] < MOST]
    cuts = _cuts(spark, narrow, sums, rests) if rests else {}
    plan = [(s, n, goal[s], epochs[s], *cuts.get(s, (None, None, None, None, 0))) for s, n in sizes.items()]
    plan = _by_source(spark, plan, "source_size long, target double, epochs int, c_part int, c_inner int, c_key double, c_tie long, c_m long")
    whole = _beside(keyed if keep else narrow, plan, ["source_size", "target", "epochs", "c_part", "c_inner", "c_key", "c_tie", "c_m"], "left")
    place, cut = F.struct("part", "inner", "key", "tie"), F.struct(F.col("c_part").alias("part"), F.col("c_inner").alias("inner"), F.col("c_key").alias("key"), F.col("c_tie").alias("tie"))
    own = "row.*" if keep else "doc_id"

    def taken(extra: Column) -> Column:
        return (F.col("size") * (F.col("epochs") + extra)).cast("long").alias("taken")

    out = whole.select(own, "size", "source_size", "target", taken(F.when(place < cut, 1).otherwise(0)))
    if not any(c[4] for c in cuts.values()):
        return out
    # some of the equal rows on a cut are taken: they are written anew from one row and their number
    on = F.coalesce((place == cut) & (F.col("c_m") > 0), F.lit(False))
    out = whole.where(~on).select(own, "size", "source_size", "target", taken(F.when(place < cut, 1).otherwise(0)))
    equal = whole.where(on).groupBy("row" if keep else "doc_id", "size", "source_size", "target", "epochs", "c_m").agg(F.count(F.lit(1)).alias("n"))
    equal = equal.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / COPIES)))).repartition("block")
    equal = equal.withColumn("k", F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.lit(COPIES), F.col("n") - F.col("block") * COPIES)))).withColumn("k", F.col("k") + F.col("block") * COPIES)
    return out.unionByName(equal.select(own, "size", "source_size", "target", taken(F.when(F.col("k") <= F.col("c_m"), 1).otherwise(0))))
