"""Log and latency analytics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

LINE = "reqId string, time timestamp, event string, eventType string, metricType string, dependency string, operation string, name string, durationMs double, success boolean, rowsCount bigint, statusCode int, responseTimeMs double, url string, method string"


def parse_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """JSON log lines; lines that aren't objects are left out."""
    ok = F.startswith(F.trim(column), F.lit("{"))
    return lines.where(ok).select(F.from_json(column, LINE, {"mode": "PERMISSIVE"}).alias("l")).select("l.*").where("time is not null or reqId is not null")


def nearest_rank(values: Column, q: float, rule: str = "floor") -> Column:
    """Percentile without interpolation: entry floor(q n) or ceil(q n) - 1 of the sorted values."""
    v = F.sort_array(F.collect_list(values))
    n = F.size(v)
    at = F.least(n - 1, F.floor(n * q)) if rule == "floor" else F.greatest(F.lit(0), F.ceil(n * q) - 1)
    return F.get(v, at.cast("int"))


def nearest_rank_by(df: DataFrame, keys: list[str], value: str, qs: dict[str, float], rule: str = "floor") -> DataFrame:
    """Nearest-rank percentiles for keys of any size: counts by value and a running count, no key's list in one row."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_c"))
    w = Window.partitionBy(*keys).orderBy(value)
    counts = counts.withColumn("_upto", F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_n", F.sum("_c").over(Window.partitionBy(*keys)))
    rank = lambda q: F.least(F.col("_n"), F.floor(F.col("_n") * q) + 1) if rule == "floor" else F.greatest(F.lit(1), F.ceil(F.col("_n") * q))
    return counts.groupBy(*keys).agg(*[F.min(F.when(F.col("_upto") >= rank(q), F.col(value))).alias(name) for name, q in qs.items()], F.max("_n").alias("n"))


def request_dependencies(lines: DataFrame) -> DataFrame:
    """Completed requests with the number and time of their dependency calls."""
    calls = lines.where("eventType = 'metric' and metricType = 'dependency'").groupBy("reqId").agg(F.count(F.lit(1)).alias("n_calls"), F.sum("durationMs").alias("call_ms"))
    done = lines.where("event = 'request completed'").select("reqId", "url", "method", "statusCode", "responseTimeMs")
    return done.join(calls, "reqId", "left").withColumns({"n_calls": F.coalesce("n_calls", F.lit(0)), "call_ms": F.coalesce("call_ms", F.lit(0.0))})


def status_windows(lines: DataFrame, width: str = "10 seconds") -> DataFrame:
    """Requests of each window by status class."""
    hit = lambda k: F.sum((F.floor(F.col("statusCode") / 100) == k).cast("int")).alias(f"n_{k}xx")
    return lines.groupBy(F.window("time", width).alias("w")).agg(hit(2), hit(4), hit(5), F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "n_2xx", "n_4xx", "n_5xx", "n")


def counter_rate(samples: DataFrame, series: list[str], ts: str, value: str) -> DataFrame:
    """Increase for a second between samples of a counter; a fall is a restart."""
    w = Window.partitionBy(*series).orderBy(ts)
    delta = F.col(value) - F.lag(value).over(w)
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    seconds = (micros - F.lag(micros).over(w)) / 1e6
    return samples.withColumn("rate", F.when(delta < 0, F.col(value)).otherwise(delta) / F.nullif(seconds, F.lit(0.0)))


def histogram_quantile(buckets: DataFrame, keys: list[str], q: float) -> DataFrame:
    """(le, count cumulative) -> quantile by linear interpolation inside its bucket; the last finite bound beyond."""
    w = Window.partitionBy(*keys).orderBy("le")
    b = buckets.withColumns({"_lo": F.coalesce(F.lag("le").over(w), F.lit(0.0)), "_below": F.coalesce(F.lag("count").over(w), F.lit(0)), "_total": F.max("count").over(Window.partitionBy(*keys))})
    hit = b.where(F.col("count") >= F.col("_total") * q).groupBy(*keys).agg(F.min_by(F.struct("le", "_lo", "_below", "count", "_total"), "le").alias("h"))
    h = lambda c: F.col(f"h.{c}")
    inside = h("_lo") + (h("le") - h("_lo")) * (h("_total") * q - h("_below")) / F.nullif(h("count") - h("_below"), F.lit(0))
    return hit.select(*keys, F.when(h("le") == float("inf"), h("_lo")).otherwise(inside).alias("quantile"))


def report_counters(reports: DataFrame, column: str = "value") -> DataFrame:
    """Load-test reports: dotted counter keys as (endpoint, code, n)."""
    c = F.from_json(F.get_json_object(column, "$.aggregate.counters"), "map<string,double>")
    flat = reports.select(F.explode(c).alias("key", "n"))
    return flat.select(F.regexp_extract("key", r"endpoint\.(.+)\.codes\.(\d+)$", 1).alias("endpoint"), F.regexp_extract("key", r"codes\.(\d+)$", 1).alias("code"), F.col("n").cast("long").alias("n")).where("code <> ''")
