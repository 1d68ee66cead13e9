"""Opening hours as spans of week minutes (Monday 0:00 is 0); null means unknown, which counts as open."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WEEK, DAY = 10_080, 1_440
DAYS = ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")
SPANS = "array<struct<open:int,close:int>>"


def merge_spans(spans: list[tuple[int, int]] | None) -> list[tuple[int, int]] | None:
    """Spans with their copies a week before and after, touching ones joined."""
    if spans is None:
        return None
    out: list[tuple[int, int]] = []
    for a, b in sorted((a + d, b + d) for a, b in spans for d in (-WEEK, 0, WEEK)):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def merged_week(spans: Column) -> Column:
    """merge_spans as a column: a sorted fold, without Python."""
    copies = F.array_sort(F.flatten(F.transform(spans, lambda s: F.array(*[F.struct((s["open"] + d).cast("int").alias("open"), (s["close"] + d).cast("int").alias("close")) for d in (-WEEK, 0, WEEK)]))))

    def step(acc: Column, s: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        joined = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(last["open"].alias("open"), F.greatest(last["close"], s["close"]).alias("close"))))
        return F.when((F.size(acc) > 0) & (s["open"] <= last["close"]), joined).otherwise(F.concat(acc, F.array(s)))

    return F.aggregate(copies, F.array().cast(SPANS), step)


def open_within(merged: Column, start: Column, end: Column, dwell: Column) -> Column:
    """Some span overlaps the window for at least so long; unknown hours do."""
    return F.coalesce(F.exists(merged, lambda s: F.least(end, s["close"]) - F.greatest(start, s["open"]) >= dwell), F.lit(True))


def visit_wait(merged: Column, at: Column, dwell: Column, most: int = 30) -> Column:
    """Minutes until the whole visit fits; 0 for unknown hours, null if the wait is too long."""
    t = F.pmod(at, F.lit(WEEK))
    fits = F.filter(merged, lambda s: (F.greatest(t, s["open"]) + dwell <= s["close"]) & (F.greatest(t, s["open"]) - t <= most))
    return F.when(merged.isNull(), F.lit(0)).otherwise(F.array_min(F.transform(fits, lambda s: F.greatest(t, s["open"]) - t)))


TIMETABLE = "map<string,array<struct<open:struct<hour:int,minute:int>,close:struct<hour:int,minute:int>>>>"


def spans_of_timetable(json: Column) -> Column:
    """{"monday": [{"open": {"hour": 9, "minute": 0}, "close": {...}}], ...} -> spans; a close at or before the open is next day.

    A missing day is closed; what isn't such an object is null; an interval without both hours is left out.
    """
    table = F.from_json(json, TIMETABLE)
    minute = lambda t: t["hour"] * 60 + F.coalesce(t["minute"], F.lit(0))

    def day(k: int) -> Column:
        valid = F.filter(F.coalesce(F.try_element_at(table, F.lit(DAYS[k])), F.array().cast("array<struct<open:struct<hour:int,minute:int>,close:struct<hour:int,minute:int>>>")), lambda s: s["open"]["hour"].isNotNull() & s["close"]["hour"].isNotNull())
        return F.transform(valid, lambda s: F.struct((k * DAY + minute(s["open"])).cast("int").alias("open"), (k * DAY + minute(s["close"]) + F.when(minute(s["close"]) <= minute(s["open"]), DAY).otherwise(0)).cast("int").alias("close")))

    return F.when(table.isNotNull(), F.concat(*[day(k) for k in range(7)]).cast(SPANS))


def day_text(merged: Column, weekday: int) -> Column:
    """Hours that begin on a weekday as "HH:MM-HH:MM, ...", "24 h" or "closed"."""
    a, b = weekday * DAY, (weekday + 1) * DAY
    clock = lambda m: F.concat(F.lpad((F.floor(F.pmod(m, F.lit(DAY)) / 60)).cast("string"), 2, "0"), F.lit(":"), F.lpad((F.pmod(m, F.lit(60))).cast("string"), 2, "0"))
    own = F.filter(merged, lambda s: (s["open"] >= a) & (s["open"] < b))
    whole = F.exists(merged, lambda s: (s["open"] <= a) & (s["close"] >= b))
    return F.when(merged.isNull(), F.lit(None)).when(whole, "24 h").when(F.size(own) == 0, "closed").otherwise(F.array_join(F.transform(own, lambda s: F.concat(clock(s["open"]), F.lit("-"), clock(s["close"]))), ", "))
