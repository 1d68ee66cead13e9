"""A rate limiter of several rules in keyed state."""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@dataclass(frozen=True)
class Rule:
    """At most so many events of a key in a window of so many seconds, which slides or begins at multiples of its width."""

    most: int
    seconds: int
    sliding: bool = True

    def since(self, at: int) -> int:
        """The first microsecond that counts for an event."""
        width = self.seconds * 1_000_000
        return at - width + 1 if self.sliding else at - at % width


@contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """The state store that lists and timers need, while a query is started."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.unset(_PROVIDER) if before is None else spark.conf.set(_PROVIDER, before)


class _Limiter(StatefulProcessor):
    """Holds the times of a key's allowed events, as long as a rule or a late event may ask for them."""

    def __init__(self, rules: tuple[Rule, ...]):
        self.rules, self.horizon = rules, max(r.seconds for r in rules) * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.allowed = handle, handle.getListState("allowed", "at long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        held = sorted(x[0] for x in self.allowed.get())
        events = pd.concat(list(rows)).sort_values("ts", kind="stable")
        verdicts = []
        for at in events.ts.astype("datetime64[us]").astype("int64").tolist():
            ok = all(bisect_right(held, at) - bisect_left(held, r.since(at)) < r.most for r in self.rules)
            verdicts.append(ok)
            if ok:
                insort(held, at)
        oldest = timerValues.getCurrentWatermarkInMs() * 1000 - self.horizon
        held = held[bisect_left(held, oldest) :]
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.allowed.clear()
        if held:
            self.allowed.put([(x,) for x in held])
            self.handle.registerTimer((held[-1] + self.horizon) // 1000 + 1)
        yield pd.DataFrame({"key": events.key, "ts": events.ts, "allowed": verdicts})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.allowed.clear()
        yield pd.DataFrame({"key": pd.Series([], dtype=object), "ts": pd.Series([], dtype="datetime64[us]"), "allowed": pd.Series([], dtype=bool)})

    def close(self) -> None:
        pass


def limited(events: DataFrame, rules: list[Rule], late: str = "1 hour") -> DataFrame:
    """A stream (key string, ts) -> key, ts, allowed: an event is allowed if no rule's window is full of allowed ones; blocked ones don't count.

    Events of a key are judged by their time, those of one delivery together; one that is late by less than `late` is judged
    among the allowed ones before it, one that is later is dropped. A key's state holds what its longest window allows at most and
    goes when the window has passed without an event. Start the query inside keyed_state. Null keys are one key.
    """
    stream = events.select("key", "ts").withWatermark("ts", late)
    return stream.groupBy("key").transformWithStateInPandas(_Limiter(tuple(rules)), "key string, ts timestamp, allowed boolean", "append", "eventTime")
