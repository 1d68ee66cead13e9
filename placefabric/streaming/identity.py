"""Events get the user of their anonymous id, as a stream: what was told without a user is told again when a link comes or changes."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

_OUT = "event_id string, user_id long, version long"


class _Stitcher(StatefulProcessor):
    """Of an anonymous id: the first time of each of its users, and the events that had none."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.links = handle.getMapState("links", "user_id long", "at long")
        self.waiting = handle.getListState("waiting", "event_id string")
        self.version = handle.getValueState("version", "n long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        links = {int(u[0]): int(t[0]) for u, t in self.links.iterator()}
        before = max(((t, u) for u, t in links.items()), default=None)
        version = (self.version.get()[0] if self.version.exists() else 0) + 1
        told, fresh = [], []
        for pdf in rows:
            at = pdf.server_ts.astype("datetime64[us]").astype("int64")
            for event, user, t in zip(pdf.event_id, pdf.user_id.astype("Int64"), at, strict=True):
                if pd.isna(user):
                    fresh.append(event)
                else:
                    told.append((event, int(user)))
                    links[int(user)] = min(links.get(int(user), t), t)
        after = max(((t, u) for u, t in links.items()), default=None)
        user = after and after[1]
        again = [x[0] for x in self.waiting.get()] if after != before and (before is None or user != before[1]) else []
        for u, t in links.items():
            self.links.updateValue((u,), (t,))
        if fresh:
            self.waiting.appendList([(e,) for e in fresh])
        self.version.update((version,))
        events = [*(e for e, _ in told), *fresh, *again]
        users = [*(u for _, u in told), *[user] * (len(fresh) + len(again))]
        yield pd.DataFrame({"event_id": pd.Series(events, dtype=object), "user_id": pd.Series(users, dtype="Int64"), "version": pd.Series([version] * len(events), dtype="int64")})

    def close(self) -> None:
        pass


def stitched_stream(events: DataFrame) -> DataFrame:
    """A stream (event_id string, anon_id, user_id long, server_ts) -> event_id, user_id, version.

    An event is told once when it comes, with its own user or the one its anonymous id is linked to last (ties to the larger), and
    again under a higher version whenever that changes. The last version is what the batch gives, in whatever order the
    events came. Events without anonymous id need no state. The state keeps the ids of events without user for ever.
    Start the query inside keyed_state.
    """
    own = events.select(F.col("event_id").cast("string").alias("event_id"), "anon_id", F.col("user_id").cast("long").alias("user_id"), "server_ts")
    alone = own.where("anon_id is null").select("event_id", "user_id", F.lit(0).cast("long").alias("version"))
    kept = own.where("anon_id is not null").groupBy("anon_id").transformWithStateInPandas(_Stitcher(), _OUT, "append", "none")
    return alone.unionByName(kept)


def last_told(told: DataFrame) -> DataFrame:
    """event_id, user_id of the last version of each event."""
    return told.groupBy("event_id").agg(F.max_by("user_id", "version").alias("user_id"))
