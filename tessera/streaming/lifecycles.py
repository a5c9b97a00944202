"""Lives of sessions within a space: started, waiting for feedback, resumed, cancelled, done, expired, evicted.

A space keeps at most KEPT live sessions; one more evicts the one started first. A session that waits longer than a deadline expires.
The same steps serve a batch (a space's events in order) and a stream (state by session, timers for deadlines).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Fixed value: live sessions of a space.
KEPT = 10
OUT = "space long, session long, ms long, event_id long, outcome string"


class Lives:
    """Live sessions: session -> [state, started (ms, event_id), waiting since]."""

    def __init__(self, deadline_ms: int, live: dict | None = None):
        self.deadline, self.live, self.out = deadline_ms, live or {}, []

    def expire(self, ms: int) -> None:
        """What has waited up to ms or longer ends at its deadline."""
        for s in sorted(s for s, (state, _, since) in self.live.items() if state == "waiting" and since + self.deadline <= ms):
            self.out.append((s, self.live.pop(s)[2] + self.deadline, None, "expired"))

    def step(self, kind: str, session: int, ms: int, event_id: int) -> None:
        self.expire(ms)
        own = self.live.get(session)
        state, outcome = own[0] if own else None, "ignored"
        if kind == "start" and own is None:
            self.live[session] = ["running", (ms, event_id), None]
            outcome = "started"
        elif kind == "wait" and state == "running":
            own[0], own[2], outcome = "waiting", ms, "waiting"
        elif kind == "resume" and state == "waiting":
            own[0], own[2], outcome = "running", None, "resumed"
        elif kind == "cancel" and own or kind == "done" and state == "running":
            del self.live[session]
            outcome = "cancelled" if kind == "cancel" else "done"
        self.out.append((session, ms, event_id, outcome))
        if len(self.live) > KEPT:
            oldest = min(self.live, key=lambda s: self.live[s][1])
            del self.live[oldest]
            self.out.append((oldest, ms, event_id, "evicted"))

    def told(self, space) -> pd.DataFrame:
        rows = pd.DataFrame(self.out, columns=["session", "ms", "event_id", "outcome"])
        rows.insert(0, "space", space)
        return rows.astype({"event_id": "Int64"})


def session_events(events: DataFrame) -> DataFrame:
    """space, session, kind, event_id, ts of events (space, session, kind, event_id, ts), and ms, the time as milliseconds."""
    return events.withColumn("ms", F.unix_millis(F.col("ts").cast("timestamp")))


def lives(events: DataFrame, deadline_ms: int, until: DataFrame | None = None) -> DataFrame:
    """Batch: space, session, ms, event_id and outcome of each event and of each session that expired (no event_id) or was evicted.

    events: space (not null), session, kind (start, wait, resume, cancel, done), event_id, ts; in the order of ts and event_id. What doesn't fit a session's
    state is `ignored`. until (one row, ms): waiting sessions whose deadline is up to then expire at the end. A space is one group: its events meet in a task.
    """

    def run(g: pd.DataFrame) -> pd.DataFrame:
        at = Lives(deadline_ms)
        for r in g.sort_values(["ms", "event_id"]).itertuples():
            at.step(r.kind, r.session, r.ms, r.event_id)
        if "_until" in g and len(g):
            at.expire(int(g["_until"].iloc[0]))
        return at.told(g["space"].iloc[0])

    own = session_events(events).drop("ts")
    if until is not None:
        own = own.join(F.broadcast(until.select(F.col("ms").alias("_until"))))
    return own.groupBy("space").applyInPandas(run, OUT)


class Keeper(StatefulProcessor):
    """The stream's state: sessions in a map, a timer for each deadline."""

    def __init__(self, deadline_ms: int):
        self.deadline = deadline_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.map = handle.getMapState("live", "session long", "state string, ms long, event_id long, since long")

    def load(self) -> Lives:
        return Lives(self.deadline, {k[0]: [v[0], (v[1], v[2]), v[3]] for k, v in self.map.iterator()})

    def save(self, before: set, at: Lives) -> None:
        for s in before - set(at.live):
            self.map.removeKey((s,))
        for s, (state, (ms, event_id), since) in at.live.items():
            self.map.updateValue((s,), (state, ms, event_id, since))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        at = self.load()
        before = set(at.live)
        for r in pd.concat(list(rows)).sort_values(["ms", "event_id"]).itertuples():
            at.step(r.kind, r.session, int(r.ms), int(r.event_id))
        self.save(before, at)
        for state, _, since in at.live.values():
            if state == "waiting":
                self.handle.registerTimer(since + self.deadline)
        yield at.told(key[0])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        at = self.load()
        before = set(at.live)
        at.expire(expiredTimerInfo.getExpiryTimeInMs())
        self.save(before, at)
        if at.out:
            yield at.told(key[0])


def lives_stream(events: DataFrame, deadline_ms: int, late: str = "0 seconds") -> DataFrame:
    """Stream: the same rows; waiting sessions expire with their space's next event or when the watermark is past their deadline.

    Needs the RocksDB state store. Events of a trigger are taken in order; those later than the watermark are dropped by Spark.
    """
    own = session_events(events).withWatermark("ts", late)
    return own.groupBy("space").transformWithStateInPandas(Keeper(deadline_ms), OUT, "append", "EventTime")
