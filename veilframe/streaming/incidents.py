"""Incidents as keyed state: events of one (tenant, dedup key) within a window of each other are one incident.

Repeats of an event id go first (state by event id, dealt over all tasks whatever the
keys).  The state of a key is its open incidents alone: first and last time and count.
An event joins every open incident that it is at most ``window`` away from, and those
that it bridges become one.  Event-time timers close an incident when the watermark has
passed its last event by more than the window: no event that could still join it can
come.  It is told once then, and its state goes, so the state holds what is open and
nothing else, however long the stream runs.

Events that come later than the watermark are dropped, as in any streaming aggregate.
Rows with a null tenant, key, time or event id are no events.  Times are kept as
microseconds, so that no time zone of a worker matters.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

INCIDENT = "tenant_id string, dedup_key string, first_seen_at timestamp, last_seen_at timestamp, occurrences long"
_TOLD = "tenant_id string, dedup_key string, first long, last long, n long"


def merged(open_: list[tuple[int, int, int]], times: np.ndarray, window: int) -> list[tuple[int, int, int]]:
    """Open incidents (first, last, events) and new times as incidents, in order: what is at most ``window`` apart is one."""
    parts = sorted([*open_, *((t, t, 1) for t in times.tolist())])
    out: list[tuple[int, int, int]] = []
    for first, last, n in parts:
        if out and first <= out[-1][1] + window:
            out[-1] = (out[-1][0], max(out[-1][1], last), out[-1][2] + n)
        else:
            out.append((first, last, n))
    return out


class Incidents(StatefulProcessor):
    def __init__(self, window: timedelta):
        self.window = int(window.total_seconds() * 1_000_000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getListState("open", "first long, last long, n long")

    def _held(self) -> list[tuple[int, int, int]]:
        return [(x[0], x[1], x[2]) for x in self.open.get()] if self.open.exists() else []

    def _keep(self, open_: list[tuple[int, int, int]]) -> None:
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t[0] if isinstance(t, tuple) else t)
        if open_:
            self.open.put(open_)
            self.handle.registerTimer((min(x[1] for x in open_) + self.window) // 1000 + 1)
        else:
            self.open.clear()

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        open_ = self._held()
        for part in rows:
            open_ = merged(open_, part["at"].to_numpy(np.int64), self.window)
        self._keep(open_)
        yield pd.DataFrame()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        open_ = self._held()
        done = [x for x in open_ if (x[1] + self.window) // 1000 < now]
        self._keep([x for x in open_ if (x[1] + self.window) // 1000 >= now])
        if done:
            yield pd.DataFrame({"tenant_id": key[0], "dedup_key": key[1], "first": [x[0] for x in done], "last": [x[1] for x in done], "n": [x[2] for x in done]})
        else:
            yield pd.DataFrame()

    def close(self) -> None:
        pass


def keyed_incidents(events: DataFrame, *, window: timedelta = timedelta(hours=1), late: str | None = "1 hour", distinct: bool = True) -> DataFrame:
    """Closed incidents (INCIDENT) of a stream of events (tenant_id, dedup_key, event_id, occurred_at).

    ``late``: how far the watermark is behind the latest event; None: the stream has one.
    ``distinct``: event ids may repeat.
    """
    use_state_store(events.sparkSession)
    src = events.select("tenant_id", "dedup_key", "event_id", "occurred_at").dropna()
    src = src.withWatermark("occurred_at", late) if late else src
    src = src.dropDuplicatesWithinWatermark(["tenant_id", "dedup_key", "event_id"]) if distinct else src
    src = src.select("tenant_id", "dedup_key", "occurred_at", F.unix_micros("occurred_at").alias("at"))
    told = src.groupBy("tenant_id", "dedup_key").transformWithStateInPandas(Incidents(window), outputStructType=_TOLD, outputMode="Append", timeMode="EventTime")
    return told.select("tenant_id", "dedup_key", F.timestamp_micros("first").alias("first_seen_at"), F.timestamp_micros("last").alias("last_seen_at"), F.col("n").alias("occurrences"))


def use_state_store(spark: SparkSession) -> None:
    """Keyed state with timers needs the store that keeps several columns of state."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def incident_events(verdicts: DataFrame, user: str = "actor") -> DataFrame:
    """(tenant_id, dedup_key, event_id, occurred_at) of verdicts that ask for an incident; the key is policy, rule and user."""
    asked = F.filter("verdict.side_effects", lambda e: e["action"] == "create_incident")
    rows = verdicts.select("tenant_id", "event_id", "occurred_at", F.coalesce(F.try_variant_get(user, "$.id", "string"), F.lit("")).alias("who"), F.explode(asked).alias("e"))
    return rows.select("tenant_id", F.concat_ws("/", "e.policy", "e.rule", "who").alias("dedup_key"), "event_id", "occurred_at")
