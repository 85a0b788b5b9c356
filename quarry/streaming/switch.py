"""Kill switches as a stream: activations, timed ends and a bounded history for every switch.

Events of a switch come in the order of their times (as a log has them).  An
activation puts it on, with a reason and perhaps a time after which it goes off
by itself; a second one replaces the first.  A deactivation puts it off if it
is on.  State and timers live in the state store, so a run goes on from where
the last one stopped, and a switch goes off in time even if nothing comes in.
"""

from __future__ import annotations

import contextlib
from collections import deque
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from quarry.streaming.flows import drained

#: Events that a switch remembers.
HISTORY = 1000
CHANGES = "switch string, at timestamp, event string, reason string, n_kept int, nth long"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


class Switch(StatefulProcessor):
    """One switch; its timer is set where an activation ends by itself."""

    def __init__(self, history: int = HISTORY):
        self.most = history

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "until_ms long, reason string")
        self.count = handle.getValueState("count", "n long")
        self.history = handle.getListState("history", "at_ms long, event string, reason string")

    def _load(self) -> None:
        """What the store knows of the switch; all events of a batch go by before it is put back."""
        self.on = self.state.get() if self.state.exists() else None
        self.timer = self.on[0] if self.on else None
        self.n = self.count.get()[0] if self.count.exists() else 0
        self.kept = deque((tuple(x) for x in self.history.get()), self.most)
        self.before = self.n

    def _save(self) -> None:
        until = self.on[0] if self.on else None
        if self.timer is not None and self.timer != until:
            self.handle.deleteTimer(self.timer)
        if until is not None and until != self.timer:
            self.handle.registerTimer(until)
        if self.on:
            self.state.update(self.on)
        else:
            self.state.clear()
        if self.n > self.before:
            self.history.put(list(self.kept))
            self.count.update((self.n,))

    def _note(self, at_ms: int, event: str, reason: str | None) -> tuple:
        self.kept.append((at_ms, event, reason))
        self.n += 1
        return at_ms, event, reason, len(self.kept), self.n

    def _timed_out(self) -> tuple:
        (until, reason), self.on = self.on, None
        return self._note(until, "timed out", reason)

    def _frame(self, key: Any, rows: list[tuple]) -> pd.DataFrame:
        text = lambda values: pd.Series(values, dtype=object)
        columns = {"switch": text([key[0]] * len(rows)), "at": pd.to_datetime([r[0] for r in rows], unit="ms"), "event": text([r[1] for r in rows]), "reason": text([r[2] for r in rows])}
        return pd.DataFrame(columns | {"n_kept": pd.Series([r[3] for r in rows], dtype="int32"), "nth": pd.Series([r[4] for r in rows], dtype="int64")})

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        every = pd.concat(list(rows)).sort_values(["at_ms", "ord"])
        self._load()
        out: list[tuple] = []
        for at, on, reason, seconds in zip(every["at_ms"], every["activate"], every["reason"], every["seconds"]):
            at = int(at)
            if self.on and self.on[0] is not None and self.on[0] <= at:
                out.append(self._timed_out())
            if on:
                self.on = (None if pd.isna(seconds) else at + int(seconds) * 1000, reason)
                out.append(self._note(at, "activated", reason))
            elif self.on:
                self.on = None
                out.append(self._note(at, "deactivated", reason))
        self._save()
        yield self._frame(key, out)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        due = self.state.exists() and self.state.get()[0] == expiredTimerInfo.getExpiryTimeInMs()
        out: list[tuple] = []
        if due:
            self._load()
            self.timer = None  # it has gone off
            out.append(self._timed_out())
            self._save()
        yield self._frame(key, out)

    def close(self) -> None:
        pass


def switch_changes(events: DataFrame, history: int = HISTORY) -> DataFrame:
    """The stream of changes: switch, at, event, reason, n_kept (events remembered after it), nth (of the switch).  events: switch, ts, ord, activate, reason, seconds."""
    timed = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", "0 seconds").withColumn("at_ms", F.unix_millis("at"))
    rows = timed.select("switch", "at", "at_ms", "ord", "activate", "reason", F.col("seconds").cast("double").alias("seconds"))
    return rows.groupBy("switch").transformWithStateInPandas(Switch(history), CHANGES, "append", "eventTime")


@contextlib.contextmanager
def _timers(spark: SparkSession):
    """The state store that keeps timers, for streams that are started inside."""
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before)


def changes_table(events: DataFrame, state: str | None = None, history: int = HISTORY) -> DataFrame:
    """All changes once everything that is there has been read; with a state folder the next call goes on from there."""
    with _timers(events.sparkSession):
        return drained(switch_changes(events, history), "append", state=state)


def active_switches(changes: DataFrame) -> DataFrame:
    """switch, reason of those that are on."""
    last = changes.groupBy("switch").agg(F.max_by(F.struct("event", "reason"), "nth").alias("last"))
    return last.where("last.event = 'activated'").select("switch", "last.reason")


def guarded(rows: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """The rows whose switch is not on."""
    return rows.join(active_switches(changes).select(F.col("switch").alias("_switch")), rows[key] == F.col("_switch"), "left_anti")


def recent_history(changes: DataFrame, history: int = HISTORY) -> DataFrame:
    """The last events of every switch."""
    newest = changes.groupBy("switch").agg(F.max("nth").alias("newest"))
    return changes.join(newest, "switch").where(F.col("nth") > F.col("newest") - history).drop("newest")
