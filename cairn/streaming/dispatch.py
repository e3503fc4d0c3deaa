"""Debounced dispatch as a stateful operator.

With a watermark it works by event time, in Spark's session windows: a session is passed on once the watermark has passed its
end, whatever the order of its events, as ``events.debounce`` does. Without one it works by the clock, with a timer a path: the
newest event of a path is passed on when no other has come for the gap, even if the stream then falls silent.
"""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor

from cairn.streaming.events import debounce

OUT = "file_path string, event_type string, ts timestamp, session_start timestamp, events long"
_PART = "file_path string, event_type string, first long, last long, events long"
#: Timers need this store; with the second setting a busy path's events are merged into sessions before the shuffle.
_SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition": "true",
}
#: Longer than any two times are apart, in microseconds.
_EVER = 1 << 62


@contextlib.contextmanager
def state_store(spark: SparkSession):
    """The settings that such operators need, for queries started inside; the session's own ones come back after it."""
    before = {key: spark.conf.get(key, None) for key in _SETTINGS}
    for key, value in _SETTINGS.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value) if value else spark.conf.unset(key)


def merged(sessions: list[tuple], gap: int) -> list[tuple]:
    """(first, last, event_type, events) with those at most ``gap`` apart joined, in order; the newest event's type stays."""
    out: list[tuple] = []
    for s in sorted(sessions):
        if out and s[0] - out[-1][1] <= gap:
            a = out[-1]
            out[-1] = (a[0], max(a[1], s[1]), max((a[1], a[2]), (s[1], s[2]))[1], a[3] + s[3])
        else:
            out.append(s)
    return out


def _partial(gap: int):
    """Events of an Arrow batch -> its own sessions, so that few rows of a busy path are shuffled."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            if not part.num_rows:
                continue
            d = part.to_pandas().sort_values(["file_path", "t", "event_type"], kind="stable")
            path, t = d["file_path"].to_numpy(), d["t"].to_numpy(np.int64)
            fresh = np.r_[True, (path[1:] != path[:-1]) | (np.diff(t) > gap)]
            first, last = np.flatnonzero(fresh), np.r_[np.flatnonzero(fresh)[1:], len(d)] - 1
            out = pd.DataFrame({"file_path": path[first], "event_type": d["event_type"].to_numpy()[last], "first": t[first], "last": t[last], "events": last - first + 1})
            yield pa.RecordBatch.from_pandas(out, pa.schema([("file_path", pa.string()), ("event_type", pa.string()), ("first", pa.int64()), ("last", pa.int64()), ("events", pa.int64())]), preserve_index=False)

    return run


def _row(path: str, s: tuple) -> Row:
    when = lambda us: pd.Timestamp(us, unit="us", tz="UTC").to_pydatetime()
    return Row(file_path=path, event_type=s[2], ts=when(s[1]), session_start=when(s[0]), events=s[3])


class ClockTime(StatefulProcessor):
    def __init__(self, gap: int):
        self.gap = -(-gap // 1000)

    def init(self, handle) -> None:
        self.handle, self.pending = handle, handle.getValueState("pending", "first long, last long, event_type string, events long, timer long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        held = tuple(self.pending.get()) if self.pending.exists() else None
        own = [held[:4]] if held else []
        for r in rows:
            own = merged([*own, (r["first"], r["last"], r["event_type"], r["events"])], _EVER)
        timer = timerValues.getCurrentProcessingTimeInMs() + self.gap
        if held and held[4] != timer:
            self.handle.deleteTimer(held[4])
        self.handle.registerTimer(timer)
        self.pending.update((*own[0], timer))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        held = tuple(self.pending.get()) if self.pending.exists() else None
        if held:
            self.pending.clear()
            yield _row(key[0], held)


def dispatch(events: DataFrame, gap_seconds: float = 2.0, watermark: str | None = None) -> DataFrame:
    """Mapped events (file_path, event_type, ts) of a stream -> ``file_path, event_type, ts, session_start, events``.

    Events exactly the gap apart are in one session; of several newest ones the largest type counts. By event time, events whose
    own session has ended by the watermark are dropped; events with no path or time are, too.
    Start the query inside ``state_store``.
    """
    gap = round(gap_seconds * 1_000_000)
    rows = events.where("file_path is not null and ts is not null").select("file_path", F.coalesce("event_type", F.lit("")).alias("event_type"), F.col("ts").cast("timestamp").alias("ts"))
    if watermark is not None:
        return debounce(rows, f"{gap} microseconds", watermark)
    parts = rows.select("file_path", "event_type", F.unix_micros("ts").alias("t")).mapInArrow(_partial(gap), _PART)
    return parts.groupBy("file_path").transformWithState(ClockTime(gap), OUT, "append", "ProcessingTime")
