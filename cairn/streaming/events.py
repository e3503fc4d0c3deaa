"""File-change events: ignore rule, mapping and debounce, for batch and streaming frames alike."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, functions as F

from cairn.functions.paths import event_ignored

EVENTS = "src_path string, dest_path string, event_type string, is_directory boolean, ts timestamp"


def map_events(raw: DataFrame, ignored: Iterable[str] = (), drop_moves_from_ignored: bool = False) -> DataFrame:
    """(src_path, dest_path, event_type, is_directory, ts) -> (file_path, event_type, ts) with modified and deleted only.

    Created and modified give modified; a move deletes its source and modifies its destination, each unless
    ignored.  drop_moves_from_ignored: a move from an ignored name gives nothing at all.
    """
    src, dest, kind = F.col("src_path"), F.col("dest_path"), F.col("event_type")
    patterns = list(ignored)
    src_ok, dest_ok = ~event_ignored(src, patterns), dest.isNotNull() & ~event_ignored(dest, patterns)
    if drop_moves_from_ignored:
        dest_ok = dest_ok & src_ok
    one = lambda path, what: F.struct(path.alias("file_path"), F.lit(what).alias("event_type"))
    out = F.array(
        F.when(kind.isin("created", "modified") & src_ok, one(src, "modified")),
        F.when(kind.isin("deleted", "moved") & src_ok, one(src, "deleted")),
        F.when((kind == "moved") & dest_ok, one(dest, "modified")),
    )
    rows = raw.where(~F.coalesce(F.col("is_directory"), F.lit(False)))
    return rows.select(F.explode(F.filter(out, lambda e: e.isNotNull())).alias("e"), "ts").select("e.file_path", "e.event_type", "ts")


def debounce(events: DataFrame, gap: str = "2 seconds", watermark: str | None = None) -> DataFrame:
    """The newest event of each path's session; a session ends after ``gap`` without an event of that path.

    Events exactly ``gap`` apart are in one session.  With a watermark it runs on a stream and emits closed sessions.
    """
    rows = events.withWatermark("ts", watermark) if watermark else events
    newest = F.max(F.struct("ts", "event_type"))
    return rows.groupBy("file_path", F.session_window("ts", gap).alias("w")).agg(newest.alias("e"), F.count("*").alias("events")).select("file_path", F.col("e.event_type").alias("event_type"), F.col("e.ts").alias("ts"), F.col("w.start").alias("session_start"), "events")


def latest_events(events: DataFrame) -> DataFrame:
    """The newest event of each path."""
    return events.groupBy("file_path").agg(F.max(F.struct("ts", "event_type")).alias("e")).select("file_path", F.col("e.event_type").alias("event_type"), F.col("e.ts").alias("ts"))
