"""Ingestion from file events and periodic scans, as one change of the store per micro-batch."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession, functions as F

from cairn.functions.chunking import chunk_files
from cairn.operators import sync
from cairn.operators.store import ParquetStore
from cairn.sources import files as src
from cairn.streaming.dispatch import dispatch, state_store
from cairn.streaming.events import EVENTS, debounce, latest_events, map_events
from cairn.streaming.listing import file_changes


def embed_chunks(chunks: DataFrame, embedder) -> DataFrame:
    """Blank chunks go, with their vectors: rows and vectors can't come apart."""
    return embedder.embed(chunks.where(~F.col("content").rlike(r"(?U)^\s*$")), "content", "vector")


class Ingestor:
    """Keeps a store up to date with files; ``make_rows`` maps decoded files (source, text) to rows with vectors."""

    def __init__(self, spark: SparkSession, store: ParquetStore, embedder, base_dir: str = "", make_rows: Callable[[DataFrame], DataFrame] | None = None):
        self.spark, self.store = spark, store
        self.make_rows = make_rows or (lambda files: embed_chunks(chunk_files(files.select("source", "text").where("text is not null"), base_dir), embedder))

    def _classified(self, listing: DataFrame) -> tuple[DataFrame, DataFrame]:
        """``file_path, action`` of listed and registered files, and registry rows of those whose contents had to be read to tell."""
        known = self.store.registry()
        state = sync.by_listing(listing.select(F.col("source").alias("file_path"), F.col("modified").cast("double").alias("last_modified"), F.col("size").alias("file_size")), known).persist()
        read = src.registry_rows(src.contents(state.where("state = 'candidate'").select(F.col("file_path").alias("source")))).persist()
        sure = state.where("state <> 'candidate'").select("file_path", F.when(F.col("state") == "same", F.lit("unchanged")).otherwise(F.lit("missing")).alias("action"))
        told = sync.classify(read, known.join(read.select("file_path"), "file_path", "left_semi"))
        actions = sure.unionByName(told).persist()
        actions.count()
        state.unpersist()
        return actions, read

    def sync_files(self, listing: DataFrame, delete_missing: bool = False, deleted: DataFrame | None = None) -> dict[str, int]:
        """Adds new and changed files of a listing (source, modified, size) and drops ``deleted`` (source) ones, with delete_missing all registered ones that aren't there: one commit.

        Contents are read only of files that are new or whose time or size is another than the registered one.
        """
        listing = listing.select("source", "modified", "size").persist()
        actions, read = self._classified(listing)
        try:
            todo = actions.where(F.col("action").isin("add", "update")).select(F.col("file_path").alias("source"))
            counts = {r["action"]: r["count"] for r in actions.groupBy("action").count().collect()}
            out = {"added_files": counts.get("add", 0), "updated_files": counts.get("update", 0), "unchanged_files": counts.get("unchanged", 0), "deleted_files": 0, "added_docs": 0, "deleted_docs": 0}
            out["deleted_files"] = counts.get("missing", 0) if delete_missing else 0
            if out["added_files"] or out["updated_files"] or out["deleted_files"] or deleted is not None:

                def registered(rows: DataFrame) -> DataFrame:
                    per_file = rows.groupBy(F.col("source").alias("file_path")).agg(F.count("*").alias("chunk_count"))
                    out["added_docs"] = rows.count()
                    return read.join(todo.select(F.col("source").alias("file_path")), "file_path", "left_semi").join(per_file, "file_path", "left")

                gone = actions.where(F.col("action").isin(["update", *["missing"] * delete_missing])).select(F.col("file_path").alias("source"))
                rows = self.make_rows(src.decode(src.contents(todo)))
                out["deleted_docs"] = self.store.replace(rows, registry=registered, gone=gone if deleted is None else gone.union(deleted.select("source")))
            return out
        finally:
            for df in (actions, read, listing):
                df.unpersist()

    def apply_events(self, batch: DataFrame, batch_id: int = 0) -> None:
        """For foreachBatch: (file_path, event_type, ts), the newest of each path counts.  Changed files that are gone again are left out."""
        events = latest_events(batch).select(F.col("file_path").alias("source"), "event_type").persist()
        kinds = {r["event_type"]: r["count"] for r in events.groupBy("event_type").count().collect()}
        if kinds:
            changed = src.contents(events.where("event_type = 'modified'")).select("source", "modified", "size")
            self.sync_files(changed, deleted=events.where("event_type = 'deleted'").select("source") if kinds.get("deleted") else None)
        events.unpersist()

    def run_once(self, directories: Iterable[str], ignored: Iterable[str] = (), delete_missing: bool = True) -> dict[str, int]:
        """One periodic scan over directories; a scan of unchanged files reads no contents."""
        files = None
        for d in directories:
            one = src.list_scheduled(self.spark, d, ignored)
            files = one if files is None else files.unionByName(one)
        return self.sync_files(files.dropDuplicates(["source"]), delete_missing)

    def watch(self, event_dir: str, checkpoint: str, ignored: Iterable[str] = (), gap: str = "2 seconds", watermark: str = "0 seconds", **trigger):
        """Streams JSON event files of ``event_dir`` through mapping and debounce into the store; returns the running query."""
        raw = self.spark.readStream.schema(EVENTS).json(event_dir)
        closed = debounce(map_events(raw, ignored), gap, watermark)
        return closed.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(self.apply_events).trigger(**(trigger or {"processingTime": "1 second"})).start()

    def watch_files(self, directories: Iterable[str], checkpoint: str, ignored: Iterable[str] = (), gap_seconds: float = 2.0, **trigger):
        """Streams changes of the files below folders, each path once it has been quiet for the gap by the clock, into the store; returns the running query."""
        raw = file_changes(self.spark, directories, f"{checkpoint}-listings")
        quiet = dispatch(map_events(raw, ignored), gap_seconds)
        with state_store(self.spark):
            return quiet.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(self.apply_events).trigger(**(trigger or {"processingTime": "1 second"})).start()
