"""The streaming source of file changes, the stateful dispatch, and both in the ingesting worker."""

import os
import shutil
import time

import pytest
from pyspark.sql import functions as F

from cairn.operators.embedders import HashEmbedder
from cairn.operators.store import ParquetStore
from cairn.plans import live_queries, registry
from cairn.streaming.dispatch import dispatch, merged, state_store
from cairn.streaming.events import map_events
from cairn.streaming.listing import ListingReader, file_changes, walk
from cairn.streaming.worker import Ingestor


def test_merged_sessions():
    a = [(0, 0, "modified", 1), (5, 5, "deleted", 1), (5, 5, "modified", 1), (10, 10, "deleted", 1), (16, 17, "modified", 2)]
    assert merged(a, 5) == [(0, 10, "deleted", 4), (16, 17, "modified", 2)]
    assert merged(list(reversed(a)), 5) == merged(a, 5) and merged([], 5) == []
    assert merged([(0, 0, "a", 1), (20, 20, "a", 1), (2, 18, "b", 3)], 5) == [(0, 20, "a", 5)]


def test_listings_change_only_with_the_files(tmp_path):
    d = tmp_path / "d"
    reader = ListingReader({"directories": f'["{d}", "{d}/in"]', "snapshots": str(tmp_path / "s"), "buckets": "3"})
    assert reader.latestOffset() == {"listing": 0}  # a folder that isn't there
    (d / "in").mkdir(parents=True)
    (d / "in" / "a.md").write_text("a")
    assert [p for p, _, _ in walk(str(d))] == [str(d / "in" / "a.md")]
    assert reader.latestOffset() == reader.latestOffset() == {"listing": 1}
    rows = [r for p in reader.partitions({"listing": 0}, {"listing": 1}) for b in reader.read(p) for r in b.to_pylist()]
    assert [(r["src_path"], r["event_type"]) for r in rows] == [(str(d / "in" / "a.md"), "created")]
    (d / "in" / "a.md").unlink()
    assert reader.latestOffset() == {"listing": 2} and reader.partitions({"listing": 2}, {"listing": 2}) == []
    reader.commit({"listing": 3})
    assert sorted(x.name for x in (tmp_path / "s").iterdir()) == ["0000000002"]
    with pytest.raises(ValueError):
        ListingReader({"directories": f'["{d}"]', "snapshots": str(d / "s")})


def test_changes_of_a_folder_across_restarts(spark, small, tmp_path):
    """Files of the given documents created, changed, deleted and moved between runs of one query; nothing is lost or told twice."""
    d, out = tmp_path / "docs", str(tmp_path / "out")
    d.mkdir()
    docs = spark.read.parquet(f"{small}/documents.parquet").where("text is not null").orderBy("doc_id").limit(30).collect()
    path = lambda i: d / f"{i}.md"
    for i, r in enumerate(docs):
        path(i).write_text(r.text)

    def run():
        raw = file_changes(spark, [str(d)], str(tmp_path / "listings"), buckets=4)
        raw.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "ckpt")).trigger(availableNow=True).start().awaitTermination(120)
        return {(os.path.basename(r.src_path), r.event_type) for r in spark.read.parquet(out).collect()}, spark.read.parquet(out).count()

    want = {(f"{i}.md", "created") for i in range(30)}
    assert run() == (want, 30) and run() == (want, 30)
    for i in range(0, 5):
        path(i).write_text("changed " * (i + 1))
    for i in range(5, 9):
        path(i).unlink()
    for i in range(9, 12):
        path(i).rename(d / f"moved{i}.md")
    want |= {(f"{i}.md", "modified") for i in range(5)} | {(f"{i}.md", "deleted") for i in range(5, 12)} | {(f"moved{i}.md", "created") for i in range(9, 12)}
    assert run() == (want, 45)
    mapped = map_events(spark.read.parquet(out)).select("file_path", "event_type")
    assert mapped.where("event_type = 'deleted'").count() == 7


def test_dispatch_equals_sessions_in_batch(spark, small):
    """Every mapped event, out of order and in several runs of one query, gives the sessions of the batch form, which equals its SQL."""
    shape = lambda df: sorted(map(tuple, df.select("file_path", "event_type", "ts", "session_start", "events").collect()))
    want = shape(registry.QUERIES["debounce_sessions"](spark, small))
    assert len(want) > 100 and shape(live_queries.dispatch_sessions(spark, small)) == want


def test_dispatch_by_event_time_has_no_python_step(spark, tmp_path):
    """A call a path in Python took most of the time; a busy path's events are merged before the shuffle by a setting that goes again."""
    key = "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition"
    stream = spark.readStream.schema("file_path string, event_type string, ts timestamp").parquet(str(tmp_path))
    plan = dispatch(stream, 7200, "2 hours")._jdf.queryExecution().analyzed().toString().lower()
    assert "session_window" in plan and "transformwithstate" not in plan and "arrow" not in plan
    before = spark.conf.get(key)
    with state_store(spark):
        assert spark.conf.get(key) == "true"
    assert spark.conf.get(key) == before


def test_file_changes_query(spark, small):
    """Against the rule by which the query changes its files."""
    ids = [r.doc_id for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id").collect()]
    want = []
    for g in {i // 20 for i in ids}:
        want.append((1, f"/{g}.md", "created"))
        want += {1: [(2, f"/{g}.md", "modified")], 2: [(2, f"/{g}.md", "deleted")], 3: [(2, f"/{g}.md", "deleted"), (2, f"/moved-{g}.md", "created")]}.get(g % 5, [])
    assert sorted(map(tuple, live_queries.file_changes(spark, small).select("run", "name", "event_type").collect())) == sorted(want)


def test_worker_follows_a_folder(spark, tmp_path):
    """A live query, by the clock: files come, change and go without any later event to push them on."""
    d = tmp_path / "docs"
    d.mkdir()
    store = ParquetStore(spark, str(tmp_path / "s"), shards=2)
    worker = Ingestor(spark, store, HashEmbedder(8))
    (d / "a.md").write_text("# A\n\nfirst text\n")
    (d / "skip.bin").write_text("x")
    query = worker.watch_files([str(d)], str(tmp_path / "ckpt"), gap_seconds=0.5, processingTime="500 milliseconds")

    def until(test):
        end = time.time() + 90
        while not test():
            assert query.exception() is None and time.time() < end
            time.sleep(0.3)

    try:
        until(lambda: store.file_exists(str(d / "a.md")))
        (d / "a.md").write_text("# A\n\nsecond text, longer\n")
        shutil.copy(d / "a.md", d / "b.md")
        until(lambda: store.file_exists(str(d / "b.md")) and "second" in " ".join(r.content for r in store.df().where(F.col("source") == str(d / "a.md")).collect()))
        (d / "a.md").unlink()
        until(lambda: not store.file_exists(str(d / "a.md")))
        assert {r.source for r in store.df().collect()} == {str(d / "b.md")}
    finally:
        query.stop()
