"""The Parquet store, sync, ingestion, streaming and the API."""

import json
import os
import time

import pytest
from pyspark.sql import functions as F

from cairn.config import EngineConfig
from cairn.functions import chunking, paths
from cairn.operators import aggregates, sync
from cairn.operators.embedders import HashEmbedder
from cairn.operators.store import ParquetStore
from cairn.plans.cache import TtlCache
from cairn.plans.engine import Engine
from cairn.sources import files as src
from cairn.streaming.events import debounce, map_events
from cairn.streaming.worker import Ingestor


def nine(spark):
    rows = [(f"テスト文書{i}", f"/path/to/test{i}.md", "markdown", [float(j == i % 4) for j in range(4)]) for i in range(9)]
    return spark.createDataFrame(rows, "content string, source string, source_type string, vector array<float>")


def test_store(spark, tmp_path):
    s = ParquetStore(spark, str(tmp_path / "s"), shards=3)
    assert s.df().count() == 0
    s.add(nine(spark), now=5)
    assert s.df().count() == 9 and {r.created_at for r in s.df().collect()} == {5}
    per = {r.shard: r.documents for r in aggregates.shard_stats(s.df(), 3).collect()}
    assert per == {0: 3, 1: 4, 2: 2}
    assert aggregates.imbalance(aggregates.shard_stats(s.df(), 3), 0.5).first().status == "pending"
    assert s.file_exists("/path/to/test1.md") and not s.file_exists("/nonexistent")
    assert s.delete_file("/path/to/test1.md") == 1 and not s.file_exists("/path/to/test1.md") and s.df().count() == 8
    assert s.delete_file("/path/to/test1.md") == 0
    for i in (3, 7):  # empties a shard
        assert s.delete_file(f"/path/to/test{i}.md") == 1
    assert {r.shard for r in s.df().select("shard").distinct().collect()} == {0, 1} and s.df().count() == 6
    s.replace(nine(spark).where("source = '/path/to/test0.md'").withColumn("content", F.lit("new")))
    assert [r.content for r in s.source_rows("/path/to/test0.md").collect()] == ["new"] and s.df().count() == 6
    row = s.source_rows("/path/to/test0.md").first()
    s.upsert(spark.createDataFrame([(row.id, "newer", row.source, [1.0])], "id long, content string, source string, vector array<float>"))
    assert s.source_rows(row.source).first().content == "newer" and s.source_rows(row.source).first().source_type == "unknown"
    s.remove_ids(spark.createDataFrame([(row.id,)], "id long"))
    assert s.df().count() == 5
    s.compact()
    assert s.df().count() == 5 and len(os.listdir(tmp_path / "s" / "data")) == 1
    again = ParquetStore(spark, str(tmp_path / "s"), shards=99)
    assert again.shards == 3 and again.df().count() == 5
    s.add(nine(spark).limit(0))
    with pytest.raises(ValueError):
        s.add(nine(spark).withColumn("vector", F.lit(None).cast("array<float>")))
    with pytest.raises(ValueError):
        ParquetStore(spark, str(tmp_path / "t"), dimension=8, strict_dimension=True).add(nine(spark))


def test_needs_update(spark):
    now = spark.createDataFrame([("a", "h", 1.0), ("b", "x", 1.0), ("c", "h", 2.0), ("new", "h", 1.0)], "file_path string, file_hash string, last_modified double")
    then = spark.createDataFrame([("a", "h", 1.0), ("b", "h", 1.0), ("c", "h", 1.0), ("gone", "h", 1.0)], "file_path string, file_hash string, last_modified double")
    assert {r.file_path: r.action for r in sync.classify(now, then).collect()} == {"a": "unchanged", "b": "update", "c": "update", "new": "add", "gone": "missing"}


def test_p95(spark):
    df = spark.range(100).select(F.col("id").cast("double").alias("seconds"))
    assert aggregates.latency_summary(df).first().p95 == 95
    assert aggregates.latency_summary(df.limit(20)).first().p95 == 19
    assert aggregates.imbalance(spark.createDataFrame([(0, 0)] * 3, "shard int, documents long")).first().status == "skipped"


def test_scans(spark, tmp_path):
    for name, data in (("a.md", b"# A\r\nx"), ("b.py", b"def f():\n  pass\n"), ("c.txt", b"c"), (".h.md", b"h"), ("~t.md", b"t"), ("bad.md", b"\xff"), ("bad.py", b"x=\xff"), ("sub/d.MD", b"# D"), ("venv/e.py", b"e"), (".git/f.md", b"f")):
        p = tmp_path / name
        p.parent.mkdir(exist_ok=True)
        p.write_bytes(data)
    d = str(tmp_path)
    names = lambda df: sorted(r.source.removeprefix(d + "/") for r in df.select("source").collect())
    assert "c.txt" in names(src.scan_incremental(spark, d)) and "~t.md" not in names(src.scan_incremental(spark, d))
    assert names(src.scan_incremental(spark, d, [".MD"])) == ["a.md", "bad.md", "sub/d.MD"]
    assert names(src.scan_scheduled(spark, d, ["bad"])) == ["a.md", "b.py", "sub/d.MD", "~t.md"]
    assert "sub/d.MD" not in names(src.scan_scheduled(spark, d, recursive=False))
    assert "b.py" in names(src.scan_code(spark, d)) and "a.md" in names(src.scan_markdown(spark, d))
    text = {os.path.basename(r.source): r.text for r in src.decode(src.scan(spark, d)).collect()}
    assert text["a.md"] == "# A\nx" and text["bad.md"] is None and text["bad.py"] == "x=\ufffd"
    assert src.scan(spark, d + "/none").count() == 0


def test_ingest_and_api(spark, tmp_path):
    d = tmp_path / "docs"
    d.mkdir()
    for name, title in (("docker_guide", "Docker環境"), ("python_optimization", "Python"), ("vector_search", "Vector")):
        (d / f"{name}.md").write_text(f"# {title}\n\nabout {title} and more\n")
    store = ParquetStore(spark, str(tmp_path / "s"), shards=2)
    worker = Ingestor(spark, store, HashEmbedder(16))
    assert worker.run_once([str(d)])["added_files"] == 3
    assert worker.run_once([str(d)]) == {"added_files": 0, "updated_files": 0, "unchanged_files": 3, "deleted_files": 0, "added_docs": 0, "deleted_docs": 0}
    (d / "vector_search.md").write_text("# Vector\n\nchanged\n")
    (d / "python_optimization.md").unlink()
    out = worker.run_once([str(d)])
    assert (out["updated_files"], out["deleted_files"], out["unchanged_files"]) == (1, 1, 1)
    assert store.df().count() == 2 and store.registry().count() == 2
    e = Engine(spark, store, HashEmbedder(16), EngineConfig(max_batch=3))
    first = e.query("about docker", 3)
    assert first["total"] == 2 and not first["cached"] and set(first["results"][0]) >= {"content", "metadata", "score"}
    again = e.query("about docker", 3)
    assert again["cached"] and again["results"] == first["results"]
    batch = e.batch_query(["a", "b", "a"], 1)
    assert [r["query"] for r in batch["results"]] == ["a", "b", "a"] and batch["total"] == 3
    assert batch["results"][0]["results"][0]["content"] == e.query("a", 1)["results"][0]["content"]
    assert "Docker" in e.keyword_search("Docker環境", 2)["results"][0]["content"]
    assert e.hybrid_search("Docker環境", 1, vector_weight=0.4, text_weight=0.6)["results"][0]["text_match"] == 0.9
    assert e.query("x", 5, {"source_type": "markdown"})["total"] == 2 and e.query("x", 5, {"source_type": "pdf"})["total"] == 0
    for bad in (lambda: e.query("x", 0), lambda: e.batch_query(["a"] * 4), lambda: e.hybrid_search("x", 1, vector_weight=2)):
        with pytest.raises(ValueError):
            bad()
    s = e.stats()
    assert s["document_count"] == s["total_documents"] == 2 and s["documents_by_type"] == {"markdown": 2} and s["cache_info"]["query"]["size"] > 0
    assert e.optimize()["details"]["execution_time_ms"] > 0 and not e.query("about docker", 3)["cached"]
    assert json.loads(e.handle('{"tool": "document-search", "arguments": {"query": "a", "topK": 1}}'))["results"][0]["score"] is not None
    assert json.loads(e.handle('{"tool": "other"}')) == {"error": "unsupported tool"} and "error" in json.loads(e.handle("{"))
    assert 'engine_queries_processed_total{type="query",cached="true"} 1' in e.metrics_text() and e.health() == {"status": "healthy"}
    assert e.rebalance_report()["status"] in ("skipped", "pending")


def test_cache():
    now = [0.0]
    c = TtlCache(2, 10, lambda: now[0])
    c.put("a", 1), c.put("b", 2)
    assert c.get("a") == 1
    c.put("c", 3)
    assert c.get("b") is None and c.get("a") == 1
    now[0] = 11
    assert c.get("a") is None


def test_events(spark):
    raw = [("/a/x.md", None, "created"), ("/a/x.tmp", "/b/y.md", "moved"), ("/a/z.md", "/b/z.tmp", "moved"), ("/a/d.md", None, "deleted"), ("/a/o.md", None, "opened")]
    df = spark.createDataFrame([(*r, False, 1) for r in raw] + [("/a/q.md", None, "created", True, 1)], "src_path string, dest_path string, event_type string, is_directory boolean, t long").withColumn("ts", F.timestamp_seconds("t"))
    got = lambda **k: sorted((r.file_path, r.event_type) for r in map_events(df, **k).collect())
    assert got() == [("/a/d.md", "deleted"), ("/a/x.md", "modified"), ("/a/z.md", "deleted"), ("/b/y.md", "modified")]
    assert ("/b/y.md", "modified") not in got(drop_moves_from_ignored=True)
    ev = spark.createDataFrame([("a", "modified", 0), ("a", "modified", 1), ("a", "deleted", 5), ("b", "modified", 0), ("b", "deleted", 2)], "file_path string, event_type string, t long").withColumn("ts", F.timestamp_seconds("t"))
    rows = sorted((r.file_path, r.event_type, r.events) for r in debounce(ev).collect())
    assert rows == [("a", "deleted", 1), ("a", "modified", 2), ("b", "deleted", 2)]


def test_streaming(spark, tmp_path):
    docs, events = tmp_path / "docs", tmp_path / "events"
    docs.mkdir(), events.mkdir()
    (docs / "n.md").write_text("# New\n\nstreamed text\n")
    store = ParquetStore(spark, str(tmp_path / "s"), shards=2)
    worker = Ingestor(spark, store, HashEmbedder(8))

    def send(name, *rows):
        (events / name).write_text("".join(json.dumps({"src_path": p, "event_type": k, "is_directory": False, "ts": t}) + "\n" for p, k, t in rows))
        worker.watch(str(events), str(tmp_path / "ckpt"), availableNow=True).awaitTermination(120)

    path = str(docs / "n.md")
    send("1.json", (path, "created", "2024-01-01T00:00:00Z"), (path, "modified", "2024-01-01T00:00:01Z"))
    time.sleep(0.1)
    send("2.json", (str(docs / "later.md"), "modified", "2024-01-01T00:10:00Z"))  # moves the watermark past the first session
    assert store.file_exists(path)
    (docs / "n.md").unlink()
    send("3.json", (path, "deleted", "2024-01-01T00:20:00Z"))
    send("4.json", (str(docs / "later.md"), "modified", "2024-01-01T00:30:00Z"))
    assert not store.file_exists(path)


def test_registry_and_schedule(spark, tmp_path):
    from cairn.plans.cli import schedule, serve

    d = tmp_path / "docs"
    d.mkdir()
    (d / "a.md").write_text("# A\n\ntext\n")
    store = ParquetStore(spark, str(tmp_path / "s"), shards=2)
    assert not store.file_needs_update(str(d / "none.md")) and store.file_needs_update(str(d / "a.md"))
    waits = []
    out = schedule(Ingestor(spark, store, HashEmbedder(8)), [str(d)], 5, rounds=2, sleep=waits.append, clock=lambda: 0.0)
    assert [x["added_files"] for x in out] == [1, 0] and waits == [5.0]
    assert not store.file_needs_update(str(d / "a.md"))
    (d / "a.md").write_text("# A\n\nother\n")
    assert store.file_needs_update(str(d / "a.md"))
    store.update_registry(spark.createDataFrame([("x", "error")], "file_path string, status string"))
    assert {r.status for r in store.registry().collect()} == {"processed", "error"} and store.df().count() == 1
    assert store.scroll(5, {"source_type": "markdown"}).count() == 1 and store.cached().count() == 1
    lines = []
    serve(Engine(spark, store, HashEmbedder(8)), ['{"tool": "document-search", "arguments": {"query": "a"}}', "", "x"], lines.append)
    assert len(json.loads(lines[0])["results"]) == 1 and "error" in json.loads(lines[1])


def test_listing_equals_scan_in_few_tasks(spark, tmp_path):
    """Paths, times and sizes as the file source has them, hidden names and nested folders among them; a task a folder instead of one for 32 files."""
    for name in ("a.md", "b c.txt", ".h.md", "_t.md", "_x=1.md", "sub/d.MD", "sub/.git/e.md", "sub/_tmp/f.md", "sub/deep/g.py", "other/h.py", "y.md._COPYING_"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(name)
    for i in range(300):
        (tmp_path / f"n{i}.md").write_text("x" * i)
    for d in (str(tmp_path), f"file://{tmp_path}/", f"{tmp_path}/none"):
        for deep in (True, False):
            rows = lambda df: sorted(map(tuple, df.select("source", "modified", "size").collect()))
            assert rows(src.listing(spark, d, deep)) == rows(src.scan(spark, d, deep)), (d, deep)
    assert src.listing(spark, str(tmp_path), False).rdd.getNumPartitions() == 1
    both = src.contents(src.listing(spark, str(tmp_path)).select("source"))
    assert sorted((r.source, bytes(r.content)) for r in both.collect()) == sorted((r.source, bytes(r.content)) for r in src.scan(spark, str(tmp_path)).collect())


def test_chunking_reads_files_once(spark):
    """One pass over the files for both kinds, with the rows that each kind gives by itself."""
    files = spark.createDataFrame([("/a/x.md", "# T\n\nsome text\n## U\nmore"), ("/a/y.py", "import a\ndef f(x):\n  pass\nclass A:\n  pass\n"), ("/a/z.js", "function go(a) {\n}\n"), ("/a/w.txt", "no"), ("/a/n.md", None)], "source string, text string")
    got = chunking.chunk_files(files)
    kind = lambda k: files.where(paths.file_kind(F.col("source")) == k)
    apart = chunking.chunk_markdown_files(kind("markdown")).unionByName(chunking.chunk_code_files(kind("code")), allowMissingColumns=True)
    assert got.columns == apart.columns and got.dtypes == apart.dtypes
    rows = lambda df: sorted(map(str, df.collect()))
    assert rows(got) == rows(apart) and got.count() > 4
    assert "Union" not in got._jdf.queryExecution().analyzed().toString()
