"""Files as rows: directory scans and text decoding."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable, Iterable

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from cairn.functions import paths
from cairn.functions.chunking import newlines

SCHEMA = "source string, modified timestamp, size long, content binary"
LISTING = "source string, modified timestamp, size long"
#: Files' contents that are passed on at once: about so many bytes, and at most so many files.
BATCH_BYTES, BATCH_FILES = 1 << 20, 256
#: Files of a listing that are Python objects at once.
LISTED = 1000
#: Tasks that open files, for each core.
TASKS_A_CORE = 4


def _local(path: Column) -> Column:
    return F.regexp_replace(path, r"^file:/+", "/")


def scan(spark: SparkSession, directory: str, recursive: bool = True) -> DataFrame:
    """``source, modified, size, content`` of every file; a missing directory has none."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(directory)
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        return spark.createDataFrame([], SCHEMA)
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    return raw.load(directory).select(_local(F.col("path")).alias("source"), F.col("modificationTime").alias("modified"), F.col("length").alias("size"), "content")


def _hidden(name: str) -> bool:
    """Names that Spark's file sources leave out."""
    return name.startswith(".") or (name.startswith("_") and "=" not in name and not name.startswith(("_common_metadata", "_metadata"))) or name.endswith("._COPYING_")


def _entries(folder: str, recursive: bool):
    """(path, is a folder, entry) of what a local folder has, never its whole listing at once; nothing if it is gone."""
    try:
        with os.scandir(folder) as found:
            for e in found:
                if not _hidden(e.name):
                    below = e.is_dir()
                    yield e.path, below, e
                    if below and recursive:
                        yield from _entries(e.path, True)
    except (FileNotFoundError, NotADirectoryError):
        return


def listing(spark: SparkSession, directory: str, recursive: bool = True) -> DataFrame:
    """``source, modified, size`` as ``scan`` has them, without empty files therefore.

    A local folder's own files are listed by one task, each of its folders by another: ``scan`` gives every 32 files a task and asks for each file's status again.
    """
    if not re.match(r"(file:)?/", directory):
        return scan(spark, directory, recursive).drop("content")
    root = re.sub(r"^file:/+|/+$", lambda m: "/" if m.start() == 0 else "", directory)

    def folders(parts):
        for part in parts:
            own = [p for folder in part["folder"].to_pylist() for p, below, _ in _entries(folder, False) if below]
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.string())], names=["folder"])

    def files(deep: bool):
        def batch(rows: list[tuple]) -> pa.RecordBatch:
            source, modified, size = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(source), pa.array(modified, pa.int64()).cast(pa.timestamp("us", "UTC")), pa.array(size, pa.int64())], names=[x.split()[0] for x in LISTING.split(", ")])

        def run(parts):
            rows = []
            for part in parts:
                for folder in part["folder"].to_pylist():
                    for path, below, e in _entries(folder, deep):
                        if not below and e.is_file() and (s := e.stat()).st_size:
                            rows.append((path, s.st_mtime_ns // 1_000_000 * 1000, s.st_size))
                        if len(rows) >= LISTED:
                            yield batch(rows)
                            rows = []
            if rows:
                yield batch(rows)

        return run

    top = spark.range(1, numPartitions=1).select(F.lit(root).alias("folder"))
    out = top.mapInArrow(files(False), LISTING)
    if not recursive:
        return out
    tasks = TASKS_A_CORE * spark.sparkContext.defaultParallelism
    return out.unionAll(top.mapInArrow(folders, "folder string").repartition(tasks, "folder").mapInArrow(files(True), LISTING))


def contents(paths: DataFrame) -> DataFrame:
    """(source) -> ``source, modified, size, content`` of those that are files, each opened where its row is; nothing goes through the driver.

    Paths are short, so they are dealt out by number: a shuffle's few bytes of them would be one task that opens all files.
    """
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    context = paths.sparkSession.sparkContext
    tasks = max(int(paths.sparkSession.conf.get("spark.sql.shuffle.partitions")), TASKS_A_CORE * context.defaultParallelism)

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        source, modified, data = zip(*rows, strict=True)
        when = pa.array(modified, pa.int64()).cast(pa.timestamp("us", "UTC"))
        return pa.RecordBatch.from_arrays([pa.array(source), when, pa.array(map(len, data), pa.int64()), pa.array(data, pa.binary())], names=names)

    def run(parts):
        for part in parts:
            rows, size = [], 0
            for path in part["source"].to_pylist():
                system, p = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
                info = system.get_file_info(p)
                if info.type != fs.FileType.File:
                    continue
                with system.open_input_stream(p) as f:
                    data = f.read()
                rows.append((path, info.mtime_ns // 1_000_000 * 1000, data))
                size += len(data)
                if size >= BATCH_BYTES or len(rows) >= BATCH_FILES:
                    yield batch(rows)
                    rows, size = [], 0
            if rows:
                yield batch(rows)

    return paths.select("source").repartition(tasks, "source").mapInArrow(run, SCHEMA)


def scan_incremental(spark: SparkSession, directory: str, extensions: Iterable[str] | None = None) -> DataFrame:
    return scan(spark, directory).where(~paths.sync_ignored(F.col("source"), list(extensions) if extensions else None))


def scan_scheduled(spark: SparkSession, directory: str, ignored: Iterable[str] = (), recursive: bool = True) -> DataFrame:
    return scan(spark, directory, recursive).where(~paths.scan_ignored(F.col("source"), list(ignored)))


def list_scheduled(spark: SparkSession, directory: str, ignored: Iterable[str] = (), recursive: bool = True) -> DataFrame:
    """``scan_scheduled`` without contents."""
    return listing(spark, directory, recursive).where(~paths.scan_ignored(F.col("source"), list(ignored)))


def scan_markdown(spark: SparkSession, directory: str) -> DataFrame:
    return scan(spark, directory).where(paths.file_kind(F.col("source")) == "markdown")


def scan_code(spark: SparkSession, directory: str) -> DataFrame:
    return scan(spark, directory).where(paths.file_kind(F.col("source")) == "code")


def decode(files: DataFrame) -> DataFrame:
    """Adds ``text``: Markdown must be valid UTF-8 (null, hence no rows later, if not), other files have bad bytes replaced."""
    strict = F.try_validate_utf8(F.col("content").cast("string"))
    kind = paths.file_kind(F.col("source"))
    text = F.when(kind == "markdown", strict).otherwise(F.make_valid_utf8(F.col("content").cast("string")))
    return files.withColumn("text", newlines(text))


def registry_rows(files: DataFrame, status: str = "processed", now: float | None = None) -> DataFrame:
    """Registry rows of scanned files: mtime, md5, time and status."""
    when = F.lit(now) if now is not None else F.unix_timestamp().cast("double")
    return files.select(F.col("source").alias("file_path"), F.col("modified").cast("double").alias("last_modified"), F.md5("content").alias("file_hash"), when.cast("double").alias("last_vectorized"), F.lit(status).alias("status"), F.col("size").alias("file_size"))


def handle_line(line: str, search: Callable[[str, int, dict], list]) -> str:
    """One JSON line of a tool call -> one JSON line of results or of an error."""
    try:
        call = json.loads(line)
        if call.get("tool") != "document-search":
            return json.dumps({"error": "unsupported tool"})
        args = call.get("arguments", {})
        return json.dumps({"results": search(args["query"], args.get("topK", 5), args.get("filters", {}))}, ensure_ascii=False)
    except Exception as e:
        return json.dumps({"error": str(e)})
