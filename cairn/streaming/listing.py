"""A streaming source of file changes: offsets are numbers of listings, events are the difference of two of them.

Each poll lists the watched folders. Its rows (path, time, size) go, as they come, to one Parquet file for each bucket of
paths under ``snapshots``; a listing that is the same as the one before is dropped and the offset stays. A task reads one
bucket of both listings, so that the driver never holds one whole. Listings don't change once they are there: a batch that
is run again after a restart gives the same events, and what changes while nothing runs comes with the next start.
"""

from __future__ import annotations

import hashlib
import json
import time
import uuid
from collections.abc import Iterable, Iterator
from datetime import datetime, timezone

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from cairn.streaming.events import EVENTS

ROWS = pa.schema([("path", pa.string()), ("modified", pa.int64()), ("size", pa.int64())])
#: Buckets of paths by default, and rows of a bucket that wait before they are written.
BUCKETS, WAITING = 32, 8192


def open_folder(uri: str) -> tuple[fs.FileSystem, str, str]:
    """(file system, path in it, what precedes such paths in names of files)."""
    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri.rstrip("/"), ""
    system, path = fs.FileSystem.from_uri(uri)
    path = path.rstrip("/")
    return system, path, "" if uri.startswith("file:") else uri.rstrip("/").removesuffix(path)


def walk(uri: str) -> Iterator[tuple[str, int, int]]:
    """(path, time of modification in ns, size) of all files below a folder, folder by folder; nothing if it isn't there."""
    system, base, prefix = open_folder(uri)
    todo = [base]
    while todo:
        for info in system.get_file_info(fs.FileSelector(todo.pop(), allow_not_found=True)):
            if info.type == fs.FileType.Directory:
                todo.append(info.path)
            elif info.type == fs.FileType.File:
                yield prefix + info.path, info.mtime_ns or 0, info.size or 0


class Bucket(InputPartition):
    def __init__(self, start: int, end: int, bucket: int):
        self.start, self.end, self.bucket = start, end, bucket


class ListingReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.folders, self.target, self.buckets = json.loads(options["directories"]), options["snapshots"].rstrip("/"), int(options.get("buckets", BUCKETS))
        if any((self.target + "/").startswith(d.rstrip("/") + "/") for d in self.folders):
            raise ValueError("the listings' folder is inside a watched one")

    def _state(self, number: int) -> dict:
        if number == 0:
            return {"time": 0, "digest": "0" * 32, "rows": 0, "buckets": self.buckets}
        system, base, _ = open_folder(self.target)
        with system.open_input_stream(f"{base}/{number:010d}/state.json") as f:
            return json.loads(f.read())

    def _numbers(self) -> list[int]:
        system, base, _ = open_folder(self.target)
        found = system.get_file_info(fs.FileSelector(base, allow_not_found=True))
        return sorted(int(x.base_name) for x in found if x.type == fs.FileType.Directory and x.base_name.isdigit())

    def initialOffset(self) -> dict:
        return {"listing": 0}

    def latestOffset(self) -> dict:
        """The number of the newest listing, which is a new one if anything differs from the last."""
        last = (self._numbers() or [0])[-1]
        before = self._state(last)
        if before["buckets"] != self.buckets:
            raise ValueError(f"the listings have {before['buckets']} buckets, not {self.buckets}")
        system, base, _ = open_folder(self.target)
        part = f"{base}/.{uuid.uuid4().hex}"
        system.create_dir(part, recursive=True)
        state = {"time": max(time.time_ns() // 1000, before["time"] + 1), "buckets": self.buckets, **self._write(system, part)}
        if (state["digest"], state["rows"]) == (before["digest"], before["rows"]):
            system.delete_dir(part)
            return {"listing": last}
        with system.open_output_stream(f"{part}/state.json") as f:
            f.write(json.dumps(state).encode())
        system.move(part, f"{base}/{last + 1:010d}")
        return {"listing": last + 1}

    def _write(self, system: fs.FileSystem, part: str) -> dict:
        """Writes the listing by buckets; returns its rows and a digest that doesn't depend on their order."""
        waiting, writers, total, n = [[] for _ in range(self.buckets)], {}, 0, 0

        def flush(b: int) -> None:
            if b not in writers:
                writers[b] = pq.ParquetWriter(f"{part}/{b}.parquet", ROWS, filesystem=system, compression="zstd")
            writers[b].write_table(pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*waiting[b], strict=True), ROWS, strict=True)], schema=ROWS))
            waiting[b].clear()

        seen = sorted({d.rstrip("/") for d in self.folders})
        inner = [d for d in seen if not any(d.startswith(o + "/") for o in seen)]  # a folder inside another one is listed with it
        for row in (r for d in inner for r in walk(d)):
            name = hashlib.md5(row[0].encode("utf-8", "surrogateescape")).digest()
            total = (total + int.from_bytes(hashlib.md5(name + f"{row[1]}:{row[2]}".encode()).digest(), "big")) % (1 << 128)
            n += 1
            b = int.from_bytes(name[:4], "big") % self.buckets
            waiting[b].append(row)
            if len(waiting[b]) >= WAITING:
                flush(b)
        for b in range(self.buckets):
            if waiting[b]:
                flush(b)
        for w in writers.values():
            w.close()
        return {"digest": f"{total:032x}", "rows": n}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [] if start == end else [Bucket(start["listing"], end["listing"], b) for b in range(self.buckets)]

    def _bucket(self, number: int, bucket: int) -> dict[str, tuple[int, int]]:
        system, base, _ = open_folder(self.target)
        path = f"{base}/{number:010d}/{bucket}.parquet"
        if number == 0 or system.get_file_info(path).type != fs.FileType.File:
            return {}
        with system.open_input_file(path) as f:
            rows = pq.read_table(f)
        return dict(zip(rows["path"].to_pylist(), zip(rows["modified"].to_pylist(), rows["size"].to_pylist(), strict=True), strict=True))

    def read(self, partition: Bucket) -> Iterator[pa.RecordBatch]:
        old, new = self._bucket(partition.start, partition.bucket), self._bucket(partition.end, partition.bucket)
        kinds = [(p, "created" if p not in old else "modified") for p, s in new.items() if old.get(p) != s] + [(p, "deleted") for p in old if p not in new]
        when = datetime.fromtimestamp(self._state(partition.end)["time"] / 1e6, timezone.utc)
        for at in range(0, len(kinds), WAITING):
            part = kinds[at : at + WAITING]
            n = len(part)
            yield pa.RecordBatch.from_arrays(
                [pa.array([p for p, _ in part]), pa.nulls(n, pa.string()), pa.array([k for _, k in part]), pa.array([False] * n), pa.array([when] * n, pa.timestamp("us", "UTC"))],
                names=["src_path", "dest_path", "event_type", "is_directory", "ts"],
            )

    def commit(self, end: dict) -> None:
        """Listings before the one that the next batch starts from go, but for one that a batch may be run again from."""
        system, base, _ = open_folder(self.target)
        for number in self._numbers():
            if number < end["listing"] - 1:
                system.delete_dir(f"{base}/{number:010d}")


class FileChanges(DataSource):
    """Options: directories (a JSON list), snapshots (a folder outside of them, for this stream alone), buckets."""

    @classmethod
    def name(cls) -> str:
        return "file_changes"

    def schema(self) -> str:
        return EVENTS

    def streamReader(self, schema) -> DataSourceStreamReader:
        return ListingReader(dict(self.options))


def file_changes(spark: SparkSession, directories: Iterable[str], snapshots: str, buckets: int = BUCKETS) -> DataFrame:
    """The stream of raw events (``EVENTS``) of files below the folders: created, modified (time or size differ) and deleted.

    A move is the deletion of one path and the creation of the other, which ``map_events`` maps as it does a move. ts is the
    time of the listing; several changes of a file between two listings are one. Folders that aren't there have no files;
    one inside another isn't listed twice.
    """
    spark.dataSource.register(FileChanges)
    return spark.readStream.format("file_changes").option("directories", json.dumps(list(directories))).option("snapshots", snapshots).option("buckets", str(buckets)).load()
