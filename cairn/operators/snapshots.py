"""Snapshots of a table kept in a folder: JSON manifests, each moved into place whole under its version's number."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession


class Snapshots:
    """Readers see the newest manifest; a change that another one overtook is a RuntimeError."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self.fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def at(self, name: str):
        return self._path(f"{self.path}/{name}")

    def names(self, folder: str) -> list[str]:
        """What a folder of the table holds; nothing if it isn't there."""
        return [s.getPath().getName() for s in self.fs.listStatus(self.at(folder))] if self.fs.exists(self.at(folder)) else []

    def versions(self) -> list[int]:
        return sorted(int(n[:-5]) for n in self.names("manifest") if n.endswith(".json"))

    @property
    def version(self) -> int:
        return self.versions()[-1]

    def read(self, version: int | None = None) -> dict:
        stream = self.fs.open(self.at(f"manifest/{self.version if version is None else version:08d}.json"))
        try:
            return json.loads(bytes(x & 255 for x in stream.readAllBytes()).decode())
        finally:
            stream.close()

    def commit(self, manifest: dict) -> None:
        part = self.at(f"manifest/.{uuid.uuid4().hex}")
        out = self.fs.create(part, False)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        target = self.at(f"manifest/{manifest['version']:08d}.json")
        if self.fs.exists(target) or not self.fs.rename(part, target):
            raise RuntimeError("another change was committed meanwhile")

    def new(self, kind: str, version: int) -> str:
        """A folder name that no other change uses."""
        return f"{kind}/{version:08d}-{uuid.uuid4().hex[:8]}"

    def forget(self, keep: int = 1) -> list[dict]:
        """Deletes all but the newest manifests and returns those that stay."""
        for v in self.versions()[:-keep]:
            self.fs.delete(self.at(f"manifest/{v:08d}.json"), False)
        return [self.read(v) for v in self.versions()]

    def sweep(self, kinds: list[str], live: set[str]) -> None:
        """Deletes the folders of these kinds that no manifest names."""
        for kind in kinds:
            for name in self.names(kind):
                if f"{kind}/{name}" not in live:
                    self.fs.delete(self.at(f"{kind}/{name}"), True)
