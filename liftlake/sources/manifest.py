"""Versioned manifests: which folders of a stored table are current.

A version is a JSON file with a number. It is written whole under another name and
then renamed, so a reader sees the last complete version and a job that fails
before its rename has changed nothing. One writer at a time.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession

# Versions whose folders are kept, for readers that began before the newest one.
KEPT_VERSIONS = 2


class Manifest:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, f"{path.rstrip('/')}/manifest"

    def _path(self, name: str = ""):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def _fs(self):
        return self._path().getFileSystem(self.spark._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        """Numbers of the complete versions, oldest first."""
        fs, folder = self._fs(), self._path()
        if not fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(folder)]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith("."))

    def load(self, version: int | None = None) -> dict:
        """Content of a version, by default the newest; empty without one."""
        if version is None:
            known = self.versions()
            if not known:
                return {}
            version = known[-1]
        stream = self._fs().open(self._path(f"{version:012d}.json"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def publish(self, content: dict) -> int:
        """Make ``content`` the next version."""
        known = self.versions()
        version = known[-1] + 1 if known else 0
        fs, name = self._fs(), f"{version:012d}.json"
        draft = self._path(f".{name}.{uuid.uuid4().hex}")
        out = fs.create(draft)
        try:
            out.write(bytearray(json.dumps(content, sort_keys=True).encode()))
        finally:
            out.close()
        if fs.exists(self._path(name)) or not fs.rename(draft, self._path(name)):
            fs.delete(draft, False)
            raise RuntimeError(f"{self.path}/{name} was written by somebody else")
        for old in [v for v in known if v <= version - KEPT_VERSIONS]:
            fs.delete(self._path(f"{old:012d}.json"), False)
        return version

    def children(self, folder: str) -> list[str]:
        """Names of the folders in a folder; none where it does not exist."""
        fs, path = self._fs(), self.spark._jvm.org.apache.hadoop.fs.Path(folder)
        return sorted(s.getPath().getName() for s in fs.listStatus(path) if s.isDirectory()) if fs.exists(path) else []

    def remove(self, folder: str) -> None:
        self._fs().delete(self.spark._jvm.org.apache.hadoop.fs.Path(folder), True)
