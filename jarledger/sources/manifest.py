"""Commits of whole versions: one manifest file a version, made only if it isn't there.

Data files are written first, into folders of their own; a version exists from
the moment its manifest file does.  The file is written under a name of its
own and renamed without overwriting, so a reader never meets half a manifest,
and of two writers that want the same version one is told that it lost.  (On a
store whose rename isn't atomic, point the root at one that is, or at a file
system layer that makes it so.)
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession

KEEP = 16   # manifest files that stay behind the newest one


class Manifest:
    def __init__(self, spark: SparkSession, root: str):
        self.jvm = spark.sparkContext._jvm
        self.gateway = spark.sparkContext._gateway
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.folder = f"{root.rstrip('/')}/_manifest"

    def _path(self, name: str = ""):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}" if name else self.folder)

    def _store(self):
        return self._path().getFileSystem(self.conf)

    def versions(self) -> list[int]:
        """Committed versions in order; no folder means none, any other trouble is raised."""
        store, folder = self._store(), self._path()
        if not store.exists(folder):
            return []
        names = [s.getPath().getName() for s in store.listStatus(folder)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def entry(self, version: int) -> dict:
        stream = self._store().open(self._path(f"{version:012d}.json"))
        try:
            return json.loads(bytes(self.jvm.org.apache.hadoop.io.IOUtils.readFullyToByteArray(stream)).decode())
        finally:
            stream.close()

    def latest(self) -> tuple[int, dict] | None:
        found = self.versions()
        return (found[-1], self.entry(found[-1])) if found else None

    def commit(self, version: int, entry: dict) -> bool:
        """Make ``version``; False if another writer already has."""
        store, temp, name = self._store(), self._path(f".{uuid.uuid4().hex}.tmp"), self._path(f"{version:012d}.json")
        store.mkdirs(self._path())
        out = store.create(temp, False)
        out.write(bytearray(json.dumps(entry).encode()))
        out.close()
        fs = self.jvm.org.apache.hadoop.fs
        none = self.gateway.new_array(getattr(fs, "Options$Rename"), 1)
        none[0] = getattr(fs, "Options$Rename").NONE
        try:
            fs.FileContext.getFileContext(self._path().toUri(), self.conf).rename(temp, name, none)
        except Exception as e:
            store.delete(temp, False)
            if "FileAlreadyExistsException" in str(e):
                return False
            raise
        return True

    def forget(self, keep: int = KEEP) -> None:
        """Remove manifest files far behind the newest one."""
        store = self._store()
        for version in self.versions()[:-keep]:
            store.delete(self._path(f"{version:012d}.json"), False)

    def drop(self, path: str) -> None:
        """Remove a folder of data files that no manifest names any more."""
        where = self.jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(self.conf).delete(where, True)
