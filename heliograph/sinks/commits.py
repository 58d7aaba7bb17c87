"""Versions of a folder that count only once they are committed.

A version's files are written first, under names of their own.  Its commit file is
drafted beside them and moved to its final name in one step, so a reader sees a whole
version or the one before, whatever a run dies of.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession


class Commits:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._fs = self._path().getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, *names: str):
        return self._jvm.org.apache.hadoop.fs.Path("/".join((self.folder, *names)))

    def fresh(self, name: str) -> str:
        """The name of a folder that nothing has been written to."""
        return f"{name}-{uuid.uuid4().hex}"

    def latest(self) -> dict | None:
        """What was committed last, with its ``version``; None if nothing was."""
        folder = self._path("commits")
        if not self._fs.exists(folder):
            return None
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)]
        versions = [int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit()]
        if not versions:
            return None
        file = self._fs.open(self._path("commits", f"{max(versions)}.json"))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(file, "UTF-8"))
        finally:
            file.close()

    def publish(self, version: int, content: dict) -> None:
        """Commits ``content`` as ``version``; RuntimeError if another run was first."""
        draft, final = self._path(self.fresh("draft")), self._path("commits", f"{version}.json")
        out = self._fs.create(draft, False)
        out.write(json.dumps(content | {"version": version}).encode())
        out.close()
        self._fs.mkdirs(self._path("commits"))
        if self._fs.exists(final) or not self._fs.rename(draft, final):
            self._fs.delete(draft, False)
            raise RuntimeError(f"version {version} was published by another run")

    def remove(self, name: str) -> None:
        """Removes a folder that no version a reader may hold refers to."""
        self._fs.delete(self._path(name), True)

    def forget(self, before: int) -> None:
        """Removes the commit files of versions below ``before``."""
        for s in self._fs.listStatus(self._path("commits")):
            name = s.getPath().getName()
            if name[:-5].isdigit() and int(name[:-5]) < before:
                self._fs.delete(s.getPath(), False)
