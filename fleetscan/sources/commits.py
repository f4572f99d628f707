"""Which written tables count: small documents that replace each other as a whole.

Tables are written to folders of their own first. A document then names them, and readers go by
the newest document, so they see all tables of a commit or none, and a write that fails half-way
leaves what there was.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession

KEPT = 3


class Commits:
    """Documents ``<number>.json`` in a folder that Spark reaches. A commit is a rename that fails
    where the number is taken, so of two writers that go on from one state the second is told."""

    def __init__(self, spark: SparkSession, folder: str):
        self._jvm = spark._jvm
        self.folder = folder.rstrip("/")
        at = self._path()
        self._fs = at.getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, *names: str):
        return self._jvm.org.apache.hadoop.fs.Path("/".join((self.folder, *names)))

    def _numbers(self) -> list[int]:
        if not self._fs.exists(self._path()):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path())]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def read(self) -> tuple[int, dict]:
        """The newest document and its number; 0 and an empty one before the first commit."""
        numbers = self._numbers()
        if not numbers:
            return 0, {}
        stream = self._fs.open(self._path(f"{numbers[-1]}.json"))
        try:
            text = self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return numbers[-1], json.loads(text)

    def write(self, after: int, document: dict) -> int:
        """Make ``document`` follow number ``after``."""
        number = after + 1
        draft, target = self._path(f".{uuid.uuid4().hex}"), self._path(f"{number}.json")
        stream = self._fs.create(draft, True)
        try:
            stream.write(bytearray(json.dumps(document).encode()))
        finally:
            stream.close()
        if self._fs.exists(target) or not self._fs.rename(draft, target):
            self._fs.delete(draft, False)
            raise RuntimeError(f"{self.folder}: another writer committed number {number}")
        for old in self._numbers()[:-KEPT]:
            self._fs.delete(self._path(f"{old}.json"), False)
        return number

    def remove(self, folder: str) -> None:
        """Drop a folder of tables that no document names any more."""
        self._fs.delete(self._jvm.org.apache.hadoop.fs.Path(folder), True)
