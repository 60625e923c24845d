"""Commits of a table kept in files: what is not named in a commit is not there."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession


class Ledger:
    """Numbered commits in a folder, each a small file that names a folder of data.

    A commit takes the next number by a rename that fails where that number is taken, so of several writers one
    goes first and the others see its commit and try again."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._known: list[dict] = []

    def _fs(self, path: str):
        place = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return place, place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def entries(self) -> list[dict]:
        """All commits in order; those that have been read are not read again."""
        while True:
            place, fs = self._fs(f"{self.path}/{len(self._known) + 1:010d}.json")
            if not fs.exists(place):
                return list(self._known)
            stream = fs.open(place)
            try:
                text = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
            finally:
                stream.close()
            self._known.append(json.loads(text))

    def find(self, batch: str | None) -> dict | None:
        return next((e for e in self.entries() if batch is not None and e["batch"] == batch), None)

    def commit(self, number: int, entry: dict) -> bool:
        """Make ``entry`` commit ``number``; False if another writer has it."""
        jvm = self.spark.sparkContext._jvm
        staged, fs = self._fs(f"{self.path}/.{uuid.uuid4().hex}")
        target, _ = self._fs(f"{self.path}/{number:010d}.json")
        out = fs.create(staged)
        try:
            jvm.org.apache.commons.io.IOUtils.write(json.dumps(entry), out, "UTF-8")
        finally:
            out.close()
        files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(staged.toUri() if staged.toUri().getScheme() else fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        plain = self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            files.rename(fs.makeQualified(staged), fs.makeQualified(target), plain)
        except Exception:
            fs.delete(staged, False)
            if fs.exists(target):
                return False
            raise
        return True

    def delete(self, path: str) -> None:
        place, fs = self._fs(path)
        fs.delete(place, True)
