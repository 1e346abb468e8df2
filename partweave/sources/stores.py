"""Stores that write back: each change is a new version beside the old one, and one rename makes it the current one.

A version is a folder of Parquet; the file ``commits/<number>`` names it.  A writer writes its folder first, then
renames a file to the next number, which fails if another writer took that number: the change is then made anew from
the version that won, so no change is lost and none is applied twice.  A writer that dies leaves a folder without a
commit, which readers never see and ``vacuum`` removes.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.errors.exceptions.captured import CapturedException
from pyspark.sql import DataFrame, SparkSession


class Conflict(RuntimeError):
    """Other writers were faster at every try."""


class Store:
    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema
        jvm = spark._jvm
        self._fs = jvm.org.apache.hadoop.fs.Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())
        self._context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), spark._jsc.hadoopConfiguration())

    def _path(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join((self.path, *parts)))

    def _names(self, folder: str) -> list[str]:
        where = self._path(folder)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(where)) if self._fs.exists(where) else []

    def commits(self) -> list[int]:
        """The numbers of the versions, oldest first."""
        return [int(n) for n in self._names("commits") if n.isdigit()]

    def _folder(self, number: int) -> str:
        stream = self._fs.open(self._path("commits", f"{number:020d}"))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def read(self, number: int | None = None) -> DataFrame:
        """The current version, or an earlier one; a store without versions is empty."""
        known = self.commits()
        if not known:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/versions/{self._folder(known[-1] if number is None else number)}")

    def update(self, change: Callable[[DataFrame], DataFrame], tries: int = 20) -> int:
        """Makes ``change(current version)`` the current version and gives its number."""
        for _ in range(tries):
            base = max(self.commits(), default=0)
            folder = uuid.uuid4().hex
            change(self.read(base or None)).write.parquet(f"{self.path}/versions/{folder}")
            if self._commit(base + 1, folder):
                return base + 1
        raise Conflict(self.path)

    def _commit(self, number: int, folder: str) -> bool:
        own, to = self._path("commits", f".{folder}"), self._path("commits", f"{number:020d}")
        out = self._fs.create(own, True)
        out.write(bytearray(folder.encode()))
        out.close()
        try:
            self._context.rename(own, to, self.spark._sc._gateway.new_array(self.spark._jvm.org.apache.hadoop.fs.Options.Rename, 0))
        except (Py4JJavaError, CapturedException) as failed:
            self._fs.delete(own, False)
            if "AlreadyExists" in str(failed):
                return False
            raise
        return True

    def vacuum(self, keep: int = 2) -> None:
        """Removes all but the newest versions and folders that no version names; not while others write."""
        known = self.commits()
        named = {self._folder(n) for n in known[-keep:]}
        for n in known[:-keep]:
            self._fs.delete(self._path("commits", f"{n:020d}"), False)
        for folder in self._names("versions"):
            if folder not in named:
                self._fs.delete(self._path("versions", folder), True)
