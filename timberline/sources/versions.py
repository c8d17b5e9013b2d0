"""Tables that are kept from run to run: a version counts once its marker is there.

A version is a folder with one table for each name. It is written whole, then one empty file, which file systems make
once or not at all, says that it counts; readers take the highest version that has one. So a run that fails changes nothing, and
one that is repeated can tell that its version is there already.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession


class Versions:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _files(self, *parts: str):
        where = self.spark._jvm.org.apache.hadoop.fs.Path("/".join((self.path, *parts)))
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()), where

    def latest(self) -> int:
        """The last version that counts, 0 for none."""
        files, where = self._files("_committed")
        if not files.exists(where):
            return 0
        return max((int(f.getPath().getName().split("-")[0]) for f in files.listStatus(where)), default=0)

    def _folder(self, version: int) -> str:
        files, where = self._files("_committed")
        names = [f.getPath().getName() for f in files.listStatus(where)]
        return f"{self.path}/{next(n for n in sorted(names) if n.split('-')[0] == str(version))}"

    def read(self, name: str, version: int | None = None) -> DataFrame | None:
        """A table of a version (the latest), or None where there is none."""
        version = self.latest() if version is None else version
        return self.spark.read.parquet(f"{self._folder(version)}/{name}") if version else None

    def commit(self, tables: Mapping[str, DataFrame], after: int) -> int:
        """Writes the version that follows ``after``. Where another run has written it meanwhile, that one stands and an error tells so."""
        folder = f"{after + 1}-{uuid.uuid4().hex}"
        for name, table in tables.items():
            table.write.parquet(f"{self.path}/{folder}/{name}")
        if self.latest() != after:
            raise RuntimeError(f"version {after + 1} of {self.path} was written by another run")
        files, where = self._files("_committed", folder)
        files.create(where, False).close()
        return after + 1
