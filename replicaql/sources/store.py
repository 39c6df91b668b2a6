"""Versioned Parquet snapshots with a pointer: writes are whole new versions, commits flip the pointer, rollback is free.

Parquet tables have no row-level MERGE; a snapshot is read by its version, so readers are never disturbed. Paths
go through Hadoop's FileSystem, so any store that Spark reads will do.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import SourceError

ATTEMPTS = 10
#: Seconds that a writer has between making a marker and filling it.
UNDONE = 600


class SnapshotStore:
    def __init__(self, spark: SparkSession, root: str, partition_by: tuple[str, ...] = ()):
        self.spark, self.root, self.partition_by = spark, root.rstrip("/"), partition_by

    def _fs(self, path: str):
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(conf), p

    def versions(self) -> list[int]:
        """Committed versions in order: each has a marker, and one without text is a commit that isn't done."""
        fs, p = self._fs(f"{self.root}/_commits")
        if not fs.exists(p):
            return []
        return sorted(int(s.getPath().getName()) for s in fs.listStatus(p) if s.getPath().getName().isdigit() and s.getLen() > 0)

    def current(self) -> int | None:
        return (self.versions() or [None])[-1]

    def read(self, version: int | None = None) -> DataFrame:
        version = self.current() if version is None else version
        if version is None:
            raise SourceError(f"{self.root} has no committed version")
        return self.spark.read.parquet(f"{self.root}/{self._folder(version)}")

    def _claim(self, number: int, folder: str) -> bool:
        """Makes a version's marker, which names its folder; False if another writer has made it. An empty marker that is older than
        UNDONE is what a writer left that died, and goes."""
        fs, marker = self._fs(f"{self.root}/_commits/{number}")
        if fs.exists(marker):
            held = fs.getFileStatus(marker)
            if held.getLen() > 0 or time.time() - held.getModificationTime() / 1000 < UNDONE:
                return False
            fs.delete(marker, False)
        try:
            out = fs.create(marker, False)
        except Exception:
            if fs.exists(marker):
                return False
            raise
        out.write(bytearray(folder.encode()))
        out.close()
        return True

    def _folder(self, version: int) -> str:
        fs, marker = self._fs(f"{self.root}/_commits/{version}")
        stream = fs.open(marker)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def _put(self, df: DataFrame) -> str:
        folder = f"data-{uuid.uuid4().hex}"
        w = df.write
        (w.partitionBy(*self.partition_by) if self.partition_by else w).parquet(f"{self.root}/{folder}")
        return folder

    def write(self, df: DataFrame) -> int:
        """A whole new version in a folder of its own; it counts from the moment its marker exists, and no marker is
        written twice: a writer that comes second takes the next number."""
        folder, number = self._put(df), (self.current() or 0) + 1
        while not self._claim(number, folder):
            number += 1
        return number

    def replace_user(self, rows: DataFrame, user_id: object, column: str = "user_id") -> int:
        """Overwrites one user's rows."""
        return self.transaction(lambda df: df.where(~F.col(column).eqNullSafe(F.lit(user_id))).unionByName(rows))

    def transaction(self, change: Callable[[DataFrame], DataFrame]) -> int:
        """All or nothing: an error leaves the current version in place. If another writer commits meanwhile, the
        change is made again on that writer's version."""
        for _ in range(ATTEMPTS):
            base = self.current()
            folder = self._put(change(self.read(base)))
            if self.current() == base and self._claim((base or 0) + 1, folder):
                return (base or 0) + 1
        raise SourceError(f"{self.root}: other writers were first {ATTEMPTS} times")

    def rollback(self, version: int) -> None:
        """Drops the markers of later versions."""
        for v in self.versions():
            if v > version:
                fs, marker = self._fs(f"{self.root}/_commits/{v}")
                fs.delete(marker, False)

    def clear(self) -> None:
        fs, p = self._fs(self.root)
        fs.delete(p, True)
