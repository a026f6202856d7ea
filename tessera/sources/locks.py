"""Locks on sources in a shared folder, so that two runs do not write the same ones."""

from __future__ import annotations

import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: Locks of a folder: a source has that of its part, so that their number does not grow with the sources.
PARTS = 64
#: Seconds after its last beat when a lock's owner counts as dead.
STALE_S = 900.0


def lock_of(source: str | Column, parts: int = PARTS) -> Column:
    """The number of a source's lock."""
    return F.pmod(F.xxhash64(F.col(source) if isinstance(source, str) else source), F.lit(parts)).cast("int")


class Locks:
    """Locks as files that only one of many can create; the file system's own times tell dead owners.

    ``take`` gives those of the asked locks that are now held; the others are another owner's. A lock whose owner has not beaten for ``stale_s`` is moved aside, which
    only one of many can do, and taken.
    """

    def __init__(self, spark: SparkSession, folder: str, owner: str | None = None, stale_s: float = STALE_S):
        self.jvm, self.folder, self.owner, self.stale_s = spark._jvm, f"{folder.rstrip('/')}/_locks", owner or uuid.uuid4().hex, stale_s
        self.fs = self._path("x").getFileSystem(spark._jsc.hadoopConfiguration())
        self.held: set[int] = set()

    def _path(self, name):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")

    def _create(self, number: int) -> bool:
        try:
            out = self.fs.create(self._path(number), False)
        except Exception as e:  # noqa: BLE001  any failure but one that says so is raised
            if "AlreadyExists" in str(e):
                return False
            raise
        out.write(bytearray(self.owner.encode()))
        out.close()
        return True

    def _age_s(self, number: int) -> float | None:
        try:
            return time.time() - self.fs.getFileStatus(self._path(number)).getModificationTime() / 1000
        except Exception as e:  # noqa: BLE001
            if "FileNotFound" in str(e):
                return None
            raise

    def take(self, numbers) -> set[int]:
        self.fs.mkdirs(self._path(""))
        got = set()
        for n in sorted(set(numbers)):
            if n in self.held or self._create(n):
                got.add(n)
                continue
            age = self._age_s(n)
            if age is None or age > self.stale_s and self.fs.rename(self._path(n), self._path(f"_stale-{n}-{uuid.uuid4().hex}")):
                if self._create(n):
                    got.add(n)
        self.held |= got
        return got

    def beat(self) -> None:
        """Say that the owner is alive."""
        now = int(time.time() * 1000)
        for n in self.held:
            self.fs.setTimes(self._path(n), now, -1)

    def release(self) -> None:
        for n in list(self.held):
            self.fs.delete(self._path(n), False)
            self.held.discard(n)

    @contextmanager
    def holding(self, numbers) -> Iterator[set[int]]:
        """Those of the locks that could be taken, released in the end whatever happens."""
        try:
            yield self.take(numbers)
        finally:
            self.release()
