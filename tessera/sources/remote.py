"""Remote sources as a Spark data source: lists of addresses, fetched by a provider in planned partitions, in batch and as a stream.

    spark.dataSource.register(RemoteSources)
    spark.read.format("evidence_sources").option("provider", "my_package.fetch:download").load("/shared/lists")
    spark.readStream.format("evidence_sources").option("provider", ...).option("per_trigger", "100").load("/shared/lists")

A list is a folder of text files that driver and executors share, an address a line; lists grow by new files of later names, or by lines at the end of the
last one. The provider, ``module:name``, is called on the executors with an address and gives a dict with ``title``, ``duration_s`` and ``items``, a list of
(start_s, end_s, text), or raises.
"""

from __future__ import annotations

import os
import time
from collections.abc import Callable, Iterator
from hashlib import sha256
from importlib import import_module

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "url string, video_id string, title string, duration_s double, items array<struct<start_s:double,end_s:double,text:string>>, status string, error_class string, error string, attempts int"
#: Words of an error that say what failed, looked for in this order (fixed values).
ERRORS = (("auth", ("cookie", "sign in", "login", "bot")), ("network", ("timeout", "timed out", "temporarily", "connection")), ("unavailable", ("404", "unavailable", "private", "removed")))
#: Attempts at an address, and the seconds before another one, times the attempt.
ATTEMPTS, WAIT_S = 3, 1.5


def error_class(message: str) -> str:
    low = message.lower()
    return next((kind for kind, words in ERRORS if any(w in low for w in words)), "unknown")


def source_id(url: str) -> str:
    return sha256(url.encode("utf-8", "surrogatepass")).hexdigest()[:24]


def addresses(folder: str, start: int = 0, end: int | None = None, unended: bool = True) -> Iterator[str]:
    """The addresses of a list with numbers in [start, end): non-blank lines, file by file by name; lines that open with # are notes.

    Without ``unended``, a line that does not end yet is left out: it may still be being written.
    """
    number = 0
    names = [folder] if os.path.isfile(folder) else [os.path.join(folder, n) for n in sorted(os.listdir(folder)) if not n.startswith((".", "_"))]
    for name in names:
        with open(name, encoding="utf-8", errors="replace") as f:
            for line in f:
                url = line.strip()
                if not url or url.startswith("#") or not unended and not line.endswith("\n"):
                    continue
                if end is not None and number >= end:
                    return
                if number >= start:
                    yield url
                number += 1


def fetch(url: str, provider: Callable, attempts: int = ATTEMPTS, wait_s: float = WAIT_S) -> tuple:
    """A row of an address: what the provider gave, or its last error. Only errors of the network are tried again."""
    for attempt in range(1, max(1, attempts) + 1):
        try:
            got = provider(url) or {}
            items = [(float(s), float(e), str(t)) for s, e, t in got.get("items") or []]
            length = got.get("duration_s")
            return url, str(got.get("video_id") or source_id(url)), got.get("title"), float(length) if length is not None else max((e for _, e, _ in items), default=None), items, "succeeded", None, None, attempt
        except Exception as e:  # noqa: BLE001  an address that fails is a row
            said = str(e).strip().splitlines()[0][:500] if str(e).strip() else type(e).__name__
            kind = error_class(said)
            if kind != "network" or attempt == max(1, attempts):
                return url, source_id(url), None, None, None, "failed", kind, said, attempt
            time.sleep(wait_s * attempt)
    raise AssertionError("unreachable")


class _Stretch(InputPartition):
    def __init__(self, start: int, end: int):
        self.start, self.end = start, end


class _Reader:
    unended = True

    def __init__(self, options):
        self.folder = options.get("path")
        if not self.folder or ":" not in options.get("provider", ""):
            raise ValueError("evidence_sources needs a path and a provider as module:name")
        self.provider = options["provider"]
        self.size = max(1, int(options.get("partition_size", "16")))
        self.attempts, self.wait_s = int(options.get("attempts", str(ATTEMPTS))), float(options.get("wait_s", str(WAIT_S)))

    def count(self) -> int:
        return sum(1 for _ in addresses(self.folder, unended=self.unended))

    def stretches(self, start: int, end: int) -> list[_Stretch]:
        return [_Stretch(at, min(end, at + self.size)) for at in range(start, end, self.size)]

    def read(self, partition: _Stretch) -> Iterator[tuple]:
        module, _, name = self.provider.partition(":")
        provider = getattr(import_module(module), name)
        for url in addresses(self.folder, partition.start, partition.end, self.unended):
            yield fetch(url, provider, self.attempts, self.wait_s)


class _BatchReader(_Reader, DataSourceReader):
    def partitions(self) -> list[_Stretch]:
        return self.stretches(0, self.count()) or [_Stretch(0, 0)]


class _StreamReader(_Reader, DataSourceStreamReader):
    """Offsets are numbers of addresses; ``per_trigger`` of them are admitted at once (0: all)."""

    unended = False

    def __init__(self, options):
        super().__init__(options)
        self.limit = int(options.get("per_trigger", "256"))
        self.upto: int | None = None

    def initialOffset(self) -> dict:  # noqa: N802
        return {"n": 0}

    def latestOffset(self) -> dict:  # noqa: N802
        total = self.count()
        self.upto = min(total, (self.upto or 0) + self.limit) if self.limit > 0 else total
        return {"n": self.upto}

    def partitions(self, start: dict, end: dict) -> list[_Stretch]:
        self.upto = max(self.upto or 0, end["n"])  # after a restart the stream goes on where its checkpoint says
        return self.stretches(start["n"], end["n"])

    def commit(self, end: dict) -> None:
        self.upto = max(self.upto or 0, end["n"])


class RemoteSources(DataSource):
    """``evidence_sources``: a row for each address, failures included."""

    @classmethod
    def name(cls) -> str:
        return "evidence_sources"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> _BatchReader:
        return _BatchReader(self.options)

    def streamReader(self, schema) -> _StreamReader:  # noqa: N802
        return _StreamReader(self.options)


def items_of(rows):
    """(video_id, item_ord, start_s, end_s, text) of the rows that succeeded: what ``Workspace.ingest`` writes."""
    from pyspark.sql import functions as F

    found = rows.where("status = 'succeeded'").select("video_id", F.posexplode("items").alias("item_ord", "x"))
    return found.select("video_id", F.col("item_ord").cast("long").alias("item_ord"), "x.start_s", "x.end_s", "x.text")
