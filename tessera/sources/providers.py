"""Boundaries to external models and media tools, with deterministic defaults where there are any.

A provider is called on batches inside the executors; what it gives is data like any other. Speech recognition, downloads and
video decoding have no default, so they raise until one is configured.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Protocol

from pyspark.sql import DataFrame


class Embedder(Protocol):
    def embed(self, texts: list[str]) -> list[list[float]]: ...


class HashingEmbedder:
    """Hashed bags of words of unit length: what retrieval's sparse vectors hold, as dense lists."""

    def __init__(self, dims: int = 128):
        self.dims = dims

    def embed(self, texts: list[str]) -> list[list[float]]:
        from hashlib import sha256

        out = []
        for text in texts:
            v = [0.0] * self.dims
            for word in text.lower().split():
                v[int.from_bytes(sha256(word.encode()).digest()[:4], "big") % self.dims] += 1.0
            size = sum(x * x for x in v) ** 0.5
            out.append([x / size for x in v] if size else v)
        return out


class Unavailable(RuntimeError):
    """No provider of this kind is configured."""


def missing(kind: str) -> Callable:
    def call(*_args, **_kwargs):
        raise Unavailable(f"no {kind} provider is configured")

    return call


@dataclass
class Providers:
    """The providers of a session."""

    embedder: Embedder = field(default_factory=HashingEmbedder)
    transcribe: Callable = field(default_factory=lambda: missing("speech recognition"))
    download: Callable = field(default_factory=lambda: missing("download"))
    decode_frames: Callable = field(default_factory=lambda: missing("frame decoding"))
    caption: Callable | None = None
    chat: Callable | None = None


def embed(rows: DataFrame, embedder: Embedder, key: str, text: str = "text") -> DataFrame:
    """(key, embedding): texts through an embedder, a batch at a time."""
    kind = dict(rows.dtypes)[key]

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        for pdf in batches:
            yield pd.DataFrame({key: pdf[key], "embedding": embedder.embed([t or "" for t in pdf[text]])})

    return rows.select(key, text).mapInPandas(run, f"`{key}` {kind}, embedding array<double>")


def captions(frames: DataFrame, caption: Callable | None, key: str = "frame_id") -> DataFrame:
    """(key, caption, status): captions of frames; without a model every status is missing_model, and a failure is a row."""
    kind = dict(frames.dtypes)[key]

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        for pdf in batches:
            said, status = [], []
            for path in pdf["path"]:
                try:
                    said.append("" if caption is None else caption(path))
                    status.append("missing_model" if caption is None else "success")
                except Exception:  # noqa: BLE001  a frame that fails must not fail the batch
                    said.append("")
                    status.append("failed")
            yield pd.DataFrame({key: pdf[key], "caption": said, "status": status})

    return frames.select(key, "path").mapInPandas(run, f"`{key}` {kind}, caption string, status string")


class ServiceError(RuntimeError):
    """What a service answered instead of a result."""

    def __init__(self, status: int, message: str = ""):
        super().__init__(f"status {status}: {message}" if message else f"status {status}")
        self.status = status


#: Statuses after which a call is tried again, and the one that asks for a pause (fixed values).
RETRIED, TOO_MANY = (500, 502, 503, 504), 429
#: Attempts at a call; seconds before another one, times the attempt, and at least so many after TOO_MANY.
ATTEMPTS, WAIT_S, COOLDOWN_S = 3, 1.5, 30.0


def attempted(call: Callable, argument, attempts: int = ATTEMPTS, wait_s: float = WAIT_S, cooldown_s: float = COOLDOWN_S, sleep=None) -> tuple:
    """(reply, status, error, attempts) of a call: ``succeeded``, ``missing_provider`` or ``failed``. Time-outs and overloads are tried again."""
    import time

    for attempt in range(1, max(1, attempts) + 1):
        try:
            return str(call(argument)), "succeeded", None, attempt
        except Unavailable as e:
            return None, "missing_provider", str(e), attempt
        except Exception as e:  # noqa: BLE001  a call that fails is a row
            said = (str(e).strip().splitlines() or [type(e).__name__])[0][:500] or type(e).__name__
            status = getattr(e, "status", None)
            again = status in (*RETRIED, TOO_MANY) or isinstance(e, (TimeoutError, ConnectionError)) or "timed out" in said.lower() or "timeout" in said.lower()
            if not again or attempt == max(1, attempts):
                return None, "failed", said, attempt
            (sleep or time.sleep)(max(cooldown_s, wait_s * attempt) if status == TOO_MANY else wait_s * attempt)
    raise AssertionError("unreachable")


def called(rows: DataFrame, key: str, argument: str, call: Callable, **options) -> DataFrame:
    """(key, reply, status, error, attempts): each row's argument through a service, one at a time in a task; see ``attempted``.

    Null arguments are not sent: their status is ``skipped``. How many calls run at once is the number of partitions of the rows.
    """
    kind = dict(rows.dtypes)[key]

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        for pdf in batches:
            got = [attempted(call, a, **options) if a is not None and a == a else (None, "skipped", None, 0) for a in pdf[argument]]
            yield pd.DataFrame({key: pdf[key], "reply": [g[0] for g in got], "status": [g[1] for g in got], "error": [g[2] for g in got], "attempts": [g[3] for g in got]})

    return rows.select(key, argument).mapInPandas(run, f"`{key}` {kind}, reply string, status string, error string, attempts int")


def transcribed(media: DataFrame, transcribe: Callable, key: str = "video_id", path: str = "path", **options) -> tuple[DataFrame, DataFrame]:
    """(items, calls): transcript items of media files by a recogniser that gives its verbose reply as JSON, and how each call went."""
    from tessera.sources.media import recognised_items
    from tessera.storage import materialise

    calls = materialise(called(media, key, path, transcribe, **options))
    return recognised_items(calls.where("status = 'succeeded'"), key, "reply"), calls.drop("reply")


def recalled(questions: DataFrame, search: Callable, key: str = "question_id", text: str = "question", **options) -> tuple[DataFrame, DataFrame]:
    """(rows, calls): what a memory service finds for each question, as (key, pos, content), and how each call went."""
    from tessera.sources.media import search_rows
    from tessera.storage import materialise

    calls = materialise(called(questions, key, text, search, **options))
    return search_rows(calls.where("status = 'succeeded'"), key, "reply"), calls.drop("reply")
