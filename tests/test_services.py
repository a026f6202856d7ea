"""Services behind callers: retries, cooldowns, failures as rows, and what their replies become."""

import pytest

from tessera.sources import providers as M
from tests.fake_provider import memory, recogniser


def test_attempts():
    waits = []

    def service(answers):
        left = list(answers)

        def call(_):
            a = left.pop(0)
            if isinstance(a, Exception):
                raise a
            return a

        return lambda: M.attempted(call, "x", sleep=waits.append)

    assert service(["ok"])() == ("ok", "succeeded", None, 1) and waits == []
    assert service([M.ServiceError(503), TimeoutError("slow"), "ok"])() == ("ok", "succeeded", None, 3) and waits == [1.5, 3.0]
    waits.clear()
    assert service([M.ServiceError(429, "slow down"), "ok"])() == ("ok", "succeeded", None, 2) and waits == [30.0]
    assert service([M.ServiceError(400, "bad\nmore")])() == (None, "failed", "status 400: bad", 1)
    assert service([RuntimeError("Read timed out")] * 3)()[1:] == ("failed", "Read timed out", 3)
    assert service([M.Unavailable("no speech recognition provider is configured")])()[1] == "missing_provider"
    assert service([ValueError()])()[2] == "ValueError"


def test_transcripts(spark):
    media = spark.createDataFrame([(1, "a.wav"), (2, "bad.wav"), (3, "text.wav"), (4, None)], "video_id long, path string")
    items, calls = M.transcribed(media, recogniser, wait_s=0.0)
    assert sorted(map(tuple, items.collect())) == [(1, 0, 0.0, 2.5, "from a.wav"), (3, 0, 0.0, 0.0, "all of it")]
    assert {r["video_id"]: (r["status"], r["attempts"]) for r in calls.collect()} == {1: ("succeeded", 1), 2: ("failed", 1), 3: ("succeeded", 1), 4: ("skipped", 0)}
    none, missing = M.transcribed(media, M.Providers().transcribe)
    assert none.count() == 0 and {r["status"] for r in missing.collect()} == {"missing_provider", "skipped"}
    assert M.transcribed(media.where("false"), recogniser)[0].count() == 0


@pytest.mark.parametrize("attempts", [1, 2])
def test_memory(spark, attempts):
    asked = spark.createDataFrame([("q1", "joins"), ("q2", "down")], "question_id string, question string")
    rows, calls = M.recalled(asked, memory, attempts=attempts, wait_s=0.0)
    assert sorted(map(tuple, rows.collect())) == [("q1", 0, "about joins"), ("q1", 1, "more")]
    assert {r["question_id"]: (r["status"], r["error"], r["attempts"]) for r in calls.collect()} == {"q1": ("succeeded", None, 1), "q2": ("failed", "connection refused", attempts)}
