"""A workspace over runs: only what has changed is processed again, and captions that were asked for stay."""

import os

import pytest
from pyspark.sql import functions as F

from tessera.engine import Engine
from tessera.sources.locks import Locks, lock_of
from tessera.sources.providers import Providers
from tessera.workspace import Workspace

ITEMS = "video_id string, item_ord long, start_s double, end_s double, text string"


def files(folder, kind):
    return {os.path.join(d, f) for d, _, fs in os.walk(f"{folder}/{kind}") for f in fs if f.endswith(".parquet")}


@pytest.fixture()
def workspace(spark, tmp_path):
    ws = Workspace(spark, str(tmp_path), Engine(spark, Providers(caption=lambda path: f"the red buttons of picture {path}")))
    rows = [(f"v{v}", i, 40.0 * i, 40.0 * i + 30, f"source {v} says thing {i} about joins") for v in range(6) for i in range(4)]
    ws.write("items", spark.createDataFrame(rows, ITEMS))
    return ws


def test_only_changed_sources_are_processed(spark, workspace, tmp_path):
    assert workspace.process() == [f"v{v}" for v in range(6)] and workspace.process() == []
    before = {kind: files(tmp_path, kind) for kind in ("segments", "evidence", "storyline", "summary")}
    changed = spark.createDataFrame([("v2", 0, 0.0, 30.0, "zebras and nought besides"), ("new", 0, 0.0, 9.0, "a new source")], ITEMS)
    workspace.write("items", changed)
    assert workspace.process() == ["new", "v2"]
    for kind, old in before.items():
        touched = {f.split("video_id=")[1].split("/")[0] for f in old ^ files(tmp_path, kind)}
        assert touched == {"v2", "new"}, kind
    q = spark.createDataFrame([(1, "zebras"), (2, "thing 3")], "question_id long, question string")
    found = {(r["query_id"], r["video_id"]) for r in workspace.find(q).collect()}
    assert (1, "v2") in found and (2, "v1") in found and (2, "v2") not in found
    assert len(workspace.process(force=True)) == 7


def test_a_run_that_died_is_made_up_for(workspace, monkeypatch):
    write = Workspace.write
    monkeypatch.setattr(Workspace, "write", lambda self, kind, rows: (_ for _ in ()).throw(OSError("gone")) if kind == "summary" else write(self, kind, rows))
    with pytest.raises(OSError):
        workspace.process()
    monkeypatch.setattr(Workspace, "write", write)
    assert len(workspace.process()) == 6 and workspace.read("summary").count() == 6


def test_captions_are_added_once(spark, workspace):
    workspace.process()
    frames = spark.createDataFrame([("v1", i, i * 10.0, f"{i}.jpg") for i in range(12)], "video_id string, frame_id long, ts_s double, path string")
    q = spark.createDataFrame([(1, "buttons 按钮 at 00:40 about joins")], "question_id long, question string")
    before = workspace.read("evidence").count()
    added = workspace.refine_frames(q, frames).count()
    assert added > 0 and workspace.read("evidence").count() == before + added
    assert workspace.find(q, 5, ["frame_caption"]).count() > 0
    assert workspace.refine_frames(q, frames).count() == added and workspace.read("evidence").count() == before + added
    assert workspace.process() == [] and workspace.read("evidence").where("evidence_type = 'frame_caption'").count() == added
    assert workspace.refine_frames(q, frames.where(F.lit(False))).count() == 0


def test_another_runs_sources_are_left_to_it(spark, workspace, tmp_path):
    items = workspace.read("items")
    locked = items.where("video_id = 'v3'").select(lock_of("video_id").alias("n")).first()["n"]
    other = Locks(spark, str(tmp_path))
    assert other.take([locked, locked]) == {locked} and Locks(spark, str(tmp_path)).take([locked]) == set()
    theirs = {r["video_id"] for r in items.select("video_id", lock_of("video_id").alias("n")).distinct().collect() if r["n"] == locked}
    assert set(workspace.process()) == {f"v{v}" for v in range(6)} - theirs
    other.release()
    assert set(workspace.process()) == theirs and not [f for f in os.listdir(f"{tmp_path}/_locks") if f[0].isdigit()]


def test_a_dead_owners_lock_is_taken_over_once(spark, tmp_path):
    dead, one, two = (Locks(spark, str(tmp_path), stale_s=s) for s in (900.0, 900.0, 0.5))
    assert dead.take([1, 2]) == {1, 2} and one.take([1]) == set()
    import time

    time.sleep(1.2)
    dead.held = {2}
    dead.beat()  # the second lock's owner lives
    assert two.take([1, 2]) == {1} and one.take([1]) == set()
    with pytest.raises(KeyError), one.holding([7]) as held:
        assert held == {7}
        raise KeyError
    assert dead.take([7]) == {7}
