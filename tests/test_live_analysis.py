"""Two-stage analysis against one batch run, across kills and replays; admission against a plain loop, with a live timer."""

import random
import time

import pytest
from pyspark.sql import functions as F

from tessera.operators import segment as S
from tessera.sources import fixtures as X
from tessera.streaming import analysis as A
from tessera.streaming import admission as M

SCHEMA = A.ITEM.format(kind="string")


def rows_of(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


COLUMNS = ("video_id", "segment", "start_s", "end_s", "n_items", "text")


def landed(spark, sf_dir, folder):
    items = X.items(spark, sf_dir).withColumn("start_s", F.col("start_ms") / 1000).withColumn("end_s", F.col("end_ms") / 1000)
    items = items.select("video_id", F.col("item_ord").cast("long").alias("item_ord"), "start_s", "end_s", "text")
    A.land(items, f"{folder}/landing", 5)
    return items, dict(items.dtypes)["video_id"]


def stream(spark, folder, kind):
    return spark.readStream.schema(A.ITEM.format(kind=kind)).option("maxFilesPerTrigger", 1).parquet(f"{folder}/landing")


def test_kill_and_restart(spark, sf_dir, tmp_path, monkeypatch):
    folder = str(tmp_path)
    items, kind = landed(spark, sf_dir, folder)
    first = items.agg(F.min("item_ord")).first()[0]
    want = rows_of(S.segment_transcript(items), *COLUMNS)
    A.ingest(stream(spark, folder, kind), folder, f"{folder}/c1").awaitTermination()
    store, calls = A._store, []

    def dies(rows, where, number):
        calls.append(where)
        if len(calls) in (4, 9):
            raise OSError("killed")
        store(rows, where, number)

    monkeypatch.setattr(A, "_store", dies)
    for _ in range(2):  # killed between the segments and the snapshots of a batch, and before the segments of another
        with pytest.raises(Exception, match="killed"):
            A.run_analysis(spark, folder, f"{folder}/c2", kind, 1, first=first).awaitTermination()
    A.run_analysis(spark, folder, f"{folder}/c2", kind, 1, first=first).awaitTermination()
    monkeypatch.setattr(A, "_store", store)
    assert rows_of(A.segments(spark, folder), *COLUMNS) == want
    found = A.snapshots(spark, folder)
    assert {r["status"] for r in found.collect()} == {"succeeded"} and found.agg(F.sum("waiting")).first()[0] == 0
    assert {(r["video_id"], r["n_segments"]) for r in found.collect()} == {(v, sum(w[0] == v for w in want)) for v in {w[0] for w in want}}
    # an ingest batch that is written again brings the same items once more: nothing changes
    rows = spark.read.parquet(f"{folder}/items").where("batch = 0").drop("batch").collect()
    store(spark.createDataFrame(rows, A.ITEM.format(kind=kind)), f"{folder}/items", 0)
    A.run_analysis(spark, folder, f"{folder}/c2", kind, 1, first=first).awaitTermination()
    assert rows_of(A.segments(spark, folder), *COLUMNS) == want
    whole = A.batch_state(A.snapshots(spark, folder)).first()
    assert whole["completed"] == whole["total"] and whole["failed"] == 0


def test_orders_gaps_failures_and_blanks(spark, tmp_path):
    folder = str(tmp_path)
    rows = [("a", i, 30.0 * i, 30.0 * i + 29, f"text {i}", i == 9) for i in range(10)]
    rows += [("gap", 0, 0.0, 5.0, "one", False), ("gap", 2, 10.0, 15.0, "three", True), ("bad", 0, 0.0, 5.0, "x", False), ("bad", 1, 9.0, 7.0, "y", False), ("bad", 2, 9.0, 10.0, "z", True)]
    rows += [("blank", 0, 0.0, 1.0, None, False), ("blank", 1, 1.0, 2.0, "  ", False), ("blank", 2, 2.0, 3.0, "word", True), ("a", None, 1.0, 2.0, "no place", False)]
    random.Random(1).shuffle(rows)
    rows += rows[:6]
    for i, part in enumerate((rows[:7], rows[7:15], rows[15:])):
        A._store(spark.createDataFrame(part, SCHEMA), f"{folder}/items", i)
    A.run_analysis(spark, folder, f"{folder}/c", "string", 1).awaitTermination()
    got = {r["video_id"]: r for r in A.snapshots(spark, folder).collect()}
    assert [got[v]["status"] for v in ("a", "gap", "bad", "blank")] == ["succeeded", "running", "failed", "succeeded"]
    assert got["gap"]["waiting"] == 1 and got["gap"]["next_ord"] == 1 and "item 1" in got["bad"]["error"]
    items = spark.createDataFrame([r for r in rows[:-6] if r[0] in ("a", "blank") and r[1] is not None], SCHEMA)
    assert [r for r in rows_of(A.segments(spark, folder), *COLUMNS) if r[0] in ("a", "blank")] == rows_of(S.segment_transcript(items), *COLUMNS)


def test_a_source_is_told_in_few_rows(spark, tmp_path, monkeypatch):
    """The stateful step gives a source's segments and snapshot in a row of two columns, or in more of them if there are many; texts and times stay as they are."""
    monkeypatch.setattr(A, "TOLD", 2)
    texts = ['a "quote"', "back\\slash", "é 学习 \U0001f600", "tab\tand\nline", "x" * 1700, "{}[]", "\x01 low", "end"]
    rows = [(v, i, 50.1 * i, 50.1 * i + 49.7, t, i == len(texts) - 1) for v in ("a", "b") for i, t in enumerate(texts)]
    items = spark.createDataFrame(rows, SCHEMA)
    A._store(items, f"{tmp_path}/items", 0)
    A.run_analysis(spark, str(tmp_path), f"{tmp_path}/c", "string", 1).awaitTermination()
    want = rows_of(S.segment_transcript(items), *COLUMNS)
    assert rows_of(A.segments(spark, str(tmp_path)), *COLUMNS) == want and len(want) > 2 * A.TOLD
    assert rows_of(A.snapshots(spark, str(tmp_path)), "video_id", "n_segments", "next_ord", "waiting", "status", "error") == [(v, sum(w[0] == v for w in want), len(texts), 0, "succeeded", None) for v in ("a", "b")]
    stream = spark.readStream.schema(SCHEMA + ", batch int").parquet(f"{tmp_path}/items")
    step = next(x for x in A.analyse(stream)._jdf.queryExecution().analyzed().toString().splitlines() if "FlatMapGroupsInPandasWithState" in x)
    assert "told#" in step and "segment#" not in step and "n_segments#" not in step


EVENTS = "server string, task_id string, kind string, at_ms long"


def plain(events, limit, stall):
    """Decisions of one server by a plain loop over its events in order."""
    running, out = {}, []
    for at, kind, task in sorted(events, key=lambda e: (e[0], ["finish", "beat", "submit"].index(e[1]), e[2])):
        for t in sorted((t for t in running if at - running[t] >= stall), key=lambda t: (running[t], t)):
            out.append((t, at, "evicted"))
            running.pop(t)
        if kind == "submit" and task not in running:
            out.append((task, at, "admitted" if len(running) < limit else "refused"))
            if len(running) < limit:
                running[task] = at
        elif kind == "finish" and task in running:
            out.append((task, at, "finished"))
            running.pop(task)
        elif task in running:
            running[task] = max(at, running[task])
    return out


def test_admission_by_a_plain_loop(spark, tmp_path):
    rng = random.Random(4)
    events = {s: [(rng.randrange(400) * 100_000, rng.choice(["submit", "submit", "beat", "finish"]), f"t{rng.randrange(12)}") for _ in range(120)] for s in ("x", "y")}
    rows = [(s, t, k, a) for s, es in events.items() for a, k, t in es]
    rows.sort(key=lambda r: r[3])
    for i in range(4):  # batches in the order of time
        part = [r for r in rows if i * 10_000_000 <= r[3] < (i + 1) * 10_000_000]
        spark.createDataFrame(part + [("x", None, "beat", 5), ("x", "t1", "beat", None), ("x", "t1", "odd", 5)][: 3 * (i == 0)], EVENTS).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    source = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    out = []
    q = M.admission(source, 3, 6_000_000).writeStream.foreachBatch(lambda df, n: out.extend(map(tuple, df.collect()))).outputMode("append").option("checkpointLocation", f"{tmp_path}/c").trigger(processingTime="100 milliseconds").start()
    n, until = sum(len(plain(es, 3, 6_000_000)) for es in events.values()), time.time() + 60
    while len(out) < n and time.time() < until:  # timers keep a run to the end of what is available going
        time.sleep(0.2)
    q.stop()
    for s in ("x", "y"):
        assert sorted(r[1:] for r in out if r[0] == s) == sorted(plain(events[s], 3, 6_000_000))
    assert {r[3] for r in out} == {"admitted", "refused", "finished", "evicted"}


def test_a_stalled_task_loses_its_slot_by_a_timer(spark, tmp_path):
    def put(i, *rows):
        spark.createDataFrame([("s", *r) for r in rows], EVENTS).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")

    put(0, ("a", "submit", 0), ("b", "submit", 1))
    source = spark.readStream.schema(EVENTS).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    out = []
    q = M.admission(source, 1, 1500).writeStream.foreachBatch(lambda df, n: out.extend((r["task_id"], r["decision"]) for r in df.collect())).outputMode("append").option("checkpointLocation", f"{tmp_path}/c").trigger(processingTime="200 milliseconds").start()
    try:
        until = time.time() + 60
        while ("a", "evicted") not in out and time.time() < until:
            time.sleep(0.2)
        assert out[:3] == [("a", "admitted"), ("b", "refused"), ("a", "evicted")]
        put(1, ("c", "submit", 2))
        while ("c", "admitted") not in out and time.time() < until + 30:
            time.sleep(0.2)
        assert ("c", "admitted") in out
    finally:
        q.stop()
