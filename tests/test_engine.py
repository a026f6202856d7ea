"""The end-to-end jobs, SQL functions and providers."""

import pytest
from pyspark.sql import functions as F

from tessera.engine import Engine
from tessera.functions.sql import register
from tessera.operators import memory
from tessera.sources import fixtures as X
from tessera.sources.providers import HashingEmbedder, Providers, Unavailable, captions, embed


def test_answers(spark, sf_dir):
    engine = Engine(spark)
    items = X.items(spark, sf_dir).withColumn("start_s", F.col("start_ms") / 1000).withColumn("end_s", F.col("end_ms") / 1000)
    segments = engine.segments(items)
    evidence = engine.evidence(segments)
    word = segments.select(F.regexp_extract("text", "([A-Za-z]{6,})", 1).alias("w")).where("w <> ''").first()["w"]
    q = spark.createDataFrame([(1, word), (2, "qqqq zzzz")], "question_id long, question string")
    assert engine.answer(evidence, q).count() > 0
    rows = engine.answer(evidence, q, "bm25").collect()
    assert any(r["query_id"] == 1 and r["cited"] for r in rows)
    assert [r["answer"] for r in rows if r["query_id"] == 2] == ["insufficient evidence"]
    assert engine.storyline(segments).count() == segments.count()
    assert engine.summary(segments).count() == segments.select("video_id").distinct().count()
    assert engine.route(q).select("route.mode").first()["mode"] == "full"


def test_sql_functions(spark):
    assert len(register(spark)) == 9
    rows = spark.range(-2, 40).selectExpr("id / 10D AS s", "id * 1.5D AS age", "cast(id AS double) AS n", "id / 20D AS imp", "0.01D AS a")
    own = memory.decay_weight(F.col("s"), F.col("age"), F.col("n"), F.col("imp"), F.col("a"))
    assert rows.select((F.expr("ev_decay(s, age, n, imp, a)") - own).alias("d")).where("abs(d) > 1e-12").count() == 0
    row = spark.sql("SELECT ev_base_tokens('Foo_1 证据') AS t, ev_format_timestamp(3725.9D) AS f, ev_temporal_iou(0D, 10D, 5D, 20D) AS i, ev_confidence(0.3D) AS c, ev_overlap(array('a','b'), array('b')) AS o, ev_hamming('ff', '00') AS h").first()
    assert row["t"] == ["foo_1", "证", "据"] and row["f"] == "[01:02:05]" and row["i"] == 0.25 and row["c"] == "medium" and row["o"] == 1.0 and row["h"] == 8


def test_providers(spark):
    rows = spark.createDataFrame([(1, "a b"), (2, None)], "id long, text string")
    got = {r["id"]: r["embedding"] for r in embed(rows, HashingEmbedder(), "id").collect()}
    assert sum(x * x for x in got[1]) == pytest.approx(1) and not any(got[2])
    with pytest.raises(Unavailable):
        Providers().transcribe("x")
    frames = spark.createDataFrame([(1, "a.jpg")], "frame_id long, path string")
    assert captions(frames, None).first()["status"] == "missing_model"
    assert captions(frames, lambda p: 1 / 0).first()["status"] == "failed"


def test_ask_looks_again(spark, sf_dir):
    """A question about pictures gets captions of frames where it points; others keep their first answer."""
    items = spark.createDataFrame([(1, 0, 0.0, 30.0, "we talk about joins"), (1, 1, 36.0, 90.0, "and then about buttons"), (2, 0, 0.0, 40.0, "cooking rice")], "video_id long, item_ord long, start_s double, end_s double, text string")
    frames = spark.createDataFrame([(1, i, i * 10.0, f"{i}.jpg") for i in range(10)], "video_id long, frame_id long, ts_s double, path string")
    engine = Engine(spark, Providers(caption=lambda path: f"the red buttons of picture {path}"))
    evidence = engine.evidence(engine.segments(items))
    q = spark.createDataFrame([(1, "buttons 按钮 at 00:40"), (2, "about joins"), (3, "zzzz")], "question_id long, question string")
    rows = {(r["query_id"], r["video_id"]): r for r in engine.ask(evidence, q, frames, "bm25").collect()}
    assert rows[1, 1]["refined"] and ":frame_caption" in rows[1, 1]["cited"] and "missing_visual_evidence" in rows[1, 1]["reasons"]
    assert not rows[2, 1]["refined"] and rows[3, None]["answer"] == "insufficient evidence" and not rows[3, None]["refined"]
    plain = {(r["query_id"], r["video_id"]): r for r in engine.ask(evidence, q, None, "bm25").collect()}
    assert plain.keys() == rows.keys() and not any(r["refined"] for r in plain.values())


def test_commands(spark, tmp_path, capsys):
    from tessera.__main__ import COMMANDS, main

    (tmp_path / "talk.srt").write_text("1\n00:00:01,000 --> 00:00:20,000\nSpark joins are fast\n\n2\n00:00:30,000 --> 00:00:50,000\nHowever, skew hurts\n")
    (tmp_path / "cook.en.vtt").write_text("WEBVTT\n\n00:01.000 --> 00:09.000\nRice needs water\n")
    (tmp_path / "cases.jsonl").write_text('{"id": "c1", "question": "Spark joins", "answer": "joins", "evidence_ids": ["talk:seg_0000:speech"]}\n')
    frames = str(tmp_path / "frames")
    spark.createDataFrame([("talk", 1, 2.0, "x.jpg")], "video_id string, frame_id long, ts_s double, path string").write.parquet(frames)
    ws = ["--workspace", str(tmp_path / "ws")]
    run = lambda *a: main([*a, *ws], spark)
    run("ingest", str(tmp_path / "*.*"))
    run("process")
    for c in ("summarize", "rebuild-index", "remember"):
        run(c)
    run("ask", "--question", "Spark joins", "--out", str(tmp_path / "answers"))
    answers = spark.read.parquet(str(tmp_path / "answers")).collect()
    assert [r["video_id"] for r in answers if "joins" in r["answer"]] == ["talk"]
    run("chat", "--question", "Spark joins", "--frames", frames)
    run("refine-frames", "--question", "Spark joins", "--frames", frames)
    run("quality-gate", str(tmp_path / "cases.jsonl"), "--out", str(tmp_path / "gate"))
    gate = {r["metric"]: r["mean"] for r in spark.read.parquet(str(tmp_path / "gate")).collect()}
    assert gate["retrieval_hit_rate"] == 1.0 and gate["segment_recall"] == 1.0 and gate["answer_contains_recall"] == 1.0
    for c in (["eval", str(tmp_path / "cases.jsonl")], ["export"], ["audit"], ["show-config"], ["memory-status"], ["memory-search", "--question", "joins"], ["query"]):
        run(*c)
    assert "Spark joins are fast" in capsys.readouterr().out and len(COMMANDS) >= 14
