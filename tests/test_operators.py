"""Literal expectations of single operators."""

import pytest
from pyspark.sql import functions as F

from tessera.functions import routing, text, timeparse
from tessera.operators import contract, frames, intervals, memory, metrics, retrieve, segment, story, topics


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_tokens_of_cjk_have_bigrams(spark):
    found = one(spark, text.tokenize(F.lit("证据绑定")))
    assert {"证据", "绑定"} <= set(found)
    assert "学习" in one(spark, text.tokenize(F.lit("学a习")))


def test_bm25_finds_identifier(spark):
    docs = spark.createDataFrame([("v", 0, "speech", "set API_BASE_URL before you start"), ("v", 1, "speech", "click the Save button"), ("v", 2, "frame_caption", "a Save button is shown")], "video_id string, doc_id long, evidence_type string, text string")
    q = spark.createDataFrame([(1, "API_BASE_URL")], "query_id long, text string")
    top = retrieve.bm25(docs, q).collect()
    assert [(r["doc_id"], r["score"]) for r in top] == [(0, 1.0)]
    saved = retrieve.bm25(docs, spark.createDataFrame([(1, "Save button")], "query_id long, text string"), types=["frame_caption"]).collect()
    assert [r["doc_id"] for r in saved] == [2]


def test_bm25_of_nothing(spark):
    docs = spark.createDataFrame([], "video_id string, doc_id long, evidence_type string, text string")
    assert retrieve.bm25(docs, spark.createDataFrame([(1, "a")], "query_id long, text string")).count() == 0


def test_rank_fusion_prefers_items_of_both_lists(spark):
    make = lambda ids: spark.createDataFrame([(1, i, r + 1) for r, i in enumerate(ids)], "q long, item long, rank long")
    found = retrieve.reciprocal_rank_fusion([(make([0, 1]), 1.0), (make([1, 2]), 1.0)], ["q"], "item", 3).orderBy("rank").collect()
    assert [r["item"] for r in found] == [1, 0, 2] and found[0]["score"] == 1.0 and all(0 <= r["score"] <= 1 for r in found)


def test_mmr(spark):
    rows = spark.createDataFrame([(1, 0, 0.95, [1.0, 0.0]), (1, 1, 0.94, [0.99, 0.01]), (1, 2, 0.75, [0.0, 1.0])], "q long, item long, relevance double, embedding array<double>")
    assert [r["item"] for r in retrieve.mmr(rows, "q", 2, 0.8).orderBy("place").collect()] == [0, 2]
    typed = spark.createDataFrame([(1, 0, 1.0, [1.0, 0.0], "frame_caption"), (1, 1, 0.9, [1.0, 0.0], "speech")], "q long, item long, relevance double, embedding array<double>, evidence_type string")
    assert [r["item"] for r in retrieve.mmr(typed, "q", 1, 0.55, True).collect()] == [1]


def test_multimodal_mmr_has_all_vectors(spark, sf_dir):
    import numpy as np

    from tessera.operators.retrieve import MMR_WEIGHTS
    from tessera.plans.catalog import QUERIES

    groups = {}
    for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").orderBy("vec_id").collect():
        v = np.array(r["embedding"], float)
        groups.setdefault(r["label"], []).append((r["vec_id"], 1.0 - (r["vec_id"] % 17) / 20.0, v / (np.linalg.norm(v) or 1), ("speech", "frame_caption", "frame")[r["vec_id"] % 3]))
    want = set()
    for label, rows in groups.items():
        chosen = []
        while len(chosen) < min(3, len(rows)):
            def gain(r):
                weighed = r[1] * MMR_WEIGHTS.get(r[3], 1.0)
                return round(weighed + (0.08 if weighed >= 0.05 and r[3] not in {c[3] for c in chosen} else 0) - 0.55 * max([0.0, *(float(r[2] @ c[2]) for c in chosen)]), 9)

            chosen.append(max((r for r in rows if r[1] >= 0.05 and all(r is not c for c in chosen)), key=lambda r: (gain(r), -r[0])))
            want.add((label, chosen[-1][0], len(chosen)))
    assert {tuple(r) for r in QUERIES["g_mmr_multimodal"](spark, sf_dir).select("cluster_id", "item", "place").collect()} == want


def test_overlap_coefficient(spark):
    of = lambda a, b: one(spark, contract.overlap_coefficient(F.array(*map(F.lit, a)), F.array(*map(F.lit, b)) if b else F.array().cast("array<string>")))
    assert of("abc", "bcd") == pytest.approx(2 / 3) and of("abc", "") == 0


def test_merge_segments_by_gap(spark):
    make = lambda rows: spark.createDataFrame([(1, i, float(a), float(b), "words here") for i, (a, b) in enumerate(rows)], "video_id long, item_ord long, start_s double, end_s double, text string")
    assert segment.merge_segments(make([(0, 8), (8.5, 18), (18.5, 30)])).count() == 1
    assert segment.merge_segments(make([(0, 5), (12, 18)])).count() == 2


def test_segment_splits_at_markers_and_length(spark):
    rows = [(1, 0, 0.0, 65.0, "start"), (1, 1, 65.0, 70.0, "However, this"), (1, 2, 70.0, 200.0, "long")]
    got = segment.segment_transcript(spark.createDataFrame(rows, "video_id long, item_ord long, start_s double, end_s double, text string")).orderBy("segment").collect()
    assert [r["text"] for r in got] == ["start", "However, this", "long"]


def test_dedupe_frames(spark):
    rows = [(1, 1, 0, "00000000000000ff"), (1, 2, 1000, "00000000000000ff"), (1, 3, 2000, "ffff000000000000")]
    assert [r["frame_id"] for r in frames.dedupe_frames(spark.createDataFrame(rows, "video_id long, frame_id long, ts_ms long, phash string")).orderBy("frame_id").collect()] == [1, 3]


def test_hamming_of_high_bits(spark):
    assert one(spark, frames.hamming(F.lit("ffffffffffffffff"), F.lit("0000000000000000"))) == 64
    assert one(spark, frames.hamming(F.lit("ff"), F.lit("f"))) == 999


def test_time_grammar(spark):
    assert one(spark, timeparse.time_anchors(F.lit("十分钟"))) == [600.0]
    assert one(spark, timeparse.point_times(F.lit("01:20 说了什么"))) == [80.0]
    assert one(spark, timeparse.point_times(F.lit("A. red: one\nB. blue: two"))) == []
    assert one(spark, timeparse.time_anchors(F.lit("结尾"), F.lit(300.0))) == [240.0]


def test_coverage_ranges_and_bins(spark):
    v = spark.createDataFrame([(1, 180.0)], "video_id long, duration double")
    got = intervals.coverage_ranges(v, "video_id", "duration").orderBy("part").collect()
    assert [(r["start_s"], r["end_s"]) for r in got] == [(0, 60), (60, 120), (120, 180)]
    extents = spark.createDataFrame([(1, 0.0, 180.0), (2, 0.0, 180.0)], "video_id long, lo double, hi double")
    seen = spark.createDataFrame([(1, 80.0), (2, 60.0)], "video_id long, at double")
    assert {r["video_id"]: r["covered"] for r in intervals.coverage_bins(seen, extents, "video_id", "at").collect()} == {1: 1, 2: 2}


def test_interval_join_meets_brute_force(spark):
    import random

    rng = random.Random(3)
    rows = lambda n: [(rng.randrange(3), i, s := rng.randrange(400), s + rng.randrange(120)) for i in range(n)]
    a, b = rows(60), rows(60)
    left, right = spark.createDataFrame(a, "k long, i long, s long, e long"), spark.createDataFrame(b, "k long, j long, s2 long, e2 long")
    got = {(r["i"], r["j"]) for r in intervals.interval_join(left, right, ("s", "e"), ("s2", "e2"), ["k"], 50, 7).collect()}
    assert got == {(x[1], y[1]) for x in a for y in b if x[0] == y[0] and x[2] - 7 <= y[3] and y[2] <= x[3] + 7}


def test_merge_ranges_keeps_reasons(spark):
    rows = spark.createDataFrame([(1, 0.0, 10.0, "a", 2), (1, 11.0, 20.0, "b", 1), (1, 30.0, 40.0, "c", 3)], "k long, s double, e double, why string, p long")
    got = intervals.merge_ranges(rows, "k", "s", "e", 2, "why", "p").orderBy("s").collect()
    assert [(r["s"], r["e"], r["reasons"], r["priority"]) for r in got] == [(0, 20, "a;b", 1), (30, 40, "c", 3)]


def test_node_split_and_gaps(spark):
    segments = spark.createDataFrame([(1, i, 100.0 * i, 100.0 * i + 90) for i in range(6)], "video_id long, segment_id long, start_s double, end_s double")
    nodes = spark.createDataFrame([(1, 0, "a", 0), (1, 0, "a", 1), (1, 1, "b", 1), (1, 1, "b", 2), (1, 1, "b", 3)], "video_id long, node_order long, node_id string, segment_id long")
    got = {r["node_id"]: (r["time_start"], r["time_end"], r["n"]) for r in story.split_nodes(nodes, segments).collect()}
    assert got == {"a": (0.0, 190.0, 2), "b": (200.0, 390.0, 2)}
    gaps = story.coverage_gaps(segments, nodes).collect()
    assert [(r["first_segment"], r["n"]) for r in gaps] == [(4, 2)]


def test_decay_prefers_the_new(spark):
    rows = spark.createDataFrame([(30.0,), (0.0,)], "age double")
    got = rows.select("age", memory.decay_weight(F.lit(1.0), F.col("age"), F.lit(1), F.lit(1.0), 1.0).alias("w")).orderBy(F.desc("w")).collect()
    assert [r["age"] for r in got] == [0.0, 30.0]


def test_metrics(spark):
    cases = spark.createDataFrame([(1,), (2,)], "c long")
    p = spark.createDataFrame([(1, "a"), (1, "b")], "c long, i string")
    got = {r["c"]: (r["precision"], r["recall"], r["f1"]) for r in metrics.prf1(cases, p, spark.createDataFrame([(1, "a")], "c long, i string"), "c", "i").collect()}
    assert got[1] == (0.5, 1.0, pytest.approx(2 / 3)) and got[2] == (1.0, 1.0, 1.0)
    assert one(spark, metrics.temporal_iou(F.lit(0.0), F.lit(10.0), F.lit(20.0), F.lit(30.0))) == 0


def test_aliases(spark):
    assert one(spark, text.replace_alias(F.lit("use WalkBody or walkbodyX"), "WalkBody", "Workbuddy")) == "use Workbuddy or walkbodyX"


def test_routes(spark):
    assert one(spark, routing.route_question(F.lit("这个视频使用了什么软件")))["mode"] == "fast"
    assert one(spark, routing.route_question(F.lit("为什么")))["mode"] == "full"


def test_subtitles(spark, tmp_path):
    from tessera.sources import subtitles

    (tmp_path / "a.vtt").write_text("WEBVTT\n\n00:01.000 --> 00:02.500 align:start\n<b>Hello</b>  there\n\nNOTE x\n")
    (tmp_path / "b.srt").write_text("1\n00:00:01,000 --> 00:00:02,000\nHi\n")
    (tmp_path / "c.json3").write_text('{"events":[{"tStartMs":1000,"dDurationMs":500,"segs":[{"utf8":"a"},{"utf8":" b"}]},{"tStartMs":5}]}')
    got = sorted((r["start"], r["end"], r["text"]) for r in subtitles.parse_subtitles(subtitles.read_files(spark, str(tmp_path))).collect())
    assert got == [(1.0, 1.5, "a b"), (1.0, 2.0, "Hi"), (1.0, 2.5, "Hello there")]


def test_leader_clusters(spark):
    rows = spark.createDataFrame([(1, 1, [1.0, 0.0]), (1, 2, [0.99, 0.1]), (1, 3, [0.0, 1.0])], "c long, vec_id long, embedding array<double>")
    assert {r["vec_id"]: r["leader"] for r in topics.leader_clusters(rows, "c").collect()} == {1: 1, 2: 1, 3: 3}


def test_streams(spark, sf_dir, tmp_path):
    from tessera.streaming import live

    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    stream = lambda: spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    n = spark.read.parquet(f"{sf_dir}/events.parquet").count()
    staged = stream().select(F.col("user_id").alias("video_id"), F.col("event_type").alias("stage"), F.col("event_type").alias("status"), "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("ts_us"))
    counts = live.run_to_end(live.stage_counts(staged), "t_counts", "complete", str(tmp_path / "a"))
    assert counts.agg(F.sum("n")).first()[0] == n
    state = live.run_to_end(live.stage_machine(staged), "t_state", "update", str(tmp_path / "b"))
    assert state.groupBy("video_id", "stage").agg(F.max("n_events").alias("n")).agg(F.sum("n")).first()[0] == n
    live.two_stage(stream(), str(tmp_path / "sink"), str(tmp_path / "c")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "sink")).count() == n


def test_sinks_and_media(spark, tmp_path):
    from tessera.sources import adapters

    rows = spark.createDataFrame([(1, "a"), (2, "b")], "video_id long, text string")
    path = str(tmp_path / "out")
    adapters.write_partitioned(rows, path)
    adapters.write_partitioned(spark.createDataFrame([(2, "c")], "video_id long, text string"), path)
    assert sorted((r["video_id"], r["text"]) for r in spark.read.parquet(path).collect()) == [(1, "a"), (2, "c")]
    (tmp_path / "m").mkdir()
    (tmp_path / "m/x.mp4").write_bytes(b"abc")
    assert adapters.read_media(spark, str(tmp_path / "m")).first()["video_id"] == "local_a9993e364706"
    (tmp_path / "m/x.json").write_text('{"video_id": "v", "title": "t"}')
    assert adapters.read_artifacts(spark, str(tmp_path / "m/x.json"), "video_id string, title string, author string").first()["title"] == "t"


def test_budget_fill_skips_what_does_not_fit(spark):
    rows = spark.createDataFrame([(1, 1, 9.0, 60, "a", "x"), (1, 2, 8.0, 70, "a", "y"), (1, 3, 7.0, 30, "a", "x"), (1, 4, 6.0, 30, "b", "z"), (1, 5, 5.0, 5, "b", "w")], "key long, id long, score double, size long, source string, claim string")
    assert memory.budget_fill(rows, "key", 100, 3, 1).first()["picked"] == [1, 4]
    assert memory.budget_fill(rows, "key", 100, 3).first()["picked"] == [1, 4, 5]


def test_url_rules(spark):
    from tessera.sources import adapters

    safe = lambda u: one(spark, adapters.url_safe(F.lit(u)))
    assert safe("https://www.example.com/x") and not safe("http://localhost/") and not safe("http://10.0.0.1/") and not safe("http://u:p@example.com/") and not safe("file:///etc")
    assert one(spark, adapters.url_video_id(F.lit("https://v.example/watch?v=abc123_X&t=1"))) == "abc123_X"


def test_restarts_are_bounded():
    from tessera.operators.state import run_with_restarts

    seen, waits, tries = [], [], iter([ValueError("429 slow down"), OSError("broken pipe\nmore"), "done"])

    def job():
        x = next(tries)
        if isinstance(x, Exception):
            raise x
        return x

    assert run_with_restarts(job, lambda n, e: seen.append((n, str(e))), sleep=waits.append) == "done"
    assert [n for n, _ in seen] == [1, 2] and waits == [30.0, 3.0]
    with pytest.raises(RuntimeError, match="gave up after 1 restarts: always"):
        run_with_restarts(lambda: (_ for _ in ()).throw(ValueError("always\nand more")), lambda n, e: None, limit=1, sleep=lambda s: None)


def test_confident_aliases_only(spark):
    from tessera.operators.entities import normalize_entities

    rows = spark.createDataFrame([(1, "打开 WalkBody，然后点击按钮"), (2, None), (3, "walkbodyish workbuddy")], "segment_id long, text string")
    got = {r["segment_id"]: r for r in normalize_entities(rows, [("Workbuddy", ["WalkBody", "workBUDDY"], 0.96)]).collect()}
    assert got[1]["text"] == "打开 Workbuddy，然后点击按钮" and got[1]["raw"] == "打开 WalkBody，然后点击按钮" and got[1]["applied"]
    assert [(x["raw"], x["canonical"]) for x in got[1]["replacements"]] == [("WalkBody", "Workbuddy")]
    assert got[2]["text"] is None and not got[2]["applied"] and got[3]["text"] == "walkbodyish workbuddy" and got[3]["replacements"] == []
    assert normalize_entities(rows, [("Workbuddy", ["WalkBody"], 0.6)]).where("applied").count() == 0


def test_decay_by_type(spark):
    """Constants of the kinds of memory, by hand."""
    import math

    rows = spark.createDataFrame([("speech", 0.015), ("frame_caption", 0.012), ("user_preference", 0.00375), ("model_summary", 0.009), ("user_verified", 0.00225), ("derived_insight", 0.0075), ("other", 0.015)], "memory_type string, alpha double")
    got = rows.select("alpha", memory.decay_weight(F.lit(0.9), F.lit(30.0), F.lit(3), F.lit(2.0), memory.alpha_of(F.col("memory_type"))).alias("w")).collect()
    for r in got:
        assert r["w"] == pytest.approx(0.9 * math.exp(-r["alpha"] * 30) * (1 + 0.25 * math.log(4)) * 2)


def test_related_rooms_by_brute_force(spark):
    import random

    rng = random.Random(7)
    own = {v: rng.sample("abcde", rng.randint(1, 4)) for v in range(40)}
    rows = [(v, t, i) for v, ts in own.items() for i, t in enumerate(ts)]
    want = set()
    for v, ts in own.items():
        best = {}
        for o, others in own.items():
            if o != v and (n := len(set(ts) & set(others))):
                best[others[0]] = max(best.get(others[0], 0), n)
        want |= {(v, room, n, i + 1) for i, (room, n) in enumerate(sorted(best.items(), key=lambda x: (-x[1], x[0]))[:2])}
    got = memory.related_rooms(spark.createDataFrame(rows, "video_id long, topic string, pos int")).select("video_id", "room", "overlap", "place").collect()
    assert {tuple(r) for r in got} == want


def test_frames_of_a_question_by_a_plain_loop(spark, monkeypatch):
    """Best captions of each question, in one block of questions and in many; rows that share an id count as one."""
    import random

    from tessera.operators import frames as V

    rng = random.Random(2)
    text = lambda n: " ".join(rng.choice("red green Blue car tree 12 3.5 api_v2 x-y".split()) for _ in range(rng.randrange(n)))
    frames = [(i, text(12)) for i in range(700)] + [(5, "red car 12"), (6, None), (None, "red green blue car tree"), (None, "x-y 12 3.5 api_v2")]
    asked = [(f"q{i}", text(6)) for i in range(20)] + [("q1", "red Tree zebra"), (None, "car"), ("none", None), ("far", "zebra")]
    said, want = {}, []
    for i, t in frames:
        said.setdefault(i, set()).update((t or "").lower().split())
    terms = {}
    for q, t in asked:
        terms.setdefault(q, set()).update((t or "").lower().split())
    for q, own in terms.items():
        hits = sorted((-len(own & words), i is not None, i or 0) for i, words in said.items() if own & words)
        want += [(q, i if known else None, -h, k + 1) for k, (h, known, i) in enumerate(hits[:3])]
    a, b = spark.createDataFrame(asked, "question_id string, question string"), spark.createDataFrame(frames, "frame_id long, caption string").repartition(3)
    for block in (4096, 7):
        monkeypatch.setattr(V, "QUESTION_BLOCK", block)
        got = V.term_overlap_rank(a, b)
        assert sorted(map(tuple, got.select("question_id", "frame_id", "hits", "rank").collect()), key=repr) == sorted(want, key=repr)
    assert V.term_overlap_rank(a.where("false"), b).count() == V.term_overlap_rank(a, b.where("false")).count() == 0
