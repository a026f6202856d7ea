"""Folds of one long source: the same rows from many tasks as from a plain loop over all of it."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import fold
from tessera.operators import frames as V
from tessera.operators import segment as S
from tessera.operators.fold import split_at_resets


@pytest.fixture(params=[1, 7, 40, "short"])
def shuffled(spark, request, monkeypatch):
    """Shuffles into a number of partitions that adaptive execution does not merge, with every source a long one; or with none."""
    if request.param == "short":
        yield 1
        return
    monkeypatch.setattr(fold, "FOLD_ROWS", 0)
    old = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", request.param)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield request.param
    spark.conf.set("spark.sql.shuffle.partitions", old[0])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old[1])


def plain_segments(items, shortest, longest, chars, gap):
    out, state, key = [], None, object()
    for v, o, s, e, text in items:
        marked = any(m.lower() in text.lower() for m in S.TOPIC_MARKERS)
        if v != key:
            key, state = v, [-1, 0.0, 0, 0.0]
        lasts, n = e - state[1], len(text)
        if state[0] < 0 or lasts >= longest or lasts >= shortest and marked or state[2] + n > chars or gap is not None and s - state[3] > gap:
            state[:3] = [state[0] + 1, s, n]
        else:
            state[2] += 1 + n
        state[3] = e
        out.append((v, o, state[0]))
    return sorted(out, key=repr)


def items_of(n, seed):
    rng, at, rows = random.Random(seed), 0.0, []
    marker = S.TOPIC_MARKERS[0]
    for o in range(n):
        at += rng.choice([0.1, 0.5, 0.5, 3.0, 6.0])
        lasts = rng.choice([1.0, 4.0, 20.0, 130.0 if rng.random() < 0.05 else 2.0])
        rows.append((o, at, at + lasts, rng.choice(["word", "many words " * rng.randint(1, 30), f"{marker} opens", "x" * rng.choice([1, 900, 2500]) if rng.random() < 0.1 else "y"]).strip()))
        at += lasts * rng.choice([1, 1, 0.2])
    return rows


def test_segments_of_one_long_source(spark, shuffled):
    rows = [("long", *r) for r in items_of(600, 1)] + [("s", *r) for r in items_of(3, 2)] + [(None, *r) for r in items_of(40, 3)] + [("z", *r) for r in items_of(60, 4)]
    items = spark.createDataFrame(rows, "video_id string, item_ord long, start_s double, end_s double, text string").repartition(5)
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1]))
    for chars, gap in ((S.MAX_CHARS, None), (S.MERGE_CHARS, 4.0), (40, None)):
        got = S._fold(items, "video_id", ["item_ord"], 60.0, 120.0, chars, gap).select("video_id", "item_ord", "segment").collect()
        assert sorted(map(tuple, got), key=repr) == plain_segments(ordered, 60.0, 120.0, chars, gap)


def test_a_source_is_dealt_over_tasks(spark, shuffled):
    rows = [("one", *r) for r in items_of(800, 5)]
    items = spark.createDataFrame(rows, "video_id string, item_ord long, start_s double, end_s double, text string")
    parts = S.dealt_by_range(items, "video_id", ["item_ord"]).groupBy("_part").count().collect()
    assert len(parts) >= 0.8 * shuffled and max(r["count"] for r in parts) <= 3 * 800 / shuffled + 20


def test_exits_follow_every_opening():
    rng = random.Random(9)
    for _ in range(50):
        rule = S._Rule(5.0, 9.0, 30, rng.choice([None, 2.0]))
        items, at = [], 0.0
        for _ in range(rng.randint(1, 40)):
            at += rng.choice([0.0, 1.0, 3.0])
            items.append((at, at + rng.choice([0.5, 2.0]), rng.randint(1, 20), rng.random() < 0.2))
        head = rule.head(items)
        for i, found in enumerate(rule.exits(items, head)):
            state = None
            for item in items[i:]:
                state = rule.take(state, item)
            assert found == state
        # whatever came in has ended within the head, if items follow it
        if head < len(items):
            state = (0, items[0][0], 0, items[0][0])
            assert any(rule.breaks(state, x) or not (state := rule.take(state, x)) for x in items[:head])


def test_frames_of_one_long_source(spark, shuffled):
    rng, t, rows = random.Random(6), 0, []
    for i in range(900):
        t += rng.choice([100, 400, 700, 1500, 1600, 4000])
        rows.append((["one", "one", "one", "two", None][0 if i < 700 else i % 5], i, t, f"{rng.choice([0, 1, 3, 7, 255, 1 << 40, (1 << 63) + 5]):016x}"))
    frames = spark.createDataFrame(rows, "video_id string, frame_id long, ts_ms long, phash string").repartition(6)
    want = []
    for v in {r[0] for r in rows}:
        kept = []
        for r in (r for r in rows if r[0] == v):
            if not any(r[2] - k[2] <= 1500 and (int(r[3], 16) ^ int(k[3], 16)).bit_count() <= 3 for k in kept):
                kept.append(r)
        want += kept
    assert sorted(map(tuple, V.dedupe_frames(frames).collect()), key=repr) == sorted(want, key=repr)
    runs = split_at_resets(frames, "video_id", ["ts_ms", "frame_id"], "ts_ms", "ts_ms", 1500)
    found = sorted((tuple(r) for r in runs.select("video_id", "ts_ms", "_run").collect()), key=lambda r: (r[0] is not None, r[0] or "", r[1]))
    changes = [a[2] != b[2] for a, b in zip(found, found[1:])]
    assert changes == [a[0] != b[0] or b[1] - a[1] > 1500 for a, b in zip(found, found[1:])] and len({r[2] for r in found}) == sum(changes) + 1
    assert split_at_resets(frames.where("false"), "video_id", ["ts_ms"], "ts_ms", "ts_ms", 1500).count() == 0
