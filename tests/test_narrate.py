"""Storylines and summaries by a model: citations checked, failures by rule, order kept."""

from tessera.engine import Engine
from tessera.operators import narrate as M
from tessera.operators.story import fallback_storyline
from tessera.sources.providers import Providers
from tests.fake_provider import model

SCHEMA = "video_id string, segment long, segment_id string, start_s double, end_s double, text string"


def segments(spark, **texts):
    rows = [(v, i, f"seg_{i:04d}", 10.0 * i, 10.0 * i + 9, t) for v, ts in texts.items() for i, t in enumerate(ts)]
    return spark.createDataFrame(rows, SCHEMA)


def test_storyline(spark):
    rows = segments(spark, a=["one", "two", "three"], b=["x", "please explode", "y"], c=["silence"])
    got = M.story_nodes(rows, model, size=2)
    a = [tuple(r)[1:] for r in got.where("video_id = 'a'").orderBy("node_id").collect()]
    assert a[0] == ("node_0000", 0.0, 9.0, "t", "first", ["seg_0000"], 0.9, 0.1, "supported")
    assert a[1] == ("node_0001", 3.0, 19.0, None, "unsure", ["seg_0001"], 1.0, 0.0, "needs_review")
    assert a[2] == ("node_0002", 0.0, 0.0, None, "nothing behind it", [], 0.3, 0.7, "unsupported")
    assert a[3] == ("node_0003", 0.0, 19.0, None, "weak", ["seg_0000", "seg_0001"], 0.2, 0.8, "weakly_supported")
    assert len(a) == 8 and a[4][5] == ["seg_0002"]
    b = got.where("video_id = 'b'").orderBy("node_id").collect()
    assert [(r["node_id"], r["claim"], r["segment_ids"]) for r in b[:2]] == [("node_0000", "x", ["seg_0000"]), ("node_0001", "please explode", ["seg_0001"])] and b[0]["status"] == "weakly_supported" and len(b) == 6
    assert [r["claim"] for r in got.where("video_id = 'c'").collect()] == ["silence"]
    assert M.story_nodes(rows.where("false"), model).count() == 0


def test_summaries(spark):
    rows = segments(spark, a=["one", "two", "three"], b=["x", "please explode"], c=["one"], d=["silence", "no whole", "z"])
    got = {r["video_id"]: r for r in M.summaries(rows, model, size=2).collect()}
    assert (got["a"]["n_chunks"], got["a"]["n_by_rule"], got["a"]["summary"]) == (2, 0, "whole of 2")
    assert [tuple(c) for c in got["a"]["claims"]] == [("cited", ["seg_0000"], "high"), ("not cited", [], "low"), ("cited", ["seg_0002"], "high"), ("not cited", [], "low")]
    assert (got["b"]["n_by_rule"], got["b"]["summary"], got["b"]["claims"]) == (1, "x please explode", [])
    assert (got["c"]["n_chunks"], got["c"]["summary"]) == (1, "about seg_0000")
    assert got["d"]["n_by_rule"] == 1 and got["d"]["summary"].startswith("silence")
    assert M.summaries(rows.where("false"), model).count() == 0


def test_the_engine_uses_its_provider(spark):
    rows = segments(spark, a=["one", "two"])
    told = Engine(spark, Providers(chat=model))
    assert told.storyline(rows).where("claim = 'first'").count() == 1 and told.summary(rows).first()["summary"] == "about seg_0000"
    plain = Engine(spark)
    assert sorted(map(tuple, plain.storyline(rows).collect())) == sorted(map(tuple, fallback_storyline(rows).collect())) and plain.summary(rows).count() == 1
