"""Large clusters by rounds and blocks: the sequential fold, the first pairs of all, and name pairs by their seldom characters."""

import random
from difflib import SequenceMatcher

import numpy as np
from pyspark.sql import functions as F

from tessera.operators import entities as E
from tessera.operators import topics as K

SCHEMA = "cluster_id string, vec_id long, embedding array<double>"


def clusters(seed, n=240):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(30, 6))
    rows = [(["big", "big", "big", "small"][i % 4], int(j), (centres[rng.integers(30)] + 0.3 * rng.normal(size=6)).tolist()) for i, j in enumerate(rng.permutation(n))]
    return rows + [(None, 1000 + i, [1.0, 0.0, 0.0, 0.0, 0.0, float(i)]) for i in range(3)] + [("one", 7, [0.0] * 6)]


def plain_leaders(rows, threshold):
    out = []
    for c in {r[0] for r in rows}:
        led = []
        for _, i, v in sorted((r for r in rows if r[0] == c), key=lambda r: r[1]):
            x = np.array(v) / (np.linalg.norm(v) or 1)
            near = next((j for j, y in led if round(float(x @ y), 9) >= threshold), None)
            if near is None:
                led.append((i, x))
            out.append((c, i, i if near is None else near))
    return sorted(out, key=repr)


def test_leaders_by_rounds(spark):
    rows = clusters(1)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    for most, threshold in ((9, 0.72), (64, 0.9), (4096, 0.72)):
        got = K.leader_clusters(df, "cluster_id", threshold, most)
        assert sorted(map(tuple, got.select("cluster_id", "vec_id", "leader").collect()), key=repr) == plain_leaders(rows, threshold), most


def test_first_pairs(spark):
    rows = clusters(2)
    df = spark.createDataFrame(rows, SCHEMA)
    want, pairs = [], 0
    for c in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == c), key=lambda r: r[1])
        kept = {"consensus": 0, "disagreement": 0}
        for i, (_, a, x) in enumerate(own):
            for _, b, y in own[i + 1 :]:
                pairs += 1
                s = round(float(np.dot(x, y) / ((np.linalg.norm(x) or 1) * (np.linalg.norm(y) or 1))), 4) + 0.0
                kind = "consensus" if s >= K.CONSENSUS else "disagreement" if s <= K.DISAGREEMENT else None
                if kind and kept[kind] < 12:
                    kept[kind] += 1
                    want.append((c, kind, a, b, s, kept[kind]))
    for first in (1, 4, 1000):
        seen = {}
        got = K.consensus(df, "cluster_id", 12, first, seen).select("cluster_id", "kind", "a", "b", "similarity", "place").collect()
        assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
        if first == 4:
            assert seen["pairs"] < pairs / 3, (seen, pairs)


def test_vectors_are_dealt_a_few_times_only(spark, monkeypatch):
    """However large a cluster is, a vector goes to few tasks; cut into many small strips it has the same pairs."""
    rows = [("big", i, [float(i % 7), 1.0]) for i in range(6000)] + [(None, 9999, [1.0, 1.0])]
    df = spark.createDataFrame(rows, SCHEMA)
    cells = K.cells_of(df, df, "cluster_id")
    assert cells.count() <= (K.PIECES + 1) * len(rows)
    assert cells.where("_side = 0").select("vec_id").distinct().count() == cells.where("_side = 1").select("vec_id").distinct().count() == 6001
    few = spark.createDataFrame(clusters(5), SCHEMA)
    found = lambda: [sorted(map(tuple, x.collect()), key=repr) for x in (K.pairwise(few, "cluster_id", F.col("vec_id") % 5 == 0), K.consensus(few, "cluster_id", 12, 8), K.leader_clusters(few, "cluster_id", 0.8, 20))]
    want = found()
    for name, value in (("STRIP_BYTES", 1000), ("BLOCK", 16), ("TILE", 64), ("BROADCAST_KEYS", 0), ("MOST_ROWS", 8)):
        monkeypatch.setattr(K, name, value)
    assert found() == want and all(want)


def test_smallest(spark):
    df = spark.createDataFrame([("a", x) for x in (5, 3, 9, 1, 7)] + [("b", 4), (None, 2)], "k string, v long").repartition(3)
    assert {(r["k"], r["cut"]) for r in K.smallest(df, "k", "v", 3).collect()} == {("a", 5), ("b", 4), (None, 2)}
    assert K.smallest(df.where("false"), "k", "v", 3).count() == 0


def test_names_by_seldom_characters(spark):
    rng = random.Random(3)
    make = lambda: "".join(rng.choice("abcdeinorst" if rng.random() < 0.8 else "qzxjk9_-") for _ in range(rng.randint(4, 12)))
    titles = {v: [make().title() for _ in range(12)] for v in ("s", "t")}
    texts = {v: [make() for _ in range(150)] + [t[:-1] + "x" for t in titles[v]] + ["aaaa", "aaaab"] for v in ("s", "t")}
    a = spark.createDataFrame([(v, t) for v, ts in titles.items() for t in ts], "video_id string, title string")
    b = spark.createDataFrame([(v, t) for v, ts in texts.items() for t in ts] + [("s", None)], "video_id string, text string")
    import re

    name = re.compile(E.LATIN_NAME)
    want, all_pairs = set(), 0
    for v in titles:
        said = {n for t in texts[v] for n in name.findall(t) if len(n) >= 4}
        for c in {n for t in titles[v] for n in name.findall(t) if len(n) >= 4 and not n.isupper()}:
            for n in said:
                all_pairs += 1
                r = SequenceMatcher(None, c.lower(), n.lower()).ratio()
                if r >= 0.55 and c.lower() != n.lower():
                    want.add((v, c, n, round(r, 6)))
    assert {tuple(r) for r in E.infer_aliases(a, b).collect()} == want and want
    tried = E.alias_candidates(a, b).count()
    assert len(want) <= tried < 0.9 * all_pairs, (tried, all_pairs)
    high = {w for w in want if w[3] >= 0.8}
    assert {tuple(r) for r in E.infer_aliases(a, b, 0.8).collect()} == high
    assert E.alias_candidates(a, b, 0.8).count() < 0.4 * all_pairs
    assert E.infer_aliases(a.where(F.lit(False)), b).count() == 0


def plain_normalize(text, entities):
    """Alias by alias over the whole list."""
    import re

    found = []
    for canonical, aliases, confidence in entities:
        if confidence < E.APPLY or text is None:
            continue
        for alias in sorted({a for a in aliases if a.strip() and a.casefold() != canonical.casefold()}, key=lambda a: (-len(a), a)):
            latin = re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9 _.-]*", alias)
            text, n = re.subn((r"(?<![A-Za-z0-9])" + re.escape(alias) + r"(?![A-Za-z0-9])") if latin else re.escape(alias), lambda _: canonical, text, flags=re.I)  # noqa: B023
            if n:
                found.append((alias, canonical, confidence))
    return text, found


def test_names_by_source(spark, monkeypatch):
    monkeypatch.setattr(E, "LIST_ROWS", 4)
    lists = {
        "s": [("Workbuddy", ["WalkBody", "work buddy", "walk"], 0.96), ("Walk Inc", ["Workbuddy", "workbuddy inc"], 0.9), ("Never", ["text"], 0.5)],
        "t": [("学习", ["学系", "xue"], 0.9), ("İstanbul", ["istambul", "ſtan"], 0.95), ("A$1\\2", ["a b"], 0.99)],
        None: [("Null", ["none"], 1.0)],
    }
    texts = ["walkbody and WALK, work buddy", "no text here", None, "", "学系 xue Xuex ISTAMBUL İSTAMBUL stan", "a b A B ab", "none NONE nones", "walkbodyx walkbody-walk"] * 3
    rows = [(v, i, t, "kept") for i, t in enumerate(texts) for v in ("s", "t", "u", None)]
    df = spark.createDataFrame(rows, "video_id string, doc_id int, text string, raw_ string").repartition(3)
    entities = spark.createDataFrame([(v, i, c, a, p) for v, es in lists.items() for i, (c, a, p) in enumerate(es)], "video_id string, pos int, canonical string, aliases array<string>, confidence double")
    got = E.normalize_by_source(df, entities).collect()
    assert len(got) == len(rows) and any(r["applied"] for r in got)
    want = {(v, i): (t, *plain_normalize(t, lists.get(v, []))) for v, i, t, _ in rows}
    for r in got:
        raw, text, found = want[r["video_id"], r["doc_id"]]
        assert (r["raw"], r["text"], r["applied"], [tuple(x) for x in r["replacements"]], r["raw_"]) == (raw, text, text != raw, found, "kept"), r
    assert E.normalize_by_source(df.where(F.lit(False)), entities).count() == 0 and E.normalize_by_source(df, entities.where(F.lit(False))).where("applied").count() == 0


def test_seeded_sample(spark):
    from tessera.operators.metrics import seeded_sample

    ids = [f"case-{i * 7919 % 1009}é" for i in range(500)]
    df = spark.createDataFrame([(x,) for x in [*ids, None]], "id string").repartition(6)
    for n, seed in ((20, 42), (500, 1), (900, 3)):
        got = [r["id"] for r in seeded_sample(df, "id", n, seed).orderBy("place").collect()]
        assert got == random.Random(seed).sample(sorted(ids), min(n, len(ids)))
    assert seeded_sample(df.where(F.lit(False)), "id", 5, 1).count() == 0


def test_seeded_query(spark, sf_dir):
    from tessera.plans.catalog import QUERIES

    ids = sorted(str(r["doc_id"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id").collect())
    assert [r["case_id"] for r in QUERIES["j_seeded_sample"](spark, sf_dir).orderBy("place").collect()] == random.Random(42).sample(ids, 20)


def test_kmeans_sends_no_task_for_each_centre(spark):
    """Distances between all centres, one task a centre, are what a row-by-row fit sends to the driver in every iteration."""
    rng = np.random.default_rng(6)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.normal(size=(240, 320)))], "vec_id long, embedding array<double>").repartition(3)
    context = spark.sparkContext
    context.setJobGroup("kmeans", "kmeans")
    try:
        assert K.kmeans_clusters(df, 60).select("cluster").distinct().count() <= 60
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    tracker = context.statusTracker()
    stages = {s for j in tracker.getJobIdsForGroup("kmeans") for s in tracker.getJobInfo(j).stageIds}
    tasks = [i.numTasks for i in map(tracker.getStageInfo, stages) if i]
    assert tasks and max(tasks) < 60, sorted(tasks)[-3:]
