"""The ranking classifier: held-out accuracy, and edge rows."""

from tessera.llm import quality as Q


def test_held_out_accuracy(spark, sf_dir):
    sf = sf_dir.replace("sf0.001", "sf0.01")
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = Q.quality_scores(docs, labels).join(labels, "doc_id").toPandas()
    held = got[got.held_out]
    assert len(held) > 80 and (held.predicted == held.quality).mean() >= 0.97
    assert got.score.between(0, 1).all()
    good, bad = held[held.quality == 1].score, held[held.quality == 0].score
    assert sum((g > bad).sum() for g in good) / (len(good) * len(bad)) >= 0.99
    kept = Q.keep_good(docs, labels)
    assert kept.columns == docs.columns
    want = {r["doc_id"] for r in Q.quality_scores(docs, labels).where("predicted = 1").collect()}
    assert {r["doc_id"] for r in kept.collect()} == want


def test_edge_rows(spark):
    rows = [(i, t, "s") for i, t in enumerate([None, "", " ", "word", "A!! B!! C!!", "plain words go here.", "x " * 30000])] + [(3, "word", "s"), (None, "word", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    some = spark.createDataFrame([(3, 1), (3, 0), (4, 0), (5, 1), (6, None), (None, 1), (99, 7)], "doc_id long, quality int")
    for labels in (some, some.where("quality = 1"), some.where("false")):
        got = Q.quality_scores(docs, labels).collect()
        assert len(got) == len(rows) and all(r["score"] is not None and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)
        assert Q.keep_good(docs, labels).columns == docs.columns
        assert {r["score"] for r in got if r["doc_id"] in (3, None)}.__len__() == 1
    assert Q.quality_scores(docs.where("false"), some).count() == 0


def test_pairwise_weights_by_plain_descent():
    """The fitted weights minimise the Bradley-Terry loss that a plain loop over pairs computes."""
    import math
    import random

    import numpy as np

    rng = np.random.default_rng(3)
    diff = rng.normal(size=(400, 3)) + np.array([0.6, -0.3, 0.0])
    w = Q._logistic(diff)

    def loss(v):
        return sum(math.log1p(math.exp(-sum(a * b for a, b in zip(v, d)))) for d in diff.tolist()) / len(diff) + Q.RIDGE / 2 * sum(a * a for a in v)

    best, step = [0.0] * 3, 0.5
    random.seed(1)
    while step > 1e-4:  # coordinate descent
        moved = False
        for i in range(3):
            for way in (step, -step):
                other = best[:]
                other[i] += way
                if loss(other) < loss(best):
                    best, moved = other, True
        step = step if moved else step / 2
    assert np.allclose(w, best, atol=2e-3) and loss(w.tolist()) <= loss(best) + 1e-9


def test_scores_by_hand(spark, sf_dir):
    """The column expression gives what the model's formula gives, and the cut leaves as many fit rows below as have label 0."""
    import math

    sf = sf_dir.replace("sf0.001", "sf0.01")
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    own = Q.fit_labels(labels)
    m = Q.learn(Q.featured(docs), own)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}

    def plain(text):
        raw = sum(w * max(-8, min(8, (x - a) / s)) for x, w, a, s in zip(Q.features(text), m["w"], m["mean"], m["std"])) - m["cut"]
        return 1 / (1 + math.exp(max(-50, min(50, -raw / m["scale"]))))

    got = {r["doc_id"]: r["score"] for r in Q.quality_scores(docs, labels).collect()}
    assert all(abs(plain(t) - got[i]) < 1e-9 for i, t in texts.items())
    fit = own.collect()
    low, bad = sum(got[r["doc_id"]] < 0.5 for r in fit), sum(r["y"] == 0 for r in fit)
    assert abs(low - bad) <= max(1, len(fit) // 100)


def test_bounded_fit(spark, sf_dir, monkeypatch):
    sf = sf_dir.replace("sf0.001", "sf0.01")
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    monkeypatch.setattr(Q, "FIT_ROWS", 120)
    assert 70 < Q.fit_labels(labels).count() < 180
    got = Q.quality_scores(docs, labels)
    held = got.join(labels, "doc_id").where("held_out").toPandas()
    assert (held.predicted == held.quality).mean() >= 0.95
    assert {r["doc_id"] for r in Q.keep_good(docs, labels).collect()} == {r["doc_id"] for r in got.where("predicted = 1").collect()}
