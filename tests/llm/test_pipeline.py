"""The pipeline stage by stage against the operators' own results, and as a whole."""

from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import decontaminate, mixing, quality, simhash
from tessera.llm.common import table


def test_stages(spark, sf_dir, tmp_path):
    docs = table(spark, sf_dir, "documents")
    want = {
        "quality_classifier": lambda d: {r["doc_id"]: 1 for r in quality.quality_scores(d, table(spark, sf_dir, "labels")).where("predicted = 1").collect()},
        "simhash_near_dedup": lambda d: {r["doc_id"]: 1 for r in simhash.near_components(d).where("doc_id = component_id").collect()},
        "benchmark_decontamination": lambda d: {r["doc_id"]: 1 for r in decontaminate.contamination(d, table(spark, sf_dir, "benchmark")).where(F.size("hits") == 0).collect()},
        "source_mixing": lambda d: {r["doc_id"]: n for r in mixing.taken_words(d).collect() if r["size"] and (n := int(r["taken"] / r["size"] + 0.5))},
    }
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        got = spark.read.parquet(str(tmp_path / name))
        counts = {r["doc_id"]: r["count"] for r in got.groupBy("doc_id").count().collect()}
        assert counts == want[name](docs) and counts, name
        docs = got
    last = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    whole = corpus_pipeline.run(spark, sf_dir)
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(last) == rows(whole) and whole.count() == docs.count()


def test_empty(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf_dir).count() == 0


def test_stages_by_brute_force(spark, sf_dir):
    """Every stage against a plain version over Python lists, chained as the pipeline chains them."""
    import math
    import re

    import numpy as np
    import tokenizers
    import zlib

    from test_decontaminate import plain as plain_hits
    from test_mixing import plain_mix, plain_targets
    from test_simhash import brute_components, plain_fingerprint

    from tessera.llm import tokens

    docs = table(spark, sf_dir, "documents")
    benchmark = [(r["item_id"], r["text"]) for r in table(spark, sf_dir, "benchmark").collect()]
    rows = [(r["doc_id"], r["text"], r["source"]) for r in docs.collect()]

    # quality: the fitted model's formula, text by text
    m = quality.learn(quality.featured(docs), quality.fit_labels(table(spark, sf_dir, "labels")))
    logit = lambda t: sum(w * max(-8, min(8, (x - a) / s)) for x, w, a, s in zip(quality.features(t), m["w"], m["mean"], m["std"])) - m["cut"]
    rows = [r for r in rows if 1 / (1 + math.exp(max(-50, min(50, -logit(r[1]) / m["scale"])))) >= 0.5]
    out = corpus_pipeline.STAGES[0][1](spark, docs, sf_dir).checkpoint()
    assert sorted(r["doc_id"] for r in out.collect()) == sorted(r[0] for r in rows)

    # near copies: all pairs of fingerprints
    rows.sort()
    heads = brute_components([plain_fingerprint(r[1]) for r in rows])
    rows = [r for i, r in enumerate(rows) if heads[i] == i]
    out = corpus_pipeline.STAGES[1][1](spark, out, sf_dir).checkpoint()
    assert sorted(r["doc_id"] for r in out.collect()) == [r[0] for r in rows]

    # benchmark passages: every window at every place
    rows = [r for r in rows if not plain_hits(r[1], benchmark)[1]]
    out = corpus_pipeline.STAGES[2][1](spark, out, sf_dir).checkpoint()
    assert sorted(r["doc_id"] for r in out.collect()) == [r[0] for r in rows]

    # the mix: slot by slot, word by word
    sizes = mixing.sized(out).collect()
    total: dict = {}
    for r in sizes:
        total[r["source"]] = total.get(r["source"], 0) + r["size"]
        assert r["size"] == len(re.findall(r"[^\x20\x09-\x0D]+", next(x[1] for x in rows if x[0] == r["doc_id"]) or ""))
    took, _ = plain_mix(sizes, [{"source": s, "target": t} for s, t in plain_targets(total).items()], mixing.BLOCK_WORDS, mixing.GOLDEN)
    copies = {r["doc_id"]: int(took.get(r["rid"], 0) / r["size"] + 0.5) for r in sizes if r["size"]}
    rows = [r for r in rows for _ in range(copies.get(r[0], 0))]
    out = corpus_pipeline.STAGES[3][1](spark, out, sf_dir).checkpoint()
    assert sorted(r["doc_id"] for r in out.collect()) == [r[0] for r in rows]

    # token ids: the library, whole text by whole text
    library, start, want = tokenizers.Tokenizer.from_file(tokens.default_path()), 0, []
    for i, text, _ in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids + [1]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    got = corpus_pipeline.STAGES[4][1](spark, out, sf_dir)
    assert sorted(map(tuple, got.select("doc_id", "start", "n_tokens", "ids_crc32").collect())) == want


def test_rows_that_stages_meet(spark, sf_dir):
    """Nulls in every column, empty and repeated rows, and clashing columns pass through all stages."""
    docs = table(spark, sf_dir, "documents")
    some = docs.limit(40).union(docs.limit(3)).withColumn("score", F.when(F.col("doc_id") >= 0, "x")).withColumn("fp", F.lit("y")).withColumn("taken", F.lit(1))
    bare = spark.createDataFrame([(None, None, None, None, None, None, "y", 1), (None, "plain words go here and there.", None, None, None, "x", "y", 1), (10**9, "", "en", None, 0, "x", "y", 1), (10**9 + 1, None, None, "web", None, "x", "y", 1)], some.schema)
    out = some.union(bare)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = out
        out = stage(spark, before, sf_dir).checkpoint()
        assert out.columns == before.columns, name
        known = {r["doc_id"] for r in before.collect()}
        assert {r["doc_id"] for r in out.collect()} <= known
    last = corpus_pipeline.STAGES[-1][1](spark, out, sf_dir)
    assert last.count() == out.count() > 0
