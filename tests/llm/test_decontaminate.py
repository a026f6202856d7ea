"""Benchmark decontamination against a plain scan."""

import hashlib
import re

import oracle
import pytest
from pyspark.sql import functions as F

from tessera.llm import decontaminate as D
from tessera.llm.queries import ORACLES, op2_benchmark_decontamination


def words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def plain(text, items):
    own, hit, met = words(text), set(), set()
    for item, body in items:
        need = words(body)
        for w in {tuple(need[i : i + 10]) for i in range(max(1, len(need) - 9))} if need else ():
            for i in range(len(own) - len(w) + 1):
                if tuple(own[i : i + len(w)]) == w:
                    hit |= set(range(i, i + len(w)))
                    met |= {str(item)} if item is not None else set()
    return len(own), hit, sorted(met)


ITEMS = [(1, "One two three four five six seven eight nine ten eleven twelve"), (2, "short item"), (10, "short item"), (3, None), (4, "..."), (None, "no id"), (5, "é Ü x1")]
DOCS = [
    (1, "zero ONE, two-three four five six seven eight nine ten; eleven twelve! End"), (2, "a short item b short short item"), (3, None), (4, ""), (5, "x" * 5000 + " nine ten"),
    (6, "é ü x1 É Ü x1 é Ü x1"), (7, "two three four five six seven eight nine ten eleven twelve thirteen"), (7, "a short item"), (None, "short item no id"),
]


@pytest.mark.parametrize("block", [10, 2_000_000])
def test_edge_rows(spark, block, monkeypatch):
    monkeypatch.setattr(D, "BLOCK_CHARS", block)
    docs = spark.createDataFrame([(i, t, [1]) for i, t in DOCS], "doc_id long, text string, hits array<int>")
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = D.contamination(docs, bench).select("*", D.hit_words().alias("n_hit")).collect()
    want = sorted((-1 if i is None else i, *(lambda n, h, m: (n, len(h), tuple(m)))(*plain(t, ITEMS))) for i, t in DOCS)
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_words"], r["n_hit"], tuple(r["items"])) for r in got) == want
    kept = D.clean(docs, bench)
    assert kept.columns == docs.columns
    assert sorted(-1 if r["doc_id"] is None else r["doc_id"] for r in kept.collect()) == sorted(w[0] for w in want if not w[2])
    for r in got:
        text = dict((i, t) for i, t in DOCS if i != 7).get(r["doc_id"])
        for h in r["hits"] if text else []:
            assert words(text.encode()[h["start"] : h["end"]].decode()) == words(text)[h["first"] : h["last"] + 1]
    assert D.contamination(docs, bench.where("false")).where(F.size("hits") > 0).count() == 0
    assert D.contamination(docs.where("false"), bench).count() == 0


@pytest.mark.parametrize("block", [10, 2_000_000])
def test_items_without_an_id_contaminate(spark, block, monkeypatch, tmp_path):
    monkeypatch.setattr(D, "BLOCK_CHARS", block)
    texts = [(1, "this has no id in it"), (2, "a short item here"), (3, "neither of them"), (4, "no id and short item"), (5, None)]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    found = op2_benchmark_decontamination(spark, str(tmp_path))
    got = {r["doc_id"]: (r["contaminated"], r["n_hit"], r["n_items"]) for r in found.collect()}
    assert got == {1: (True, 2, 0), 2: (True, 2, 2), 3: (False, 0, 0), 4: (True, 4, 2), 5: (False, 0, 0)}
    assert not (wrong := oracle.differences(found, oracle.connect(str(tmp_path)), ORACLES["op2_benchmark_decontamination"])), wrong
    read = lambda t: spark.read.parquet(f"{tmp_path}/{t}.parquet")
    assert sorted(r["doc_id"] for r in D.clean(read("documents"), read("benchmark")).collect()) == [3, 5]


def test_query(spark, sf_dir):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    got = {r["doc_id"]: r for r in op2_benchmark_decontamination(spark, sf_dir).collect()}
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect():
        n, hit, met = plain(r["text"], items)
        mine = got[r["doc_id"]]
        assert (mine["n_words"], mine["n_hit"], mine["n_items"], mine["contaminated"]) == (n, len(hit), len(met), bool(hit))
        assert mine["items_sha256"] == hashlib.sha256(",".join(met).encode()).hexdigest()
