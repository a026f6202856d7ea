"""Fill-in-middle: runs against plain slicing, the contract against a plain version, and texts rebuilt from the output."""

import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.llm import fim

TEXTS = st.text(alphabet=st.one_of(st.sampled_from("ab é日😀<PSM>\n"), st.characters(codec="utf-8")), max_size=60)


def plain(doc_id, text):
    """The contract by slices of a Python string."""
    text = text or ""
    n = len(text)
    s = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(s[8 * i : 8 * i + 8], 16) for i in range(4)]
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = text[:a], text[a:b], text[b:]
    return (n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < 20 else (n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}")


@settings(max_examples=200, deadline=None)
@given(TEXTS)
def test_runs(text):
    data = text.encode()
    runs = fim.Runs(data)
    assert runs.n == len(text) and [runs.offset(c) for c in range(len(text) + 1)] == [len(text[:c].encode()) for c in range(len(text) + 1)]
    widths = [len(c.encode()) for c in text]
    changes = sum(a != b for a, b in zip(widths, widths[1:]))
    assert not text or len(runs.starts) == changes + 1  # maximal runs


def test_runs_over_blocks(monkeypatch):
    monkeypatch.setattr(fim, "BLOCK", 5)  # blocks end inside characters and inside runs
    text = "aaaaaaa日本語日本語éééabc😀😀z" * 3
    runs = fim.Runs(text.encode())
    assert runs.n == len(text) and [runs.offset(c) for c in range(len(text) + 1)] == [len(text[:c].encode()) for c in range(len(text) + 1)]
    assert len(runs.starts) == 16  # z and a follow each other in one run


@settings(max_examples=200, deadline=None)
@given(st.one_of(st.none(), st.integers(-5, 1 << 60)), TEXTS)
def test_any_text(doc_id, text):
    *got, output = fim.transform(doc_id, text.encode())
    assert (*got, output.decode()) == plain(doc_id, text)


def test_whole_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("output", F.lit("x")).withColumnRenamed("lang", "form")
    got = {r["doc_id"]: r for r in fim.fill_in_middle(docs).withColumn("again", fim.restored()).collect()}
    rows = docs.collect()
    assert len(got) == len(rows)
    for r in rows:
        mine = got[r["doc_id"]]
        assert (mine["n"], mine["form"], mine["prefix_chars"], mine["middle_chars"], mine["output"]) == plain(r["doc_id"], r["text"])
        assert mine["again"] == (r["text"] or "")
    assert {r["form"] for r in got.values()} == {"plain", "psm", "spm"}


def test_edge_rows(spark):
    long = "日x" * 700_000
    rows = [(None, "abc"), (1, None), (2, ""), (3, "a<M>b"), (4, "é😀"), (4, "é😀"), (5, long), (6, "ends <"), (7, "P> starts"), (8, "<"), (9, ">S>")]
    rows += [(i, "<<>>P>S>M") for i in range(10, 60)]
    got = fim.fill_in_middle(spark.createDataFrame(rows, "doc_id long, text string")).withColumn("again", fim.restored()).collect()
    want = sorted(((i, *plain(i, t), t or "") for i, t in rows), key=repr)
    assert sorted((tuple(r) for r in got), key=repr) == want
    assert fim.fill_in_middle(spark.createDataFrame([], "doc_id long, text string")).count() == 0
