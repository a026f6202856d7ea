"""Token output: the library's ids, an exact round trip, and pruned reads."""

import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import tokens as K
from tessera.llm.common import new_folder

tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(K.default_path())


@pytest.fixture(scope="module")
def encoder():
    return K.WordEncoder(K.default_path())


ODD = ["", None, "Hello, World! it's 1234 don't x'", "a<|endoftext|>b  <|startoftext|>", "日本語 テスト\tmix ΑΣ Σ. İstanbul ǅ é é", "a\x1cb \x85c d e", "½²³ ªº µ ÿŸ ß ẞ", "tabs\tnl\ncr\r\x0bvt\x0cff", "''s 'S 'LL x'll", "​﻿ ́x"]


def test_odd_texts(encoder, library):
    for t in ODD:
        assert encoder.text(t) == library.encode(t or "", add_special_tokens=False).ids + [1], repr(t)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("aAbc'sS \n\t.,!1é<|>"), st.characters(codec="utf-8")), max_size=40))
def test_any_text(text):
    library, encoder = tokenizers.Tokenizer.from_file(K.default_path()), K.WordEncoder(K.default_path())
    assert encoder.text(text) == library.encode(text, add_special_tokens=False).ids + [1]


def test_memory_is_emptied(monkeypatch, library):
    monkeypatch.setattr(K, "CACHE", 3)
    e = K.WordEncoder(K.default_path())
    for t in ("a b c d e", "f g h a", "a b"):
        assert e.text(t) == library.encode(t, add_special_tokens=False).ids + [1]


def test_other_files_go_through_the_library(tmp_path):
    """Another vocabulary, and one of the same suffix and vocabulary with another pre-tokenizer or normalizer."""
    import json

    import public_tokenizers

    said = json.loads(open(K.default_path()).read())
    upper = said | {"normalizer": {"type": "NFC"}}
    spaced = said | {"pre_tokenizer": {"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, said["pre_tokenizer"]["pretokenizers"][1]]}}
    paths = [public_tokenizers.path("byte_bpe_50k.json")]
    for i, other in enumerate((upper, spaced)):
        paths.append(str(tmp_path / f"{i}.json"))
        open(paths[-1], "w").write(json.dumps(other))
    for path in paths:
        library, e = tokenizers.Tokenizer.from_file(path), K.WordEncoder(path)
        assert not e.plain
        for t in (*ODD, "Don't STOP, it's 2024!", "two  spaces"):
            assert e.text(t) == library.encode(t or "", add_special_tokens=False).ids + [1], (path, t)


def test_a_sliced_array(encoder, library):
    import pyarrow as pa

    texts = ["x y", None, "it's", "", "  a\tb ", "é日 <|"]
    got = encoder.arrow(pa.array(["left out", *texts, "too"]).slice(1, len(texts))).to_pylist()
    assert got == [library.encode(t or "", add_special_tokens=False).ids + [1] for t in texts]
    assert encoder.arrow(pa.array([], pa.string())).to_pylist() == []


def test_round_trip(spark, sf_dir, library):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumnRenamed("lang", "ids")
    got = {r["doc_id"]: r for r in K.tokenized(docs).collect()}
    start = 0
    for r in sorted(docs.collect(), key=lambda r: r["doc_id"]):
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids + [1]
        mine = got[r["doc_id"]]
        assert (mine["start"], mine["n_tokens"], mine["ids_crc32"]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_edge_rows_and_pruned_reads(spark):
    rows = spark.createDataFrame([(5, "b c"), (1, None), (1, "a"), (None, "x"), (5, "b c"), (3, "")], "doc_id long, text string")
    folder = new_folder(spark, "t")
    K.write_tokens(rows, folder)
    got = sorted(((r["start"], r["doc_id"], r["n_tokens"]) for r in K.token_index(spark, folder).collect()))
    assert [g[1] for g in got] == [None, 1, 1, 3, 5, 5] and [g[0] for g in got] == [sum(x[2] for x in got[:i]) for i in range(6)]
    assert K.read_tokens(spark, folder, [3]).select("ids").collect()[0]["ids"] == [1]
    plan = K.read_tokens(spark, folder, [3])._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(doc_id" in plan or "PushedFilters: [EqualTo(doc_id" in plan or "doc_id" in plan.split("PushedFilters")[1][:80]
    empty = new_folder(spark, "t")
    K.write_tokens(rows.where("false"), empty)
    assert K.token_index(spark, empty).count() == 0


def test_a_very_long_text(encoder, library):
    text = "Words and 'tis 12 more, é日 <|x " * 60_000
    assert encoder.text(text) == library.encode(text, add_special_tokens=False).ids + [1]
    assert encoder.text("z" * 300_000) == library.encode("z" * 300_000, add_special_tokens=False).ids + [1]
