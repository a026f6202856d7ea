"""Byte-level BPE against the library on whole texts, an exact round trip, and texts that the library alone cannot split."""

import hashlib
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import bpe

pytest.importorskip("tiktoken")


@pytest.fixture(scope="module")
def own():
    return bpe.ByteBPE(bpe.default_path())


def sha(data):
    return hashlib.sha256(data).hexdigest()


def test_the_pattern_is_the_published_one():
    import public_tokenizers

    assert bpe.KNOWN_PATTERN == public_tokenizers.PATTERN


def test_classes_of_boundaries():
    import regex

    every = list(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    assert all(bool(re.fullmatch(f"[{bpe.SPACE}]", c)) == (bool(regex.fullmatch(r"\s", c)) and c not in "\x1c\x1d\x1e\x1f") for c in every)
    assert all(regex.fullmatch(r"\p{L}|\p{N}", c) for c in every if re.fullmatch(f"[{bpe._WORD}]", c))
    assert not any(regex.fullmatch(r"\p{L}|\p{N}|\s", c) for c in every if re.fullmatch(f"[{bpe._MARK}]", c))


@settings(max_examples=400, deadline=None)
@given(text=st.text(alphabet=st.one_of(st.sampled_from("aB1 \n\t'srlé日、。!-’ \xa0\x1c٣́"), st.characters(codec="utf-8")), max_size=80))
def test_parts_give_the_ids_of_the_whole(own, text):
    held = bpe.CHUNK, bpe.LONG_SPACE, bpe._LONG
    bpe.CHUNK, bpe.LONG_SPACE, bpe._LONG = 5, 4, re.compile(f"[{bpe.SPACE}]{{4,}}")
    try:
        parts = list(bpe.safe_parts(text))
        assert "".join(p for p, _ in parts) == text
        ids = own.encode(text)
        assert ids == own.library.encode_ordinary(text) and own.decode(ids) == text.encode()
    finally:
        bpe.CHUNK, bpe.LONG_SPACE, bpe._LONG = held


def test_each_match_by_itself(own):
    """Ids are those of each match of the pattern in turn."""
    import regex

    for text in ("It's 12 o'clock,  they'll   go\n\n now ", "日本語、テスト 123 ''s -- 'x", "tab\t\tend  "):
        assert own.encode(text) == [i for m in regex.findall(bpe.KNOWN_PATTERN, text) for i in own.library._encode_single_piece(m)]


def test_long_white_space(own):
    """A million blanks and more overflow the library's matcher; here they are a match of their own."""
    for text in (" " * 1_200_000 + "x", "a" + "\n" * 1_200_000 + "b", "a" + " " * 1_200_000):
        ids = own.encode(text)
        assert own.decode(ids) == text.encode()
        end = len(text) - (text[-1] in "xb") - (text[-1] == "x")
        start = text[0] == "a"
        blank = text[start : len(text) - (2 if text[-1] in "xb" else 0)]
        assert ids[int(start) : int(start) + len(own.library._encode_single_piece(blank))] == own.library._encode_single_piece(blank) and end


def test_long_texts_are_cut(own):
    text = "Word and word, 'tis 日本、語 " * 20_000
    parts = list(own.parts(text))
    assert len(parts) > 5 and [i for p in parts for i in p] == own.library.encode_ordinary(text)
    one_word = "x" * 300_000
    assert own.encode(one_word) == own.library.encode_ordinary(one_word)


def test_another_pattern_is_not_cut():
    other = bpe.ByteBPE(bpe.default_path(), r"\S+\s*|\s+")
    text = "a b  c, " * 20_000
    assert len(list(other.parts(text))) == 1 and other.encode(text) == other.library.encode_ordinary(text)


def test_whole_table(spark, sf_dir, own):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumnRenamed("lang", "ids").withColumnRenamed("source", "n_tokens")
    got = {r["doc_id"]: r for r in bpe.round_trip(docs).collect()}
    rows = docs.collect()
    assert len(got) == len(rows)
    for r in rows:
        ids = own.library.encode_ordinary(r["text"] or "")
        assert tuple(got[r["doc_id"]])[1:] == (len(ids), sha(np.array(ids, "<u4").tobytes()), sha((r["text"] or "").encode()))


def test_edge_rows_and_both_ways(spark, own):
    texts = [None, "", "a", "a", "<|endoftext|> é\x00😀", " " * 9000 + "x", "z" * 200_000]
    rows = spark.createDataFrame([(None if i == 2 else i % 4, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = bpe.encoded(rows).collect()
    assert sorted(((r["doc_id"], r["ids"]) for r in got), key=repr) == sorted(((None if i == 2 else i % 4, own.library.encode_ordinary(t or "")) for i, t in enumerate(texts)), key=repr)
    back = bpe.decoded(bpe.encoded(rows)).collect()
    assert sorted(bytes(r["bytes"]) for r in back) == sorted((t or "").encode() for t in texts)
    assert bpe.round_trip(rows.where("false")).count() == 0 and bpe.round_trip(rows).count() == len(texts)
    first = own.library.encode_ordinary("日")
    odd = spark.createDataFrame([(1, None), (2, []), (3, [70_000]), (4, [-1]), (5, [None]), (6, first[:1]), (7, [10, 50_256])], "doc_id long, ids array<int>")
    found = {r["doc_id"]: r["bytes"] for r in bpe.decoded(odd).collect()}
    assert [found[i] for i in (1, 3, 4, 5, 7)] == [None] * 5 and bytes(found[2]) == b"" and "日".encode().startswith(bytes(found[6]))
