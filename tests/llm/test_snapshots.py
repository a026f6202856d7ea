"""Snapshot difference: perfect hashes, the contract's rows, and random snapshots against a plain version."""

import random
import struct
import zlib
from collections import defaultdict
from hashlib import sha256

import numpy as np
import oracle
import pytest
import xxhash

from tessera.llm import queries, snapshots
from tessera.llm.common import numbered

COLUMNS = ["text", "lang", "source"]
SCHEMA = "doc_id long, text string, lang string, source string"


def order(x):
    """Nulls first."""
    return (x is not None, x if x is not None else 0)


def plain(earlier, later):
    """Pairs of equal keys, those that repeat by a hash of their values; then of equal texts by key."""
    cells = lambda r: b"".join(sha256(c.encode()).digest()[:16] if c is not None else bytes(16) for c in r[1:])
    value = lambda r: struct.unpack("<q", struct.pack("<Q", xxhash.xxh64_intdigest(cells(r), seed=42)))
    row_sha = lambda r: sha256("\n".join("~" if c is None else c for c in r[1:]).encode()).hexdigest()
    by = lambda rows, f: (d := defaultdict(list), [d[f(r)].append(r) for r in rows])[0]
    out, old, new = [], [], []
    a, b = by(earlier, lambda r: r[0]), by(later, lambda r: r[0])
    changed = lambda x, y: ",".join(c for c, p, q in zip(COLUMNS, x[1:], y[1:]) if p != q)
    for key in {*a, *b}:
        xs, ys = sorted(a[key], key=value), sorted(b[key], key=value)
        for x, y in zip(xs, ys):
            out.append((y[0], x[0], "update" if changed(x, y) else "same", changed(x, y), row_sha(y)))
        old += xs[len(ys) :]
        new += ys[len(xs) :]
    a, b = by(old, lambda r: r[1]), by(new, lambda r: r[1])
    for text in {*a, *b}:
        xs, ys = (sorted(z[text], key=lambda r: (order(r[0]), value(r))) for z in (a, b))
        out += [(y[0], x[0], "rekey", changed(x, y), row_sha(y)) for x, y in zip(xs, ys)]
        out += [(x[0], x[0], "delete", "", None) for x in xs[len(ys) :]]
        out += [(y[0], None, "insert", "", row_sha(y)) for y in ys[len(xs) :]]
    return sorted(out, key=repr)


def got(spark, earlier, later):
    found = snapshots.difference(spark.createDataFrame(earlier, SCHEMA), spark.createDataFrame(later, SCHEMA), "doc_id", "text", COLUMNS)
    return sorted((tuple(r) for r in found.collect()), key=repr)


@pytest.mark.parametrize("n", [0, 1, 2, 1000, 70_000])
def test_perfect_hash(n):
    numbers = np.random.default_rng(n).integers(0, 1 << 63, n).astype(np.uint64)
    made = snapshots.PerfectHash(numbers)
    assert made.n == n and sorted(made.slots(numbers).tolist()) == list(range(n))  # minimal and perfect
    others = made.slots(np.arange(500, dtype=np.uint64))
    assert ((others >= -1) & (others < max(n, 1))).all()


def test_perfect_hash_of_neighbours():
    numbers = np.arange(5000, dtype=np.uint64)
    assert sorted(snapshots.PerfectHash(numbers).slots(numbers).tolist()) == list(range(5000))


def test_equal_hashes_of_different_keys():
    """Keys that share their 64-bit hash are kept beside the slots, and told apart exactly."""
    import pyarrow as pa

    rows = pa.table({"key": [1, 2, 3, None], "nth": [0, 0, 0, 0], "h": [7, 7, 9, 7], "cells": [b"a"] * 4})
    held = snapshots.Earlier(rows)
    later = pa.table({"key": [2, 1, 4, None, 1], "nth": [0, 0, 0, 0, 1], "h": [7, 7, 9, 7, 7]})
    place = held.probe(later)
    keys = held.rows["key"].to_pylist()
    assert [keys[p] if p >= 0 else "none" for p in place] == [2, 1, "none", None, "none"]
    assert [k for k, v in zip(keys, held.vacant) if v] == [3]


def test_random_snapshots(spark):
    rng = random.Random(3)
    texts, words = ["a", "b", "c", "", None, "d" * 50], ["x", "y", None]
    for _ in range(4):
        make = lambda n: [(rng.choice([None, *range(-5, 40)]), rng.choice(texts), rng.choice(words), rng.choice(words)) for _ in range(n)]
        earlier, later = make(rng.choice([0, 60])), make(60)
        later += rng.sample(earlier, len(earlier) // 3)
        assert got(spark, earlier, later) == plain(earlier, later)
    assert got(spark, earlier, []) == plain(earlier, []) and got(spark, [], []) == []


def test_one_key_and_one_text_with_all_rows(spark):
    earlier = [(1, "t", str(i % 3), "s") for i in range(400)] + [(i, "t", "l", None) for i in range(10, 300)]
    later = [(1, "t", str(i % 2), "s") for i in range(390)] + [(-i, "t", "l", None) for i in range(10, 320)]
    assert got(spark, earlier, later) == plain(earlier, later)


def test_small_buckets(spark, monkeypatch):
    monkeypatch.setattr(snapshots, "SLOTS", 3)
    earlier = [(i, str(i % 7), "l", "s") for i in range(300)]
    later = [(i + 150, str(i % 7), "l", None) for i in range(300)]
    assert got(spark, earlier, later) == plain(earlier, later)


def test_clashing_columns_and_string_keys(spark):
    a = spark.createDataFrame([("k1", 1, 2, "t"), ("k2", 1, 2, "t")], "key string, side int, h int, row string")
    b = spark.createDataFrame([("k2", 9, 2, "t"), ("k3", 1, 2, "u")], "key string, side int, h int, row string")
    found = {tuple(r)[:4] for r in snapshots.difference(a, b, "key", "row", ["row", "side"]).collect()}
    assert found == {("k2", "k2", "update", "side"), ("k1", "k1", "delete", ""), ("k3", None, "insert", "")}


def later_rows(rows):
    """The contract's later snapshot, row by row."""
    for key, text, lang, source in rows:
        turn = zlib.crc32(str(key).encode()) % 16 if key is not None else -1
        if turn == 0:
            continue
        if turn == 1:
            text = (text or "") + "+"
        if turn == 2:
            lang, source = source, lang
        if turn == 4:
            source = None
        yield (-1 - key if turn in (3, 4) else key, text, lang, source)
        if turn == 5:
            yield (-1 - key, text, lang, source)


def test_query(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", *COLUMNS).collect()]
    df = queries.op12_snapshot_difference(spark, sf_dir)
    assert sorted((tuple(r) for r in df.collect()), key=repr) == plain(rows, list(later_rows(rows)))
    assert not (found := oracle.differences(df, oracle.connect(sf_dir), queries.ORACLES["op12_snapshot_difference"])), found


def test_numbers_of_rows(spark):
    rng = random.Random(5)
    rows = [(rng.choice([None, "a", "b"]), rng.randrange(5)) for _ in range(500)] + [("hot", i % 2) for i in range(500)]
    df = spark.createDataFrame(rows, "g string, x int").repartition(7)
    found = [tuple(r) for r in numbered(df, ["g"], ["x"], "nth").collect()]
    want = defaultdict(list)
    for g, x in sorted(rows, key=lambda r: (r[0] or "", r[1])):
        want[g].append(x)
    assert sorted(found, key=repr) == sorted(((g, x, i) for g, xs in want.items() for i, x in enumerate(xs)), key=repr)
    assert numbered(df.where("false"), ["g"], ["x"], "nth").count() == 0
