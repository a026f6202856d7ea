"""SimHash fingerprints, the trie join and components against brute force."""

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import simhash as S
from tessera.llm.components import connected_components


def plain_fingerprint(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode()
    words = [w for w in words.replace(b"\t", b" ").replace(b"\n", b" ").replace(b"\x0b", b" ").replace(b"\x0c", b" ").replace(b"\r", b" ").split(b" ") if w]
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab \n\tÉXé\x1c", max_size=60))
def test_fingerprint(text):
    assert S.fingerprint(text) == plain_fingerprint(text)


def test_a_very_long_text():
    text = " ".join(f"w{i * 7919 % 5003} É" for i in range(120_000))
    assert S.fingerprint(text) == plain_fingerprint(text)
    assert S.fingerprint("x" * 1_000_000) == plain_fingerprint("x" * 1_000_000)


def brute_components(values, budget=4):
    n = len(values)
    label = list(range(n))
    def root(i):
        while label[i] != i:
            i = label[i]
        return i
    for i in range(n):
        for j in range(i):
            if (values[i] ^ values[j]).bit_count() <= budget:
                a, b = root(i), root(j)
                label[max(a, b)] = min(a, b)
    return [root(i) for i in range(n)]


def flipped(rng, value, most):
    for b in rng.choice(64, rng.integers(0, most + 1), replace=False):
        value ^= 1 << int(b)
    return value


def near_values(seed, n, bases):
    rng = np.random.default_rng(seed)
    roots = [int(x) for x in rng.integers(0, 2**63, bases)]
    return list(dict.fromkeys(flipped(rng, roots[rng.integers(bases)], 6) for _ in range(n)))


@pytest.mark.parametrize("frontier", [50, 1_000_000])
def test_trie_join(frontier, monkeypatch):
    monkeypatch.setattr(S, "FRONTIER", frontier)
    for seed in range(6):
        groups = [sorted(near_values(seed * 10 + k, 60, 7)) for k in range(3)]
        flat = np.array([v for g in groups for v in g], dtype=np.uint64)
        ends = np.cumsum([len(g) for g in groups])
        starts = np.concatenate([[0], ends[:-1]])
        label = S.trie_join(flat, starts, ends)
        for g, a, b in zip(groups, starts, ends):
            assert [int(x) - a for x in label[a:b]] == brute_components(g)


@pytest.mark.parametrize("large", [2, 4096])
def test_near_links_lose_none(spark, large, monkeypatch):
    monkeypatch.setattr(S, "LARGE_BUCKET", large)
    values = near_values(99, 300, 25)
    rows = [(v - 2**64 if v >= 2**63 else v, i) for i, v in enumerate(values)]
    found = {r["node"]: r["component"] for r in connected_components(S.near_links(spark.createDataFrame(rows, "fp long, rep long"))).collect()}
    assert [found.get(i, i) for i in range(len(values))] == brute_components(values)


def test_key_plans_cover_the_budget():
    for n in (10, 2**20, 2**30, 2**40):
        for ranges in S.key_plan(n):
            assert all(0 <= a < b <= 64 for a, b in ranges)
            free = [x for block in S.free_blocks(ranges) for a, b in block for x in range(a, b)]
            assert sorted(free + [x for a, b in ranges for x in range(a, b)]) == list(range(64))


def test_long_chains(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(100, 400)] + [(7, 7), (5, 9), (9, 5)], "u long, v long")
    found = {r["node"]: r["component"] for r in connected_components(links).collect()}
    assert found == {**{i: 100 for i in range(100, 401)}, 5: 5, 9: 5}


EDGE = [(1, None), (2, ""), (3, " \n"), (4, "one two"), (4, "one two"), (5, "One two"), (6, "other words entirely here and more"), (None, "one two")]


def test_edge_rows(spark):
    rows = spark.createDataFrame([(i, t, "x") for i, t in EDGE], "doc_id long, text string, fp string")
    got = sorted(((r["doc_id"] or -1, r["component_id"]) for r in S.near_components(rows).collect()))
    assert got == [(-1, 4), (1, 1), (2, 1), (3, 1), (4, 4), (4, 4), (5, 4), (6, 6)]
    kept = sorted((r["doc_id"] or -1) for r in S.keep_one(rows).collect())
    assert kept == [-1, 1, 4, 6] and S.keep_one(rows).columns == rows.columns
    assert S.near_components(rows.where("false")).count() == 0


def test_rows_of_one_id_with_different_texts(spark):
    """They are rows of their own: each stays with its component, and a component keeps its head whatever its id is used for elsewhere."""
    a, b = "one two three four five six seven", "quite other words are said here and now"
    rows = [(5, a, "p"), (5, b, "q"), (5, b, "q"), (7, a, "r"), (9, b, "s"), (2, "nothing alike at all in this text", "t")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _h string")
    kept = sorted((r["doc_id"], r["text"]) for r in S.keep_one(docs).collect())
    assert kept == sorted([(5, a), (5, b), (2, rows[-1][1])]) and S.keep_one(docs).columns == docs.columns
    got = sorted((r["doc_id"], r["component_id"]) for r in S.near_components(docs).collect())
    assert got == [(2, 2), (5, 5), (5, 5), (5, 5), (7, 5), (9, 5)]


def test_query(spark, sf_dir):
    from tessera.llm.queries import op10_simhash_near_dedup

    got = op10_simhash_near_dedup(spark, sf_dir).toPandas().sort_values("doc_id")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").toPandas().sort_values("doc_id")
    values = [plain_fingerprint(t) for t in docs.text]
    assert list(got.fingerprint) == [f"{v:016x}" for v in values]
    assert list(got.component_id) == [docs.doc_id.iloc[i] for i in brute_components(values)]
