"""Mixing: targets by the plain reshare loop, whole coverage, edge rows."""

import re

from tessera.llm import mixing as M


def plain_targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [s for s in sizes if s is None]
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    total, target, open_ = 1.5 * sum(sizes.values()), {}, set(names)
    while True:
        left = total - sum(2 * sizes[s] for s in names if s not in open_)
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] > 2 * sizes[s] + 1e-9]
        if not over:
            return {s: share[s] if s in open_ else 2.0 * sizes[s] for s in names}
        open_ -= set(over)


def check(rows, block_words=M.BLOCK_WORDS):
    sizes = {}
    for r in rows:
        sizes[r["source"]] = sizes.get(r["source"], 0) + r["size"]
    targets = plain_targets(sizes)
    open_ = [t for t in targets.values() if t > 0]
    block = M.block_size(sum(open_), min(open_, default=0), len(rows), block_words)
    for s in sizes:
        own = [r for r in rows if r["source"] == s]
        assert all(abs(r["target"] - targets[s]) < 1e-6 * max(1, targets[s]) and r["source_size"] == sizes[s] for r in own)
        assert abs(sum(r["taken"] for r in own) - targets[s]) <= 2 * block
        assert all(0 <= r["taken"] <= 2 * r["size"] and (r["first_slot"] is None) == (r["taken"] == 0) for r in own)


def plain_mix(rows, sources, block_words, step):
    """Words and first slot by rid, slot by slot and word by word. rows: (rid, doc_id, source, size, h); sources: by place."""
    targets = {s["source"]: s["target"] for s in sources if s["target"] > 0}
    total = sum(targets.values())
    block = M.block_size(total, min(targets.values()), len(rows), block_words)
    streams = {s: [r["rid"] for r in sorted((r for r in rows if r["source"] == s), key=lambda r: order_of(r, rows, sources)) for _ in range(r["size"])] * 2 for s in targets}
    slots, took, first, rank = M.slot_count(total, block), {}, {}, dict.fromkeys(targets, 0)
    for slot in range(slots):
        u, high = ((slot + 1) * step % 2**64) / 2**64, 0.0
        for s in targets:
            high += targets[s]
            if u < high / (slots * block):
                for rid in streams[s][rank[s] * block : (rank[s] + 1) * block]:
                    took[rid] = took.get(rid, 0) + 1
                    first.setdefault(rid, slot)
                rank[s] += 1
                break
    return took, first


def order_of(r, rows, sources):
    n = sum(x["source"] == r["source"] for x in rows)
    per = max(16, int(len(rows) ** 0.5) // 4)
    return ((r["h"] % 2**64) >> 8) % -(-n // per), r["h"], (r["doc_id"] is not None, r["doc_id"]), r["size"], r["rid"]


def test_slots_by_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    sizes = M.sized(docs)
    sources = M.source_targets(sizes).cache()
    rows, places = sizes.collect(), sources.orderBy("sid").collect()
    other = {}
    for block, step in ((1024, M.GOLDEN), (7, M.GOLDEN), (7, 1 << 62)):
        took, first = plain_mix(rows, places, block, step)
        got = M.mixture(sizes, sources, block, step).groupBy("rid").agg({"words": "sum", "slot": "min"}).collect()
        assert {r["rid"]: r["sum(words)"] for r in got} == took and {r["rid"]: r["min(slot)"] for r in got} == first
        other[block, step] = took
    assert sum(other[7, 1 << 62].get(i, 0) != n for i, n in other[7, M.GOLDEN].items()) > len(rows) // 2, "the points decide what is taken"


def test_the_schedule_decides(spark, sf_dir):
    """Golden-ratio points meet every target; quarter turns, which are four points only, miss most by far."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    missed = {}
    for step in (M.GOLDEN, 1 << 62):
        got = M.taken_words(docs, step=step).groupBy("source", "target").agg({"taken": "sum"}).collect()
        missed[step] = sorted(abs(r["sum(taken)"] - r["target"]) / r["target"] for r in got)
    assert missed[M.GOLDEN][-1] < 0.01 and missed[1 << 62][4] > 0.3


def test_blocks():
    for total, smallest, documents in ((150_000, 3_000, 200), (3e8, 1e6, 250_000), (1e13, 10, 10**10), (40, 2, 3), (0, 0, 0)):
        block = M.block_size(total, smallest, documents)
        slots = M.slot_count(total, block)
        assert 1 <= block and slots * block >= total and slots <= 2 * max(M.MOST_SLOTS, 4 * documents)
        assert block == 1 or block <= M.NEAR * smallest or total / block > max(M.MOST_SLOTS, 4 * documents) * 0.99


def test_small_tables(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = M.taken_words(docs).collect()
    check(rows)
    want = {r["doc_id"]: len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")) for r in docs.collect()}
    assert {r["doc_id"]: r["size"] for r in rows} == want
    again = M.taken_words(docs.repartition(7)).collect()
    assert {(r["doc_id"], r["taken"]) for r in rows} == {(r["doc_id"], r["taken"]) for r in again}


def test_edge_rows(spark):
    text = "a b c d e "
    rows = [(1, text * 40, "b", 1), (2, text, "b", 1), (2, text, "b", 1), (3, None, None, 1), (4, text * 90, None, 1), (5, "", "a", 1), (None, text * 30, "é", 1), (6, "x", "a", 1), (7, text * 500, "z", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size int")
    for block in (1, 7, 1024):
        got = M.taken_words(docs, block).collect()
        assert len(got) == len(rows)
        check(got, block)
    mixed = M.mixed(docs)
    assert mixed.columns == docs.columns and mixed.count() > 0
    assert M.taken_words(docs.where("false")).count() == 0 and M.mixed(docs.where("false")).count() == 0
    blank = docs.where("doc_id = 5")
    assert [r["taken"] for r in M.taken_words(blank).collect()] == [0]


def test_schedule_is_even(spark):
    sources = spark.createDataFrame([(1, "a", 1, 10, 60000.0), (2, "b", 1, 10, 30000.0), (3, "c", 1, 10, 10000.0), (4, "d", 1, 1, 300.0)], "sid int, source string, n long, source_size long, target double")
    slots, block = M.schedule(sources, 100)
    slots = slots.collect()
    assert block == 1  # NEAR of the smallest
    n, total = M.slot_count(100300, block), 100300
    for sid, target in ((1, 60000), (2, 30000), (3, 10000), (4, 300)):
        places = sorted(r["slot"] for r in slots if r["sid"] == sid)
        assert abs(len(places) - target) <= 2 and len(slots) - total <= 2
        assert all(abs((k + 1) - target / n * (p + 1)) < 6 for k, p in enumerate(places))
        assert sorted(r["k"] for r in slots if r["sid"] == sid) == list(range(len(places)))
    assert len({r["slot"] for r in slots}) == len(slots)
