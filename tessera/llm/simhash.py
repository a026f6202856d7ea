"""SimHash fingerprints and their Hamming join by a binary trie."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import blank_words, cut, map_texts, prepare
from tessera.llm.components import connected_components

SHINGLE = 4
SEED = 42
BITS = 64
BUDGET = 4
#: A bucket of more fingerprints than this is dealt again by blocks of its free bits.
LARGE_BUCKET = 4096
#: Node pairs that a traversal holds at once.
FRONTIER = 1_000_000

_BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
_BYTE_AT = (np.arange(8, dtype=np.int64) * 256)[None, :]


def fingerprint(text: str | None) -> int:
    """Majority of the bits of XXH64 over word shingles, repeats included; 0 for a text without words."""
    from xxhash import xxh64_intdigest

    words = blank_words(text)
    if not words:
        return 0
    parts = map(b" ".join, zip(*(words[i:] for i in range(SHINGLE)))) if len(words) >= SHINGLE else [b" ".join(words)]
    hashes = np.array([xxh64_intdigest(s, SEED) for s in parts], dtype="<u8")
    n = len(hashes)
    by_byte = np.bincount((hashes.view(np.uint8).reshape(n, 8) + _BYTE_AT).ravel(), minlength=2048).reshape(8, 256)
    ones = (by_byte @ _BYTE_BITS).ravel() * 2 > n
    return int(np.packbits(ones, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, th): fp the fingerprint as a signed long, th a hash of the text that tells rows of one doc_id apart."""

    def make():
        def fn(ids, hashes, texts):
            return ids, np.array([fingerprint(t) for t in texts], dtype=np.uint64).view(np.int64), hashes

        return fn

    prepare(docs.sparkSession)
    rows = docs.select("doc_id", F.xxhash64("text").alias("th"), "text")
    return map_texts(rows, "doc_id long, fp long, th long", make, ["doc_id", "th", "text"])


def block_ranges(low: int, high: int, blocks: int) -> list[tuple[int, int]]:
    cuts = [low + (high - low) * i // blocks for i in range(blocks + 1)]
    return list(zip(cuts, cuts[1:]))


def key_plan(n: int) -> list[list[tuple[int, int]]]:
    """Bit ranges of each key for n fingerprints: BUDGET + kept blocks, every choice of ``kept`` of them.

    Two fingerprints with at most BUDGET differing bits agree in at least ``kept`` blocks, so they share a key.
    More fingerprints get longer keys, so that a bucket of evenly spread fingerprints stays small.
    """
    for kept in range(1, 5):
        blocks = BUDGET + kept
        if n <= 2 ** (BITS * kept // blocks + 6):
            break
    ranges = block_ranges(0, BITS, blocks)
    return [list(c) for c in combinations(ranges, kept)]


def _bits(ranges: list[tuple[int, int]], value: str = "fp") -> str:
    """SQL for the bits of the ranges, packed into a long."""
    out, at = [], 0
    for low, high in ranges:
        out.append(f"shiftleft(shiftrightunsigned({value}, {low}) & {(1 << (high - low)) - 1}L, {at})")
        at += high - low
    return " | ".join(out)


def free_blocks(ranges: list[tuple[int, int]]) -> list[list[tuple[int, int]]]:
    """The bits outside a key's ranges, dealt into BUDGET + 1 blocks of about the same size."""
    kept = {b for low, high in ranges for b in range(low, high)}
    free = [b for b in range(BITS) if b not in kept]
    return [[(b, b + 1) for b in free[low:high]] for low, high in block_ranges(0, len(free), BUDGET + 1)]


def buckets(reps: DataFrame, n: int) -> DataFrame:
    """(key, sub, fp, rep): a row for each key of a fingerprint; rows of a large bucket once for each of its blocks."""
    plan = key_plan(n)
    keys = ", ".join(f"struct({k} AS k, {_bits(r)} AS v)" for k, r in enumerate(plan))
    rows = reps.select("fp", "rep", F.explode(F.expr(f"array({keys})")).alias("x")).select("fp", "rep", "x.k", "x.v")
    large = rows.groupBy("k", "v").agg(F.count("*").alias("n")).where(F.col("n") > LARGE_BUCKET).select("k", "v", F.lit(True).alias("large"))
    subs = "CASE k " + " ".join(
        f"WHEN {k} THEN array({', '.join(f'struct({j + 1} AS j, {_bits(b)} AS s)' for j, b in enumerate(free_blocks(r)))})" for k, r in enumerate(plan)
    ) + " END"
    dealt = rows.join(large, ["k", "v"], "left")
    few = F.array(F.struct(F.lit(0).alias("j"), F.lit(0).cast("long").alias("s")))
    dealt = dealt.select("k", "v", "fp", "rep", F.explode(F.when(F.col("large"), F.expr(subs)).otherwise(few)).alias("y"))
    return dealt.select("k", "v", "y.j", "y.s", "fp", "rep")


def local_components(n: int, i: np.ndarray, j: np.ndarray, p: np.ndarray | None = None) -> np.ndarray:
    """Smallest index reachable over links i-j, starting from labels p."""
    p = np.arange(n) if p is None else p
    while True:
        a, b = p[i], p[j]
        open_ = a != b
        if not open_.any():
            return p
        i, j, a, b = i[open_], j[open_], a[open_], b[open_]
        np.minimum.at(p, np.maximum(a, b), np.minimum(a, b))
        while True:
            q = p[p]
            if (q == p).all():
                break
            p = q


def trie_join(fps: np.ndarray, starts: np.ndarray, ends: np.ndarray, budget: int = BUDGET) -> np.ndarray:
    """Labels of the components of fps (sorted inside each [start, end) group) under links of at most ``budget`` bits.

    Each group is a binary trie whose nodes are ranges of the sorted fingerprints. Pairs of nodes of one group are
    traversed together from the highest bit; a child pair on different sides of a bit adds a differing bit, and pairs
    beyond the budget, or wholly inside one component already, are pruned. Pairs of single leaves are settled by a
    population count. A deep traversal keeps at most about FRONTIER pairs in memory: the rest wait on a stack.
    """
    n = len(fps)
    label = np.arange(n)
    ones: dict[int, np.ndarray] = {}

    def split(low, high, level):
        if level not in ones:
            ones[level] = np.concatenate([[0], np.cumsum((fps >> np.uint64(level)) & np.uint64(1))]).astype(np.int64)
        return high - (ones[level][high] - ones[level][low])

    many = ends - starts > 1
    a0, a1 = starts[many].astype(np.int64), ends[many].astype(np.int64)
    work = [(BITS - 1, a0, a1, a0, a1, np.zeros(len(a0), np.int64))]
    while work:
        level, a0, a1, b0, b1, err = work.pop()
        if len(a0) > FRONTIER:
            for at in range(0, len(a0), FRONTIER // 4):
                s = slice(at, at + FRONTIER // 4)
                work.append((level, a0[s], a1[s], b0[s], b1[s], err[s]))
            continue
        one = (a1 - a0 == 1) & (b1 - b0 == 1)
        if one.any():
            i, j = a0[one], b0[one]
            near = (np.bitwise_count(fps[i] ^ fps[j]) <= budget) & (i != j)
            if near.any():
                label = local_components(n, i[near], j[near], label)
        keep = ~one
        if len(a0) > 4096:
            change = np.flatnonzero(np.diff(label)) + 1
            run_end = np.concatenate([change, [n]])[np.searchsorted(change, np.arange(n), side="right")]
            keep &= ~((run_end[a0] >= a1) & (run_end[b0] >= b1) & (label[a0] == label[b0]))
        if level < 0 or not keep.any():
            continue
        a0, a1, b0, b1, err = a0[keep], a1[keep], b0[keep], b1[keep], err[keep]
        am, bm = split(a0, a1, level), split(b0, b1, level)
        same = a0 == b0
        parts = []
        for x0, x1, y0, y1, more, which in (
            (a0, am, b0, bm, 0, None), (am, a1, bm, b1, 0, None), (a0, am, bm, b1, 1, None), (am, a1, b0, bm, 1, ~same),
        ):
            ok = (x1 > x0) & (y1 > y0) & (err + more <= budget)
            if not more:
                ok &= ~(same & (x1 - x0 == 1))
            if which is not None:
                ok &= which
            parts.append((x0[ok], x1[ok], y0[ok], y1[ok], err[ok] + more))
        work.append((level - 1, *(np.concatenate(c) for c in zip(*parts))))
    return label


def _links(batches):
    """Arrow batches of (k, v, j, s, fp, rep), sorted by bucket and unsigned fp -> (u, v) links that span each bucket's components."""
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])
    held: list[np.ndarray] = []
    size, enough = 0, 100_000

    def solve(rows: np.ndarray):
        """rows: k, v, j, s, fp, rep by column; whole buckets."""
        new = np.concatenate([[True], (rows[:4, 1:] != rows[:4, :-1]).any(axis=0)])
        starts = np.flatnonzero(new)
        label = trie_join(rows[4].view(np.uint64), starts, np.concatenate([starts[1:], [rows.shape[1]]]))
        order = np.argsort(label, kind="stable")
        link = label[order][1:] == label[order][:-1]
        u, v = rows[5][order][:-1][link], rows[5][order][1:][link]
        return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], schema=schema)

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(np.stack([np.ascontiguousarray(batch.column(i).cast(pa.int64()).to_numpy()) for i in range(6)]))
        size += batch.num_rows
        if size >= enough:
            rows = np.concatenate(held, axis=1)
            last = rows[:4, -1:]
            open_at = rows.shape[1] - int(np.argmin(np.concatenate([(rows[:4] == last).all(axis=0)[::-1], [False]])))
            if open_at:
                yield solve(rows[:, :open_at])
                held, size = [rows[:, open_at:].copy()], rows.shape[1] - open_at
            else:
                held = [rows]
            enough = max(100_000, 2 * size)  # an open bucket is copied each time it doubles only
    if size:
        yield solve(np.concatenate(held, axis=1))


def near_links(reps: DataFrame) -> DataFrame:
    """reps: (fp, rep), fp distinct -> (u, v) links between reps that connect whatever is linked within the budget."""
    rows = buckets(reps, reps.count())
    dealt = rows.repartition("k", "v", "j", "s").sortWithinPartitions("k", "v", "j", "s", F.shiftrightunsigned("fp", 1), F.col("fp").bitwiseAND(F.lit(1)))
    return dealt.mapInArrow(_links, "u long, v long")


def labelled(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((doc_id, fp, th) of every row, (fp, label) of every fingerprint): label names the fingerprint's component."""
    rows = cut(fingerprints(docs))
    fps = cut(rows.select("fp").distinct())
    found = connected_components(near_links(fps.select("fp", F.col("fp").alias("rep"))))
    return rows, fps.join(found, F.col("fp") == F.col("node"), "left").select("fp", F.coalesce("component", "fp").alias("label"))


def near_components(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, component_id) for every row of docs.

    component_id: the smallest doc_id reachable over fingerprints that differ in at most BUDGET bits; equal
    fingerprints are met once. Null and empty texts have fingerprint 0 and link like any other; rows of one doc_id are
    rows of their own, each by its text; a null doc_id never names a component unless all of the component's are null;
    repeated rows get equal results; an empty table gives none. All shingles of a very long text count. Further columns are not read.
    """
    rows, labels = labelled(docs)
    least = rows.groupBy("fp").agg(F.min("doc_id").alias("m"))
    heads = cut(labels.join(least, "fp"))
    named = heads.groupBy("label").agg(F.min("m").alias("component_id"))
    return rows.select("doc_id", "fp").join(heads.join(named, "label").select("fp", "component_id"), "fp")


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each component, whole rows: that of its smallest doc_id. Rows without a doc_id have no say and stay.

    Of rows of one doc_id in one component the one of the smallest hash of its text stays, of equal rows one; rows of
    one doc_id in several components are documents of their own.
    """
    rows, labels = labelled(docs)
    least = rows.where("doc_id IS NOT NULL").groupBy("fp").agg(F.min(F.struct("doc_id", "th")).alias("m"))
    heads = labels.join(least, "fp").groupBy("label").agg(F.min("m").alias("m")).select(F.col("m.doc_id").alias("doc_id"), F.col("m.th").alias("_h"))
    kept = docs.where("doc_id IS NOT NULL").withColumn("_h", F.xxhash64("text")).join(heads, ["doc_id", "_h"], "left_semi").dropDuplicates(["doc_id", "_h"])
    return kept.select(*docs.columns).unionByName(docs.where("doc_id IS NULL"))


def as_hex(fp: str = "fp"):
    return F.lower(F.lpad(F.hex(F.col(fp)), 16, "0"))

