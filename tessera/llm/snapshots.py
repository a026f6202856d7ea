"""Snapshot difference with rekeying: pairs of rows with equal keys, then of rows with equal content, inserts and deletes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import cut, numbered, prepare, tidy

#: Earlier keys that one perfect hash holds, about 20 MB with their slots.
SLOTS = 65_536
#: Bytes of a value's digest: the first of its SHA-256.
WIDTH = 16


class PerfectHash:
    """Minimal perfect hash of distinct 64-bit numbers.

    At each level a number falls on a bit of an array of twice their count; those that are alone there set it, the others
    go on to the next level. A number's slot is the rank of its bit over all levels. A number that is not among those
    of the build gets some slot or none, so slots must be verified.
    """

    def __init__(self, numbers: np.ndarray):
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        self.n = 0
        while len(numbers):
            size = 2 * len(numbers) + 1
            at = _mixed(numbers, len(self.levels)) % np.uint64(size)
            alone = np.bincount(at.astype(np.int64), minlength=size) == 1
            self.levels.append((alone, self.n + np.cumsum(alone) - 1))
            self.n += int(alone.sum())
            numbers = numbers[~alone[at]]

    def slots(self, numbers: np.ndarray) -> np.ndarray:
        found, left = np.full(len(numbers), -1, np.int64), np.arange(len(numbers))
        for level, (alone, rank) in enumerate(self.levels):
            at = _mixed(numbers[left], level) % np.uint64(len(alone))
            hit = alone[at]
            found[left[hit]] = rank[at[hit]]
            left = left[~hit]
        return found


def _mixed(x: np.ndarray, level: int) -> np.ndarray:
    """Each level's own 64-bit mix."""
    x = x + np.uint64(0x9E3779B97F4A7C15 * (level + 1) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Earlier:
    """Earlier rows of one bucket in the slots of a perfect hash, and a bitmap of the slots that no later row has taken.

    Rows are (key, nth of its key); equal 64-bit hashes of different rows, should they meet, are kept beside the slots.
    """

    def __init__(self, rows: pa.Table):
        h = rows["h"].to_numpy().view(np.uint64)
        _, first = np.unique(h, return_index=True)
        self.hash = PerfectHash(h[first])
        order = np.empty(self.hash.n, np.int64)
        order[self.hash.slots(h[first])] = first
        beside = np.setdiff1d(np.arange(len(h)), first)
        self.rows = rows.take(pa.array(np.concatenate([order, beside]))).combine_chunks()
        self.beside = {(r["key"], r["nth"]): self.hash.n + i for i, r in enumerate(self.rows.slice(self.hash.n).select(["key", "nth"]).to_pylist())}
        self.vacant = np.ones(len(h), bool)

    def probe(self, later: pa.Table) -> np.ndarray:
        """The place of each later row's earlier row, -1 if it has none; places met are no longer vacant."""
        place = self.hash.slots(later["h"].to_numpy().view(np.uint64))
        place[~_same(self.rows, place, later)] = -1
        if self.beside:
            for i in np.flatnonzero(place < 0):
                place[i] = self.beside.get((later["key"][i].as_py(), later["nth"][i].as_py()), -1)
        self.vacant[place[place >= 0]] = False
        return place


def _same(rows: pa.Table, place: np.ndarray, later: pa.Table) -> np.ndarray:
    """Whether the row in each place has exactly the later row's key; null equals null only."""
    if not rows.num_rows:
        return np.zeros(len(place), bool)
    at = pa.array(np.maximum(place, 0))
    ours, theirs = rows["key"].take(at), later["key"]
    equal = pc.or_(pc.fill_null(pc.equal(ours, theirs), False), pc.and_(pc.is_null(ours), pc.is_null(theirs))).to_numpy()
    return (place >= 0) & equal & (rows["nth"].take(at).to_numpy() == later["nth"].to_numpy())


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bool, int, pa.Table]]:
    """(whether a bucket begins, side, rows) of sorted batches, cut where the bucket or the side changes."""
    open_bucket = None
    for batch in batches:
        if not batch.num_rows:
            continue
        b, side = batch["b"].to_numpy(), batch["side"].to_numpy()
        ends = [*(np.flatnonzero((b[1:] != b[:-1]) | (side[1:] != side[:-1])) + 1).tolist(), batch.num_rows]
        start = 0
        for end in ends:
            yield b[start] != open_bucket, int(side[start]), pa.Table.from_batches([batch.slice(start, end - start)])
            open_bucket, start = b[start], end


def _digest(value: Column) -> Column:
    """The first bytes of a value's SHA-256; null has zero bytes of its own."""
    return F.coalesce(F.unhex(F.substring(F.sha2(value.cast("string").cast("binary"), 256), 1, 2 * WIDTH)), F.unhex(F.lit("00" * WIDTH)))


def _slim(df: DataFrame, side: int, key: str, columns: list[str]) -> DataFrame:
    """Key, digests of the columns, a hash of these, and the SHA-256 of a later row as a whole."""
    whole = F.concat_ws("\n", *(F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in columns))
    row = F.unhex(F.sha2(whole.cast("binary"), 256)) if side else F.lit(None).cast("binary")
    slim = df.select(F.lit(side).alias("side"), F.col(key).alias("key"), F.concat(*(_digest(F.col(c)) for c in columns)).alias("cells"), row.alias("row"))
    return slim.withColumn("v", F.xxhash64("cells"))


def by_key(earlier: DataFrame, later: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, old_key, op, changed, cells, row): pairs of equal keys are ``same`` or ``update``, the others ``old`` or ``new``.

    Rows go to partitions by the hash of (key, nth of its key), which no other row of its side has, and inside to
    buckets of about SLOTS earlier rows: these fill a perfect hash, later rows probe it, what stays vacant is ``old``.
    """
    spark = earlier.sparkSession
    rows = _slim(earlier, 0, key, columns).unionByName(_slim(later, 1, key, columns))
    rows = numbered(rows, ["side", "key"], ["v"], "nth").withColumn("h", F.xxhash64("key", "nth"))
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(1, -(-rows.where("side = 0").count() // (partitions * SLOTS)))
    rows = rows.withColumn("b", F.pmod(F.shiftrightunsigned("h", 20), F.lit(buckets)))
    kind = dict(earlier.select(key).dtypes)[key]
    schema = f"key {kind}, old_key {kind}, op string, changed string, cells binary, row binary"
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def out(key, old_key, op, changed, cells, row):
        n = len(op)
        full = lambda x, f: pa.nulls(n, f.type) if x is None else (x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x).cast(f.type)
        return pa.RecordBatch.from_arrays([full(x, f) for x, f in zip((key, old_key, op, changed, cells, row), arrow)], schema=arrow)

    def kept(earlier: Earlier | None):
        if earlier is not None and earlier.vacant.any():
            rows = earlier.rows.filter(pa.array(earlier.vacant))
            yield out(rows["key"], rows["key"], pa.array(["old"] * rows.num_rows), None, rows["cells"], None)

    def run(batches):
        held, gathered = None, []
        for begins, side, rows in _buckets(batches):
            if begins:
                yield from kept(held if held is not None else Earlier(pa.concat_tables(gathered)) if gathered else None)
                held, gathered = None, []
            if not side:
                gathered.append(rows)
                continue
            if held is None:
                held = Earlier(pa.concat_tables(gathered) if gathered else rows.slice(0, 0))
                gathered = []
            yield from compared(held, rows)
        yield from kept(held if held is not None else Earlier(pa.concat_tables(gathered)) if gathered else None)
        tidy()

    def compared(held: Earlier, later: pa.Table):
        place = held.probe(later)
        met = place >= 0
        if met.any():
            ours, theirs = held.rows.take(pa.array(place[met])), later.filter(pa.array(met))
            names = _changed(ours["cells"], theirs["cells"], columns)
            op = pa.array(["update" if x else "same" for x in names])
            yield out(theirs["key"], ours["key"], op, pa.array(names), None, theirs["row"])
        if not met.all():
            new = later.filter(pa.array(~met))
            yield out(new["key"], None, pa.array(["new"] * new.num_rows), None, new["cells"], new["row"])

    # a null old_key may be a key as well, so op alone tells sides apart
    return rows.repartition("h").sortWithinPartitions("b", "side").mapInArrow(run, schema)


def _changed(ours: pa.ChunkedArray, theirs: pa.ChunkedArray, columns: list[str]) -> list[str]:
    """Names of the columns whose digests differ, joined by commas."""
    a, b = (np.frombuffer(b"".join(x.to_pylist()), np.uint8).reshape(len(x), len(columns), WIDTH) for x in (ours, theirs))
    bits = (a != b).any(axis=2) @ (1 << np.arange(len(columns)))
    names = {int(k): ",".join(c for i, c in enumerate(columns) if k >> i & 1) for k in np.unique(bits)}
    return [names[k] for k in bits.tolist()]


def difference(earlier: DataFrame, later: DataFrame, key: str, content: str, columns: list[str]) -> DataFrame:
    """(key, old_key, op, changed, row_sha256) of every pair of rows and every row without a partner.

    Rows with equal keys pair: ``same``, or ``update`` with the differing ``columns``. Then among rows left over with
    equal ``content`` the i-th smallest earlier key pairs with the i-th smallest later one: ``rekey``. What is left is
    ``insert`` or ``delete``. Values are compared by 128 bits of the SHA-256 of their text; nulls equal only nulls, in keys too. Rows that
    repeat a key on one side pair in the order of a hash of their values, rows equal in everything one by one. Very long
    values are hashed where they are read and not sent on. Either table may be empty; further columns are not read. ``row_sha256`` is that of the later row's columns, joined by line feeds, null as ``~``.
    """
    prepare(earlier.sparkSession)
    found = cut(by_key(earlier, later, key, columns))
    paired = found.where("op IN ('same', 'update')")
    at = columns.index(content) * WIDTH + 1
    left = found.where("op IN ('old', 'new')").select((F.col("op") == "new").alias("is_new"), "key", "cells", "row", F.substring("cells", at, WIDTH).alias("content"))
    left = numbered(left.withColumn("v", F.xxhash64("cells")), ["is_new", "content"], ["key", "v"], "nth")
    old = left.where("NOT is_new").select("content", "nth", F.col("key").alias("old_key"), F.col("cells").alias("old_cells"), F.lit(True).alias("is_old"))
    new = left.where("is_new").select("content", "nth", F.col("key").alias("new_key"), "cells", "row", "is_new")
    both = old.join(new, ["content", "nth"], "full")
    differing = F.concat_ws(",", *(F.when(_cell("cells", i) != _cell("old_cells", i), F.lit(c)) for i, c in enumerate(columns)))
    again = both.select(
        F.when(F.col("is_new"), F.col("new_key")).otherwise(F.col("old_key")).alias("key"), "old_key",
        F.when(F.col("is_old") & F.col("is_new"), "rekey").when(F.col("is_new"), "insert").otherwise("delete").alias("op"),
        F.when(F.col("is_old") & F.col("is_new"), differing).otherwise("").alias("changed"), "row",
    )
    all_rows = paired.select("key", "old_key", "op", "changed", "row").unionByName(again)
    return all_rows.select("key", "old_key", "op", "changed", F.lower(F.hex("row")).alias("row_sha256"))


def _cell(column: str, i: int) -> Column:
    return F.substring(column, i * WIDTH + 1, WIDTH)
