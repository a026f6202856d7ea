"""A vector index in cells: exact nearest vectors, read only where the triangle inequality leaves room for one."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.storage import materialise, spread

#: Vectors that centres are fitted on, and centres, at most; bands of distance to its centre that a cell is cut into.
SAMPLE, CELLS, BANDS = 20_000, 1024, 4
#: Cell of vectors without a direction, whose cosine is 0 with any.
NO_CELL = -1
QUERY_BLOCK = 256


def units(vectors: list) -> np.ndarray:
    """Rows of unit length; zeros stay zeros."""
    m = np.array(vectors, dtype=np.float64)
    norm = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(norm == 0, 1, norm)


def fit_centres(sample: np.ndarray, cells: int, rounds: int = 8, seed: int = 7) -> np.ndarray:
    """Centres by Lloyd's rounds from drawn rows; an empty cell keeps its centre."""
    rng = np.random.default_rng(seed)
    centres = sample[rng.permutation(len(sample))[:cells]].copy()
    for _ in range(rounds):
        own = np.argmax(sample @ centres.T - (centres * centres).sum(1) / 2, axis=1)
        count = np.bincount(own, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, own, sample)
        centres[count > 0] = sums[count > 0] / count[count > 0, None]
    return centres


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * a @ b.T))


def build(vectors: DataFrame, folder: str, sample: int = SAMPLE, cells: int | None = None) -> None:
    """Write (vec_id, embedding) into ``folder``/vectors, partitioned by (cell, band), and ``folder``/centres.

    Centres are fitted on ``sample`` rows chosen by a hash of vec_id; every vector goes to its nearest one, and by its
    distance to it to one of BANDS bands, cut at quarters of its cell's distances. ``cells``: about the root of the number of rows, CELLS
    at most. Null vectors are left out; zero vectors have a cell of their own; repeated ids stay rows of their own.
    """
    spark = vectors.sparkSession
    rows = vectors.select("vec_id", "embedding").where("embedding IS NOT NULL")
    n = rows.count()
    share = min(1.0, 1.3 * sample / max(1, n))
    drawn = rows.where(F.shiftrightunsigned(F.xxhash64("vec_id", F.lit(5)), 11).cast("double") < share * float(1 << 53))
    drawn = units([r["embedding"] for r in drawn.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).collect()] or [[1.0]])
    drawn = drawn[np.abs(drawn).sum(1) > 0] if np.abs(drawn).any() else np.ones((1, drawn.shape[1]))
    centres = fit_centres(drawn, min(len(drawn), cells or max(1, min(CELLS, int(n**0.5)))))
    held = spark.sparkContext.broadcast(centres)

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            m = units(batch.column(1).to_pylist())
            d = _distances(m, held.value)
            cell = np.argmin(d, axis=1)
            near = d[np.arange(len(m)), cell]
            cell = np.where(np.abs(m).sum(1) > 0, cell, NO_CELL)
            offsets = pa.array(np.arange(len(m) + 1, dtype=np.int32) * m.shape[1])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cell.astype(np.int32)), pa.array(near), pa.ListArray.from_arrays(offsets, pa.array(m.ravel()))], names=["vec_id", "cell", "near", "unit"])

    placed = materialise(spread(rows).mapInArrow(run, f"vec_id {dict(rows.dtypes)['vec_id']}, cell int, near double, unit array<double>"))
    cuts = placed.groupBy("cell").agg(F.percentile_approx("near", [i / BANDS for i in range(1, BANDS)]).alias("cuts"))
    band = F.size(F.filter("cuts", lambda c: F.col("near") > c)).cast("int")
    out = placed.join(cuts, "cell").withColumn("band", band).drop("cuts")
    out.repartition("cell", "band").write.mode("overwrite").partitionBy("cell", "band").parquet(f"{folder}/vectors")
    spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "cell int, centre array<double>").coalesce(1).write.mode("overwrite").parquet(f"{folder}/centres")


class Plan:
    """The cells of an index: centres, and the least and largest distance of each (cell, band). Bounded by CELLS * BANDS."""

    def __init__(self, spark: SparkSession, folder: str):
        rows = sorted(spark.read.parquet(f"{folder}/centres").collect(), key=lambda r: r["cell"])
        self.centres = np.array([r["centre"] for r in rows])
        parts = spark.read.parquet(f"{folder}/vectors").groupBy("cell", "band").agg(F.count("*").alias("n"), F.min("near").alias("low"), F.max("near").alias("high")).collect()
        self.parts = sorted((r["cell"], r["band"]) for r in parts)
        by = {(r["cell"], r["band"]): r for r in parts}
        self.n = np.array([by[p]["n"] for p in self.parts], dtype=np.int64)
        self.low, self.high = (np.array([by[p][c] for p in self.parts]) for c in ("low", "high"))

    def bounds(self, asked: np.ndarray) -> np.ndarray:
        """The largest cosine that a vector of each part can have with each query (a row): 1 - d^2 / 2 for the least distance d that
        the triangle inequality leaves. Without a direction on either side the cosine is 0."""
        cell = np.array([c for c, _ in self.parts])
        d = _distances(asked, self.centres)[:, np.maximum(cell, 0)]
        least = np.maximum(0.0, np.maximum(d - self.high, self.low - d))
        out = 1 - least * least / 2
        out[:, cell == NO_CELL] = 0.0
        out[np.abs(asked).sum(1) == 0] = 0.0
        return out


def search(spark: SparkSession, folder: str, queries: DataFrame, top_k: int, seen: dict | None = None) -> DataFrame:
    """(query_id, vec_id, score, rank): the exact nearest vectors by cosine, ties by vec_id, as ``retrieve.dense_top_k`` gives them.

    queries: (query_id, embedding), stated ones, in blocks; null ones find nothing. The parts whose bounds are highest are read first, until they
    hold top_k vectors; then all others whose bound reaches the score of a query's top_k-th vector. ``seen`` is told
    the number of (query, vector) pairs, and how many of them were scored.
    """
    seen = {} if seen is None else seen
    seen |= {"pairs": 0, "scored": 0}
    plan, parts, kinds = Plan(spark, folder), [], dict(spark.read.parquet(f"{folder}/vectors").dtypes)
    kind = dict(queries.dtypes)["query_id"]
    schema = f"query_id {kind}, vec_id {kinds['vec_id']}, score double"
    for block in _blocks(queries):
        ids, asked = [q for q, _ in block], units([e for _, e in block])
        bounds = plan.bounds(asked)
        order = np.argsort(-bounds, axis=1, kind="stable")
        first = np.zeros(bounds.shape, bool)
        upto = (np.cumsum(plan.n[order], axis=1) - plan.n[order] < top_k) if len(plan.parts) else first
        np.put_along_axis(first, order, upto, axis=1)
        near = materialise(_scored(spark, folder, plan, ids, asked, first, top_k, schema))
        floor = np.full(len(ids), -np.inf)
        place = {q: i for i, q in enumerate(ids)}
        w = Window.partitionBy("query_id").orderBy(F.desc("score"))
        for r in near.withColumn("_n", F.row_number().over(w)).where(F.col("_n") == top_k).collect():  # a row a query of the block
            floor[place[r["query_id"]]] = r["score"]
        rest = ~first & (bounds >= floor[:, None] - 1e-8)
        seen["pairs"] += len(ids) * int(plan.n.sum())
        seen["scored"] += int(((first | rest) * plan.n).sum())
        parts += [near, _scored(spark, folder, plan, ids, asked, rest, top_k, schema)]
    if not parts:
        return spark.createDataFrame([], schema + ", rank long")
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return rows.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= top_k)


def _blocks(queries: DataFrame) -> Iterator[list[tuple]]:
    held: list[tuple] = []
    for r in queries.select("query_id", "embedding").where("embedding IS NOT NULL").toLocalIterator():
        held.append((r["query_id"], r["embedding"]))
        if len(held) == QUERY_BLOCK:
            yield held
            held = []
    if held:
        yield held


def _scored(spark: SparkSession, folder: str, plan: Plan, ids: list, asked: np.ndarray, wanted: np.ndarray, top_k: int, schema: str) -> DataFrame:
    """Each batch's best vectors of the wanted (query, part) pairs; parts that no query wants are not read."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(schema))
    used = np.flatnonzero(wanted.any(axis=0))
    by_part = {plan.parts[p]: np.flatnonzero(wanted[:, p]) for p in used}
    held = spark.sparkContext.broadcast((ids, asked, by_part))

    def run(batches):
        ids, asked, by_part = held.value
        for batch in batches:
            out: tuple[list, list, list] = ([], [], [])
            cell, band = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            names = np.array(batch.column(0).to_pylist())
            m = np.array(batch.column(1).flatten().to_numpy()).reshape(batch.num_rows, -1)
            for part in {*zip(cell.tolist(), band.tolist())}:
                rows, qs = np.flatnonzero((cell == part[0]) & (band == part[1])), by_part.get(part)
                if qs is None:
                    continue
                scores = np.round(m[rows] @ asked[qs].T, 9)
                for j, q in enumerate(qs):
                    best = np.lexsort((names[rows], -scores[:, j]))[:top_k]
                    out[0].extend([ids[q]] * len(best))
                    out[1].extend(names[rows[best]].tolist())
                    out[2].extend(scores[best, j].tolist())
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(out, arrow)], schema=arrow)

    rows = spark.read.parquet(f"{folder}/vectors").select("vec_id", "unit", "cell", "band")
    codes = [(cell + 1) * BANDS + band for cell, band in by_part]
    return rows.where(((F.col("cell") + 1) * BANDS + F.col("band")).isin(codes) if codes else F.lit(False)).mapInArrow(run, schema)
