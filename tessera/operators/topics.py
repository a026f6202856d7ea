"""Viewpoints over many sources: clusters, similarity, consensus, change."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.fold import fold_rows
from tessera.operators.retrieve import cosine
from tessera.storage import materialise

CONSENSUS, DISAGREEMENT, LEADER = 0.78, 0.45, 0.72


def cluster_count(n: int) -> int:
    return min(max(2, round(n**0.5)), n) if n else 0


def kmeans_clusters(vectors: DataFrame, k: int | None = None, seed: int = 42) -> DataFrame:
    """(vec_id, cluster): K-means over the embeddings.

    By blocks of vectors: row by row, every iteration sends the distances between all centres to the driver, a task for each centre.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    rows = vectors.select("vec_id", array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))
    model = KMeans(k=k or cluster_count(rows.count()), seed=seed, maxIter=20, solver="block").fit(rows)
    return model.transform(rows).select("vec_id", F.col("prediction").cast("long").alias("cluster"))


#: Vectors of a cluster that one fold takes in a round.
ROUND = 4096


def smallest(rows: DataFrame, key: str, value: str, n) -> DataFrame:
    """(key, cut): the n-th smallest value of each key, the largest if there are fewer; ``n``: a number, or a column of counts by key.

    Every partition sends on its own n smallest numbers only.
    """
    import pyarrow as pa

    kind = rows.schema[key].dataType.simpleString()

    def run(batches):
        import heapq

        held: dict = {}
        for batch in batches:
            for k, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                heap = held.setdefault(k, [])
                if len(heap) < n:
                    heapq.heappush(heap, -v)
                elif -heap[0] > v:
                    heapq.heapreplace(heap, -v)
        flat = [(k, -v) for k, heap in held.items() for v in heap]
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in flat], arrow_kind), pa.array([v for _, v in flat], pa.int64())], names=[key, "v"])

    from pyspark.sql.pandas.types import to_arrow_type

    arrow_kind = to_arrow_type(rows.schema[key].dataType)
    found = rows.select(key, F.col(value).cast("long").alias("v")).mapInArrow(run, f"`{key}` {kind}, v long")
    w = Window.partitionBy(key).orderBy("v")
    return found.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).groupBy(key).agg(F.max("v").alias("cut"))


def leader_clusters(vectors: DataFrame, key: str, threshold: float = LEADER, most: int = ROUND) -> DataFrame:
    """(key, vec_id, leader): in id order, a vector joins the first leader that is near enough, else leads.

    A cluster of up to ``most`` vectors is one fold. Of a larger one, the first ``most`` vectors that are still open are folded, which
    finds their leaders; the others meet these leaders by blocks, join the first one that is near, and what is left goes to the
    next round. So a cluster of any size is dealt over tasks, and no task holds all leaders.
    """
    rows = vectors.select(key, "vec_id", "embedding")
    decided = None
    while True:
        cuts = materialise(smallest(rows, key, "vec_id", most))
        own = rows.alias("r").join(cuts.alias("c"), F.col(f"r.{key}").eqNullSafe(F.col(f"c.{key}"))).select("r.*", (F.col("vec_id") <= F.col("cut")).alias("_now"))
        led = materialise(_fold_leaders(own.where("_now").drop("_now"), key, threshold))
        decided = led if decided is None else decided.unionByName(led)
        rest = materialise(own.where("NOT _now").drop("_now"))
        if rest.isEmpty():
            return decided
        leaders = led.where("vec_id = leader").select(key, "vec_id").alias("l").join(rows.alias("v"), F.col(f"l.{key}").eqNullSafe(F.col(f"v.{key}")) & (F.col("l.vec_id") == F.col("v.vec_id"))).select("v.*")
        joined = materialise(_first_near(rest, leaders, key, threshold))
        decided = decided.unionByName(joined)
        rows = materialise(rest.alias("r").join(joined.alias("j"), F.col(f"r.{key}").eqNullSafe(F.col(f"j.{key}")) & (F.col("r.vec_id") == F.col("j.vec_id")), "left_anti"))
        if rows.isEmpty():
            return decided


def _first_near(rows: DataFrame, leaders: DataFrame, key: str, threshold: float) -> DataFrame:
    """(key, vec_id, leader) of the rows that are near to a leader, the first of those that are."""

    def step(state, ids, y):
        import numpy as np

        leaders, x, _ = state
        near = np.round(x @ y.T, 9) >= threshold
        hit = near.any(axis=0)
        return ids[hit], leaders[near[:, hit].argmax(axis=0)]  # leaders come in the order of their ids

    found = _meet(leaders, rows, key, lambda *held: held, step, "vec_id long, leader long")
    return found.groupBy(key, "vec_id").agg(F.min("leader").alias("leader"))


def _fold_leaders(vectors: DataFrame, key: str, threshold: float) -> DataFrame:
    """The leaders of each key's rows by one fold."""

    def start():
        return {"ids": [], "m": None, "n": 0}

    def step(state, ids, vectors):
        import numpy as np

        out = []
        for i, v in zip(ids, vectors):
            x = np.array(v, dtype=float)
            x = x / (np.linalg.norm(x) or 1.0)
            if state["m"] is None:
                state["m"] = np.zeros((16, len(x)))
            near = np.flatnonzero(np.round(state["m"][: state["n"]] @ x, 9) >= threshold)
            if len(near):
                out.append(state["ids"][int(near[0])])
                continue
            if state["n"] == len(state["m"]):  # twice the room, so that leaders are copied a few times only
                state["m"] = np.concatenate([state["m"], np.zeros_like(state["m"])])
            state["m"][state["n"]] = x
            state["n"] += 1
            state["ids"].append(i)
            out.append(i)
        return ids, out

    return fold_rows(vectors, key, [(F.col("vec_id"), False)], ["vec_id", "embedding"], start, step, f"{key} {vectors.schema[key].dataType.simpleString()}, vec_id long, leader long")


#: Bytes of held vectors that one task takes, pieces that a cluster's streamed vectors are dealt into, and rows that make a piece worth its while.
STRIP_BYTES, PIECES, BLOCK = 1 << 25, 8, 256
#: Products of a tile, and clusters up to which small tables of them are broadcast.
TILE, BROADCAST_KEYS = 1 << 22, 10_000


def _by_key(rows: DataFrame, own: DataFrame, key: str) -> DataFrame:
    """Rows with the columns of a materialised table of one row a key, which is broadcast if it is small."""
    few = own.count() <= BROADCAST_KEYS
    own = own.withColumnRenamed(key, "_k")
    return rows.join(F.broadcast(own) if few else own, rows[key].eqNullSafe(F.col("_k"))).drop("_k")


def cells_of(held: DataFrame, streamed: DataFrame, key: str) -> DataFrame:
    """(key, _i, _j, _side, vec_id, _x, embedding): held vectors (side 0) and streamed ones (1), dealt and sorted by strip and piece.

    A key's held vectors are cut into strips of STRIP_BYTES, its streamed ones into pieces. A streamed vector goes to each strip, a held
    one to each piece: to one and to PIECES, whatever a key's rows, until its held vectors are longer than a strip.
    """
    x = F.col("_x") if "_x" in held.columns else F.lit(0)
    both = held.select(key, "vec_id", "embedding", x.cast("long").alias("_x"), F.lit(0).alias("_side")).unionByName(streamed.select(key, "vec_id", "embedding", F.lit(0).cast("long").alias("_x"), F.lit(1).alias("_side")))
    sizes = both.groupBy(key).agg(F.count_if(F.col("_side") == 0).alias("_h"), F.count_if(F.col("_side") == 1).alias("_t"), F.max(F.size("embedding")).alias("_d")).where("_h > 0 AND _t > 0")
    strips = F.ceil(F.col("_h") * F.greatest("_d", F.lit(1)) * 8 / STRIP_BYTES)
    pieces = F.least(F.ceil(F.col("_t") / BLOCK), F.greatest(F.lit(PIECES).cast("long"), strips))
    dealt = _by_key(both, materialise(sizes.select(key, strips.cast("long").alias("_strips"), pieces.cast("long").alias("_pieces"))), key)
    upto = lambda n: F.sequence(F.lit(0).cast("long"), F.col(n) - 1)
    own = lambda n: F.pmod(F.xxhash64("vec_id"), F.col(n))
    cells = F.when(F.col("_side") == 0, F.transform(upto("_pieces"), lambda j: F.struct(own("_strips").alias("i"), j.alias("j")))).otherwise(F.transform(upto("_strips"), lambda i: F.struct(i.alias("i"), own("_pieces").alias("j"))))
    cells = dealt.withColumn("_c", F.explode(cells)).select(key, F.col("_c.i").alias("_i"), F.col("_c.j").alias("_j"), "_side", "vec_id", "_x", "embedding")
    return cells.repartition(int(held.sparkSession.conf.get("spark.sql.shuffle.partitions")), key, "_i", "_j").sortWithinPartitions(key, "_i", "_j", "_side", "vec_id")


def _meet(held: DataFrame, streamed: DataFrame, key: str, start, step, fields: str, finish=None) -> DataFrame:
    """Rows of (key, fields): every held vector of a key meets every streamed one of it.

    A task gets a strip in the order of its ids and then the rows of a piece (``cells_of``): ``start(ids, unit vectors, what column _x of the
    first says)`` gives its state, ``step(state, ids, unit vectors)`` columns of rows for some streamed ones, ``finish(state)`` more at the end.
    """
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = f"`{key}` {held.schema[key].dataType.simpleString()}, {fields}"
    arrow = to_arrow_schema(StructType.fromDDL(schema))
    cells = cells_of(held, streamed, key)

    def run(batches):
        import numpy as np

        def units(vectors):
            m = vectors.flatten().to_numpy().astype(float).reshape(len(vectors), -1)
            norm = np.linalg.norm(m, axis=1, keepdims=True)
            return m / np.where(norm == 0, 1, norm)

        def put(found):
            if found is not None and len(found[0]):
                yield pa.RecordBatch.from_arrays([pa.array([cell[0]] * len(found[0]), arrow[0].type), *[pa.array(v, f.type) for v, f in zip(found, list(arrow)[1:])]], schema=arrow)

        cell, ids, vectors, extra, state = None, [], [], 0, None
        for batch in batches:
            marks = list(zip(*(batch.column(c).to_pylist() for c in range(4))))
            at = 0
            while at < len(marks):
                end = at + 1
                while end < len(marks) and marks[end] == marks[at]:
                    end += 1
                *now, side = marks[at]
                part = batch.slice(at, end - at)
                at = end
                if cell != now:
                    if state is not None and finish:
                        yield from put(finish(state))
                    cell, ids, vectors, extra, state = now, [], [], part.column(5)[0].as_py(), None
                if side == 0:
                    ids.append(part.column(4).to_numpy())
                    vectors.append(units(part.column(6)))
                    continue
                if not ids:  # a piece that no strip meets
                    continue
                if state is None:
                    a = np.concatenate(ids)
                    state, width = start(a, np.concatenate(vectors), extra), max(1, TILE // len(a))
                    vectors = []
                b, y = part.column(4).to_numpy(), units(part.column(6))
                for k in range(0, len(b), width):
                    yield from put(step(state, b[k : k + width], y[k : k + width]))
        if state is not None and finish:
            yield from put(finish(state))

    return cells.mapInArrow(run, schema)


def pairwise(vectors: DataFrame, key: str, queries: Column) -> DataFrame:
    """(key, a, b, similarity): the similarity of each stated query vector a to every other vector b of its cluster."""

    def step(state, b, y):
        import numpy as np

        a, x, _ = state
        i, j = np.nonzero(a[:, None] != b[None, :])
        return a[i], b[j], (np.round(x @ y.T, 4) + 0.0)[i, j]

    return _meet(vectors.where(queries), vectors, key, lambda *held: held, step, "a long, b long, similarity double")


#: First vectors whose pairs the first round of ``consensus`` looks at; each later one takes four times as many, all that are left after MOST_ROWS.
FIRST_ROWS, MOST_ROWS = 32, 1 << 17
#: The kinds of pairs, and the bits that say which of them a cluster still needs.
KINDS = {"consensus": 1, "disagreement": 2}


class _FirstPairs:
    """The first pairs of each needed kind between a strip, in the order of its ids, and what streams by."""

    def __init__(self, ids, vectors, need: int, most: int):
        self.a, self.x, self.most = ids, vectors, most
        self.kept = {kind: None for kind, bit in KINDS.items() if need & bit}
        self.rows = {kind: len(ids) for kind in self.kept}  # only the first so many ids of the strip can still have one

    def step(self, b, y):
        import numpy as np

        rows = max(self.rows.values(), default=0)
        sims = self.x[:rows] @ y.T
        for kind, rows in self.rows.items():
            part = sims[:rows]
            near = part >= CONSENSUS - 0.001 if kind == "consensus" else part <= DISAGREEMENT + 0.001
            i, j = np.nonzero(near)
            s = np.round(part[i, j], 4) + 0.0
            hit = (s >= CONSENSUS if kind == "consensus" else s <= DISAGREEMENT) & (self.a[i] < b[j])
            if not hit.any():
                continue
            found = (i[hit], b[j[hit]], s[hit])
            if self.kept[kind] is not None:
                found = tuple(np.concatenate(z) for z in zip(self.kept[kind], found))
            first = np.lexsort((found[1], found[0]))[: self.most]
            self.kept[kind] = found = tuple(z[first] for z in found)
            if len(first) == self.most:
                self.rows[kind] = int(found[0][-1]) + 1

    def finish(self):
        import numpy as np

        have = {kind: found for kind, found in self.kept.items() if found is not None}
        if have:
            return [k for k, f in have.items() for _ in f[0]], *(np.concatenate(z) for z in zip(*((self.a[i], b, s) for i, b, s in have.values())))


def consensus(vectors: DataFrame, key: str, most: int = 12, first: int = FIRST_ROWS, seen: dict | None = None) -> DataFrame:
    """(key, kind, a, b, similarity, place): a cluster's first agreeing and first disagreeing pairs a < b, in their order.

    Pairs are visited by their lower id: the first ids of every cluster meet all higher ones, by strips; a cluster that has ``most`` pairs of both
    kinds is done, the others look for what they need with four times as many ids in the next round. A task sends on only its first
    ``most`` of each kind. ``seen`` is told the number of pairs that were compared.
    """
    w = Window.partitionBy(key, "kind").orderBy("a", "b")
    rows = materialise(vectors.select(key, "vec_id", "embedding"))
    open_, found, n = rows.withColumn("_x", F.lit(sum(KINDS.values()))), None, first
    if seen is not None:
        seen["pairs"] = 0
    while True:
        cuts = smallest(open_, key, "vec_id", n) if n <= MOST_ROWS else open_.groupBy(key).agg(F.max("vec_id").alias("cut"))
        cuts = materialise(cuts)
        if found is not None and cuts.isEmpty():
            return found.withColumn("place", F.row_number().over(w).cast("long"))
        own = _by_key(open_, cuts, key)
        now = own.where("vec_id <= cut")
        if seen is not None:
            seen["pairs"] += own.groupBy(key).agg((F.count("*") * F.count_if(F.col("vec_id") <= F.col("cut"))).alias("p")).agg(F.coalesce(F.sum("p"), F.lit(0))).first()[0]
        met = _meet(now, own, key, lambda a, x, need: _FirstPairs(a, x, need, most), _FirstPairs.step, "kind string, a long, b long, similarity double", _FirstPairs.finish)
        met = met if found is None else met.unionByName(found)
        found = materialise(met.withColumn("place", F.row_number().over(w).cast("long")).where(F.col("place") <= most).drop("place"))
        have = F.lit(0)
        for kind, bit in KINDS.items():
            have = have + F.when(F.count_if(F.col("kind") == kind) == most, bit).otherwise(0)
        full = found.groupBy(key).agg(have.alias("_have"))
        state = cuts.alias("c").join(full.alias("f"), F.col(f"c.{key}").eqNullSafe(F.col(f"f.{key}")), "left").select("c.*", (F.lit(sum(KINDS.values())) - F.coalesce("_have", F.lit(0))).alias("_x"))
        open_ = _by_key(rows, materialise(state.where("_x > 0")), key).where("vec_id > cut").drop("cut")
        n *= 4


def author_changes(vectors: DataFrame, key: list[str], order: str) -> DataFrame:
    """(key, vec_id, similarity, change): each viewpoint of an author against the one before."""
    w = Window.partitionBy(*key).orderBy(order)
    rows = vectors.withColumn("_p", F.lag("embedding").over(w)).where("_p IS NOT NULL").withColumn("_s", cosine(F.col("embedding"), F.col("_p")))
    return rows.select(*key, "vec_id", F.round("_s", 4).alias("similarity"), F.when(F.col("_s") >= CONSENSUS, "stable").otherwise("changed").alias("change"))


def describe(texts: DataFrame, key: str, most: int = 5) -> DataFrame:
    """(key, description): the most frequent words of two characters or more, then by spelling."""
    words = texts.select(key, F.explode(F.split(F.translate("text", ",.，。", "    "), r"\s+")).alias("word")).where("length(word) >= 2")
    w = Window.partitionBy(key).orderBy(F.desc("n"), "word")
    top = words.groupBy(key, "word").agg(F.count("*").alias("n")).withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= most)
    return top.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rn", "word"))), lambda x: x["word"]), " / ").alias("description"))


def viewpoints(nodes: DataFrame, segments: DataFrame) -> DataFrame:
    """(video_id, node_id, text): claims with up to three snippets of their evidence; unsupported ones without evidence go."""
    refs = nodes.select("video_id", "node_id", F.posexplode(F.slice("segment_ids", 1, 3)).alias("pos", "segment_id")).join(segments.where("trim(text) <> ''").select("video_id", "segment_id", F.substring("text", 1, 60).alias("snippet")), ["video_id", "segment_id"])
    said = refs.groupBy("video_id", "node_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "snippet"))), lambda x: x["snippet"]), " | ").alias("snippets"))
    rows = nodes.where((F.size("segment_ids") > 0) | (F.col("status") != "unsupported")).join(said, ["video_id", "node_id"], "left")
    return rows.select("video_id", "node_id", F.concat(F.col("claim"), F.when(F.col("snippets").isNotNull(), F.concat(F.lit("\nEvidence: "), "snippets")).otherwise("")).alias("text"))
