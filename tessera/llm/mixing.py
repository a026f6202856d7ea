"""Mixing sources to target weights by a low-discrepancy schedule of equal-word blocks."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import cut, running_before, word_count

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2.0
#: Words in a slot's block: at most, and as a share of the smallest target, since the points of the schedule serve a source
#: to within two slots.
BLOCK_WORDS = 1024
NEAR = 0.005
#: Slots that a schedule may have, at least and for each document: what bounds the blocks from below.
MOST_SLOTS, SLOTS_A_DOCUMENT = 1 << 18, 4
#: The golden ratio's fractional part, times 2**64.
GOLDEN = 11400714819323198485
#: Up to so many sources, their table is broadcast; beyond, it is joined like any other.
BROADCAST_SOURCES = 10_000
SEED = 7


def sized(docs: DataFrame) -> DataFrame:
    """(rid, doc_id, source, size, h): a slim row for each document, in the shared folder; h shuffles."""
    slim = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), F.xxhash64("doc_id", F.lit(SEED)).alias("h"))
    return cut(slim.withColumn("rid", F.monotonically_increasing_id()))


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(sid, source, n, source_size, target): a row for each source.

    sid: its place by code point, null last. Targets split ``share`` of all sizes by the repeating weights; none is
    above ``most`` times its source's size, the excess goes to the others by weight. With the caps sorted by their
    ratio to the weight, the level that fills the rest is the largest of the levels after each cap.
    """
    by_source = sizes.groupBy("source").agg(F.count("*").alias("n"), F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    weight = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.col("sid") - 1, F.lit(len(weights))) + 1).cast("int"))
    own = by_source.withColumn("sid", place).withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(most))
    order = Window.orderBy(F.col("cap") / F.col("weight"), "sid")
    below = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    open_weight = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    everything = Window.partitionBy()
    levels = own.withColumn("level", (F.sum("source_size").over(everything) * F.lit(share) - below) / open_weight)
    target = F.least("cap", F.max("level").over(everything) * F.col("weight"))
    return levels.select("sid", "source", "n", "source_size", target.alias("target"))


def block_size(total: float, smallest: float, documents: int, block_words: int = BLOCK_WORDS) -> int:
    """Words in each block: ``block_words``, or fewer where these are more than NEAR of the smallest target; but so many
    that the slots stay in proportion to the documents."""
    most_slots = max(MOST_SLOTS, SLOTS_A_DOCUMENT * documents)
    return max(1, int(-(-total // most_slots)), min(block_words, int(NEAR * smallest)))


def slot_count(total: float, block: int) -> int:
    """The Fibonacci number of slots whose blocks hold all targets: so many golden-ratio points are nearly as even as a grid."""
    a, b = 1, 2
    while a * block < total:
        a, b = b, a + b
    return a


def point(slot: str = "id", step: int = GOLDEN) -> Column:
    """The slot's point in [0, 1): the fractional part of (slot + 1) steps of step / 2**64, exact for any slot."""
    turns = (F.col(slot) + 1).cast("decimal(18,0)") * F.lit(Decimal(step)).cast("decimal(20,0)")
    return (F.pmod(turns, F.lit(Decimal(1 << 64)).cast("decimal(20,0)")) / F.lit(Decimal(1 << 64)).cast("decimal(20,0)")).cast("double")


def schedule(sources: DataFrame, block_words: int = BLOCK_WORDS, step: int = GOLDEN) -> tuple[DataFrame, int]:
    """((slot, sid, k), words in a slot's block): the source of each slot and the slot's rank k among its source's.

    Slot j's point is the fractional part of (j + 1) golden ratios; the source is the one whose stretch of the cumulative
    targets holds it. The unit interval stands for the words of all slots, a Fibonacci number of blocks, so points past the
    last target fall on no source. A source has target / block slots, give or take two, and any run of slots serves it by
    its share to within a few. Stretches are met through bins of the unit interval, an equi-join.
    """
    spark = sources.sparkSession
    head = sources.where("target > 0").agg(F.sum("target"), F.count("*"), F.min("target"), F.sum("n")).first()
    total, count = float(head[0] or 0), int(head[1])
    block = block_size(total, float(head[2] or 0), int(head[3] or 0), block_words)
    if not total:
        return spark.createDataFrame([], "slot long, sid int, k long"), block
    slots, bins = slot_count(total, block), 4 * count
    w = Window.orderBy("sid")
    upto = F.sum("target").over(w.rowsBetween(Window.unboundedPreceding, 0)) / F.lit(float(slots * block))
    stretch = sources.where("target > 0").select("sid", upto.alias("high")).withColumn("low", F.coalesce(F.lag("high").over(w), F.lit(0.0)))
    binned = stretch.withColumn("bin", F.explode(F.expr(f"sequence(cast(floor(low * {bins}) as bigint), least(cast(floor(high * {bins}) as bigint), {bins - 1}L))")))
    points = spark.range(slots).select(F.col("id").alias("slot"), point("id", step).alias("u"))
    points = points.withColumn("bin", F.least(F.floor(F.col("u") * bins), F.lit(bins - 1)).cast("long"))
    if count <= BROADCAST_SOURCES:
        binned = F.broadcast(binned)
    taken = points.join(binned, "bin").where("u >= low AND u < high").select("slot", "sid")
    chunk = max(64, int(slots**0.5) // 4)
    ranked = running_before(cut(taken).withColumn("chunk", F.floor(F.col("slot") / chunk)), ["sid"], "chunk", ["slot"], F.lit(1), "k")
    return ranked.select("slot", "sid", F.col("k").cast("long").alias("k")), block


def mixture(sizes: DataFrame, sources: DataFrame, block_words: int = BLOCK_WORDS, step: int = GOLDEN) -> DataFrame:
    """(slot, sid, k, rid, words): the words of each document that each slot of the schedule takes.

    A source's documents, shuffled by hash, make a stream that is read again once it ends, ``most`` times at most. The
    source's slot of rank k takes block k of the stream. All blocks have equal words, but for one that the stream's end
    cuts, so what a source gives is the number of its slots in blocks. Positions in the stream are sums by levels over
    hash ranges, so a source of any size is dealt over many tasks.
    """
    head = sources.agg(F.sum("n"), F.count("*")).first()
    per = max(16, int(float(head[0] or 0) ** 0.5) // 4)
    few = int(head[1]) <= BROADCAST_SOURCES
    plan, block = schedule(sources, block_words, step)
    plan = cut(plan)
    slots = plan.groupBy("sid").agg(F.count("*").alias("slots"))
    upto = F.least(F.col("slots") * F.lit(block), F.floor(F.col("source_size") * F.lit(MOST)).cast("long"))
    own = sources.join(slots, "sid").select("sid", "source", "n", "source_size", upto.alias("upto"))
    rows = sizes.where("size > 0").join(F.broadcast(own) if few else own, sizes["source"].eqNullSafe(own["source"])).drop("source")
    buckets = F.ceil(F.col("n") / per)
    rows = rows.withColumn("bucket", F.pmod(F.shiftrightunsigned("h", 8), buckets))
    at = running_before(rows, ["sid"], "bucket", ["h", "doc_id", "size", "rid"], F.col("size"), "at")
    laps = at.withColumn("lap", F.explode(F.expr(f"sequence(0L, {int(-(-MOST // 1)) - 1}L)"))).withColumn("low", F.col("at") + F.col("lap") * F.col("source_size"))
    laps = laps.withColumn("high", F.least(F.col("low") + F.col("size"), "upto")).where("low < high")
    pieces = laps.withColumn("k", F.explode(F.expr(f"sequence(low div {block}L, (high - 1) div {block}L)")))
    pieces = pieces.withColumn("words", F.expr(f"least(high, (k + 1) * {block}L) - greatest(low, k * {block}L)"))
    return plan.join(pieces.select("sid", "k", "rid", "words"), ["sid", "k"])


def taken_words(docs: DataFrame, block_words: int = BLOCK_WORDS, step: int = GOLDEN) -> DataFrame:
    """(rid, doc_id, source, size, source_size, target, taken, first_slot) for every row of docs.

    taken: the words that the slots of the schedule take of it; first_slot: the first of these slots, null without any,
    whose order is that of the mix. A source's taken words are within two blocks of its target: a hundredth, but for sources that are
    so small beside the number of documents that blocks of NEAR of them would be too many. Null and
    blank texts have size 0 and nothing taken; very long ones span blocks; a null source is a source of its own, the last; repeated
    rows are documents of their own; an empty table gives none. Ties of the shuffle are broken by doc_id and size.
    """
    sizes = sized(docs)
    sources = cut(source_targets(sizes))
    few = sources.count() <= BROADCAST_SOURCES
    took = mixture(sizes, sources, block_words, step).groupBy("rid").agg(F.sum("words").alias("taken"), F.min("slot").alias("first_slot"))
    own = sources.select(F.col("source").alias("_source"), "source_size", "target")
    rows = sizes.join(F.broadcast(own) if few else own, sizes["source"].eqNullSafe(F.col("_source"))).drop("_source")
    return rows.join(took, "rid", "left").withColumn("taken", F.coalesce("taken", F.lit(0)).cast("long"))


def mixed(docs: DataFrame) -> DataFrame:
    """The documents as the mix takes them: each as often as its taken words go into its size, to the nearest whole.

    A document cut at the end of its source's last slot counts whole if at least half of it is taken. Rows of one doc_id
    share the count of the one taken most; rows without an id are counted together in the same way.
    """
    copies = taken_words(docs).where("taken > 0").select("doc_id", F.floor(F.col("taken") / F.col("size") + 0.5).cast("int").alias("_n")).where("_n > 0")
    copies = copies.groupBy(F.col("doc_id").alias("_id")).agg(F.max("_n").alias("_n"))
    rows = docs.join(copies, docs["doc_id"].eqNullSafe(F.col("_id"))).drop("_id")
    return rows.withColumn("_copy", F.explode(F.sequence(F.lit(1), "_n"))).drop("_copy", "_n")
