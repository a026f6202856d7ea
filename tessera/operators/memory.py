"""Long-term memory: decay, catalog upkeep, provenance, context assembly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import normalize_label

#: Decay a day by default, each type's factor of it, the weight of use, and the least weight that is kept (fixed values).
DEFAULT_ALPHA, BETA, MIN_WEIGHT = 0.015, 0.25, 0.01
TYPE_FACTOR = {"speech": 1.0, "frame_caption": 0.8, "user_preference": 0.25, "model_summary": 0.6, "user_verified": 0.15, "derived_insight": 0.5}


#: Of historical context: the least similarity, bonuses for a shared topic, importance and a pin, and at most so many
#: characters (also a share of the current context's) and memories (fixed values).
MIN_SIMILARITY, TOPIC_BONUS, IMPORTANCE_BONUS, PIN_BONUS = 0.35, 0.08, 0.05, 0.05
CONTEXT_CHARS, CONTEXT_SHARE, CONTEXT_ROWS = 4000, 0.43, 4


def add_memories(rows: DataFrame) -> DataFrame:
    """Memories with some content; importance below zero is refused."""
    return rows.where("trim(content) <> '' AND importance >= 0").withColumn("content", F.trim("content")).withColumn("frequency", F.coalesce("frequency", F.lit(1)))


def decay_weight(similarity: Column, age_days: Column, frequency: Column, importance: Column, alpha) -> Column:
    """max(0, similarity) e^(-alpha age) (1 + beta ln(max(1, frequency) + 1)) max(0, importance)."""
    time = F.exp(-alpha * F.greatest(F.lit(0.0), age_days))
    return F.greatest(F.lit(0.0), similarity) * time * (1 + BETA * F.log(F.greatest(F.lit(1), frequency) + 1)) * F.greatest(F.lit(0.0), importance)


def alpha_of(kind: Column, default: float = DEFAULT_ALPHA) -> Column:
    """The decay of a memory's type: its factor of the default; an unknown type decays by the default."""
    table = F.create_map(*[F.lit(x) for k, factor in TYPE_FACTOR.items() for x in (k, default * factor)])
    return F.coalesce(table[kind], F.lit(default))


def cleanup(rows: DataFrame, least: float = MIN_WEIGHT, default: float = DEFAULT_ALPHA) -> DataFrame:
    """The memories whose weight, as if they were a perfect match, is not below ``least``."""
    full = decay_weight(F.lit(1.0), F.col("age"), F.col("frequency"), F.col("importance"), alpha_of(F.col("memory_type"), default))
    return rows.where(full >= least)


def decay_search(rows: DataFrame, key: str, top_k: int, top_n: int) -> DataFrame:
    """(key, memory_id, weight, place): the most similar memories first, then the weightiest of those."""
    w = Window.partitionBy(key)
    near = rows.withColumn("_r", F.row_number().over(w.orderBy(F.desc("similarity"), "memory_id"))).where(F.col("_r") <= top_k)
    ranked = near.withColumn("place", F.row_number().over(w.orderBy(F.desc("weight"), "memory_id")).cast("long")).where(F.col("place") <= top_n)
    return ranked.select(key, "memory_id", F.round("weight", 6).alias("weight"), "place")


def mark_used(items: DataFrame, used: DataFrame, now_us: int) -> DataFrame:
    """Items with the frequency of used ones one higher and their last access now."""
    hit = used.select("memory_id").distinct().withColumn("_hit", F.lit(True))
    rows = items.join(hit, "memory_id", "left")
    return rows.withColumn("frequency", F.col("frequency") + F.when(F.col("_hit"), 1).otherwise(0)).withColumn("last_us", F.when(F.col("_hit"), F.lit(now_us)).otherwise(F.col("last_us"))).drop("_hit")


def assign_topics(labels: DataFrame, manual: DataFrame, key: str = "video_id", most: int = 8) -> DataFrame:
    """(key, topics): distinct normalised labels in order, ``general`` without any; manual topics win. labels: (key, ord, label)."""
    rows = labels.select(key, "ord", F.substring(normalize_label(F.col("label")), 1, 100).alias("label")).where("label <> ''")
    first = rows.groupBy(key, "label").agg(F.min("ord").alias("ord"))
    auto = first.groupBy(key).agg(F.slice(F.transform(F.array_sort(F.collect_list(F.struct("ord", "label"))), lambda x: x["label"]), 1, most).alias("auto"))
    every = labels.select(key).distinct().join(auto, key, "left").join(manual.select(key, F.col("topics").alias("by_hand")), key, "left")
    return every.select(key, F.coalesce("by_hand", "auto", F.array(F.lit("general"))).alias("topics"))


def related_rooms(topics: DataFrame, key: str = "video_id", most: int = 2) -> DataFrame:
    """(key, room, overlap, place): primary topics of other sources that share topics with a source, by the largest overlap.

    topics: (key, topic, pos). Sources of the same topics and the same primary topic behave alike, so they meet as groups:
    distinct topic sets are joined on their topics, and a topic that nearly every source has costs as many rows as there are
    sets that hold it, squared, whatever the number of sources. A group of two or more meets itself too.
    """
    own = topics.groupBy(key).agg(F.array_sort(F.collect_set("topic")).alias("_set"), F.min(F.when(F.col("pos") == 0, F.col("topic"))).alias("room"))
    groups = own.groupBy("_set", "room").agg(F.count("*").alias("_n")).withColumn("_g", F.xxhash64("_set", "room"))
    sides = groups.select("_g", F.explode("_set").alias("topic"))
    other = sides.select(F.col("_g").alias("_o"), "topic")
    shared = sides.join(other, "topic").groupBy("_g", "_o").agg(F.count("*").alias("overlap"))
    met = shared.join(groups.where("room IS NOT NULL").select(F.col("_g").alias("_o"), "room", "_n"), "_o").where((F.col("_g") != F.col("_o")) | (F.col("_n") > 1))
    rooms = met.groupBy("_g", "room").agg(F.max("overlap").alias("overlap"))
    w = Window.partitionBy("_g").orderBy(F.desc("overlap"), "room")
    best = rooms.withColumn("place", F.row_number().over(w).cast("long")).where(F.col("place") <= most)
    return own.select(key, F.xxhash64("_set", "room").alias("_g")).join(best, "_g").select(key, "room", "overlap", "place")


def catalog_sync(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """(id, video_id, active, synced): incoming ids become active, others of their sources inactive; ``synced`` never resets."""
    seen = incoming.select("id", "video_id").distinct()
    videos = seen.select("video_id").distinct().withColumn("_touched", F.lit(True))
    both = stored.join(seen.select("id", F.col("video_id").alias("_v")), "id", "full")
    rows = both.select("id", F.coalesce("video_id", "_v").alias("video_id"), "active", "synced", F.col("_v").isNotNull().alias("_in")).join(videos, "video_id", "left")
    active = F.when(F.col("_in"), True).when(F.col("_touched"), False).otherwise(F.col("active"))
    return rows.select("id", "video_id", active.alias("active"), F.coalesce("synced", F.lit(False)).alias("synced"))


def outbox(pending: DataFrame, key: str, order: str, failed: Column, limit: int) -> DataFrame:
    """The pending rows that get saved: in order, up to the limit, until the first failure."""
    w = Window.partitionBy(key).orderBy(order)
    rows = pending.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= limit)
    bad = F.sum(F.when(failed, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("_bad", bad).where("_bad = 0").drop("_rn", "_bad")


def catalog_stats(rows: DataFrame) -> DataFrame:
    return rows.where("active").agg(F.count("*").alias("active"), F.coalesce(F.sum(F.when(F.col("synced"), 0).otherwise(1)), F.lit(0)).alias("pending"))


def resolve_ids(rows: DataFrame, catalog: DataFrame, text: str) -> DataFrame:
    """Rows whose text names a catalog id that is active and synced."""
    found = rows.withColumn("id", F.regexp_extract(text, r"(vka_[a-f0-9]{24})", 1)).where("id <> ''")
    return found.join(catalog.where("active AND synced").select("id"), "id", "left_semi")


def verify(claims: DataFrame, sources: DataFrame, key: str = "claim_id") -> DataFrame:
    """(key, ok): claims all of whose quoted evidence is still in its source as it was."""
    met = claims.join(sources.select("segment_id", F.col("start_s").alias("_s"), F.col("text").alias("_t")), "segment_id", "left")
    same = F.coalesce((F.col("start_s") == F.col("_s")) & (F.col("quote") == F.col("_t")) & (F.col("quote") != ""), F.lit(False))
    return met.groupBy(key).agg(F.bool_and(same).alias("ok"))


def budget_fill(rows: DataFrame, key: str, budget: int, most: int, per_source: int | None = None) -> DataFrame:
    """(key, picked): ids in order of score that fit the budget, oversized ones skipped, at most ``per_source`` of a source
    and one of each claim. rows: (key, id, score, size, source, claim).

    Each choice depends on those before, so a key's candidates are folded in order. They come sorted by key and score, in
    batches that carry the open key's state along, so no list of a key's candidates is ever held.
    """
    from tessera.operators.fold import fold_rows

    def start():
        return {"used": 0, "picked": [], "sources": {}, "claims": set()}

    def step(state, ids, sizes, sources, claims):
        for i, size, source, claim in zip(ids, sizes, sources, claims):
            if len(state["picked"]) < most and state["used"] + (size or 0) <= budget and claim not in state["claims"] and (per_source is None or state["sources"].get(source, 0) < per_source):
                state["used"] += size or 0
                state["picked"].append(i)
                state["claims"].add(claim)
                state["sources"][source] = state["sources"].get(source, 0) + 1

    schema = f"{key} {rows.schema[key].dataType.simpleString()}, picked array<{rows.schema['id'].dataType.simpleString()}>"
    return fold_rows(rows, key, [(F.col("score"), True), (F.col("id"), False)], ["id", "size", "source", "claim"], start, step, schema, lambda state: ([state["picked"]],))


def historical_context(questions: DataFrame, found: DataFrame, catalog: DataFrame, verified: DataFrame, topics: DataFrame, current_chars: int = 7000, least: float = MIN_SIMILARITY, most: int = CONTEXT_ROWS) -> DataFrame:
    """(question_id, picked): memories of other sources that may support an answer.

    questions: (question_id, video_id); found: (question_id, memory_id, similarity); catalog: (memory_id, video_id,
    importance, pinned, claim, size); verified: (memory_id) whose evidence still stands in its source; topics: (video_id,
    topic). A source's own memories, unknown ones, those below ``least`` and changed ones are left out. The score is the
    similarity and bonuses for a shared topic, importance and a pin; a memory found twice counts by its last score's best.
    At most two of a source and one of each claim fill the budget.
    """
    rows = found.join(questions.withColumnRenamed("video_id", "_asked"), "question_id").join(catalog, "memory_id")
    rows = rows.where((F.col("video_id") != F.col("_asked")) & (F.col("similarity") >= least)).join(verified.select("memory_id").distinct(), "memory_id", "left_semi")
    sets = topics.groupBy("video_id").agg(F.collect_set("topic").alias("t"))
    rows = rows.join(sets.select(F.col("video_id"), F.col("t").alias("_a")), "video_id", "left").join(sets.select(F.col("video_id").alias("_asked"), F.col("t").alias("_b")), "_asked", "left")
    shared = F.coalesce(F.arrays_overlap("_a", "_b"), F.lit(False))
    score = F.col("similarity") + TOPIC_BONUS * shared.cast("int") + IMPORTANCE_BONUS * F.col("importance") + PIN_BONUS * F.col("pinned").cast("int")
    best = rows.withColumn("score", F.round(score, 9)).groupBy("question_id", "memory_id").agg(F.max("score").alias("score"), F.first("size").alias("size"), F.first("video_id").alias("source"), F.first("claim").alias("claim"))
    return budget_fill(best.withColumnRenamed("memory_id", "id"), "question_id", min(CONTEXT_CHARS, int(current_chars * CONTEXT_SHARE)), most, 2)


def promotable(rows: DataFrame) -> DataFrame:
    """Supported, certain, cited claims."""
    return rows.where("status = 'supported' AND uncertainty <= 0.5 AND trim(claim) <> '' AND n_evidence > 0")
