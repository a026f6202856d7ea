"""Queries of segmentation, frames, evidence contracts and storylines."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions import tables
from tessera.functions import text as T
from tessera.operators import contract as C
from tessera.operators import frames as V
from tessera.operators import intervals as I
from tessera.operators import segment as S
from tessera.operators import story as N
from tessera.plans.q_text import ANCHORS_SQL, LOOKS_SQL
from tessera.plans.registry import query
from tessera.sources import fixtures as X
from tessera.sources.fixtures import sql
from tessera.storage import new_folder
from tessera.streaming import analysis as A

_MARK = " OR ".join(f"contains(lower(text), '{m}')" for m in T.TOPIC_MARKERS)


def _seconds(items):
    return items.withColumn("start_s", F.col("start_ms") / 1000).withColumn("end_s", F.col("end_ms") / 1000)


def _fold_sql(gap: bool, chars: int, cut: int | None) -> str:
    """The segment fold as a recursion over each source's items."""
    silent = " OR o.start_ms - f.prev_end > 4000" if gap else ""
    split = f"(o.end_ms - f.begin >= 120000 OR (o.end_ms - f.begin >= 60000 AND o.marked) OR f.size + o.len > {chars}{silent})"
    text = "string_agg(trim(text), ' ' ORDER BY rn)"
    return f"""o AS (SELECT video_id, item_ord, start_ms, end_ms, speaker, asr_confidence, text, length(text) AS len, {_MARK} AS marked, row_number() OVER (PARTITION BY video_id ORDER BY item_ord) AS rn FROM items WHERE trim(text) <> ''),
    f AS (SELECT video_id, rn, 0::BIGINT AS segment, start_ms AS begin, len AS size, end_ms AS prev_end FROM o WHERE rn = 1
      UNION ALL SELECT o.video_id, o.rn, f.segment + CASE WHEN {split} THEN 1 ELSE 0 END, CASE WHEN {split} THEN o.start_ms ELSE f.begin END, CASE WHEN {split} THEN o.len ELSE f.size + 1 + o.len END, o.end_ms
      FROM f JOIN o ON o.video_id = f.video_id AND o.rn = f.rn + 1),
    seg AS (SELECT video_id, segment, min(start_ms) / 1000.0::DOUBLE AS start_s, max(end_ms) / 1000.0::DOUBLE AS end_s, count(*) AS n_items, avg(asr_confidence) AS asr_confidence, arg_min({{'s': speaker}}, rn).s AS speaker, {text} AS whole, {f"substr({text}, 1, {cut})" if cut else text} AS text FROM f JOIN o USING (video_id, rn) GROUP BY 1, 2)"""


_SEG = _fold_sql(True, 1000, None)
_KEYWORDS = """, words AS (SELECT video_id, segment, lower(unnest(regexp_extract_all(whole, '[A-Za-z][A-Za-z0-9_-]{2,}|[\\x{4e00}-\\x{9fff}]{2,}'))) AS word FROM seg),
    counted AS (SELECT video_id, segment, word, row_number() OVER (PARTITION BY video_id, segment ORDER BY count(*) DESC, word) AS place FROM words WHERE word NOT IN ('这个', '我们', '一个', '以及', '然后', '所以', 'the', 'and', 'that', 'with', 'for') GROUP BY video_id, segment, word),
    kw AS (SELECT video_id, segment, string_agg(word, ' ' ORDER BY place) AS keywords FROM counted WHERE place <= 8 GROUP BY 1, 2)"""


def _segments(spark, d):
    return S.merge_segments(_seconds(X.items(spark, d).where("trim(text) <> ''"))).drop("speaker", "asr_confidence")


@query("c_segment_transcript", sql("items", _fold_sql(False, 1800, 1800).replace("FROM items WHERE", "FROM (SELECT * REPLACE (trim(regexp_replace(text, '\\s+', ' ', 'g')) AS text) FROM items) i WHERE") + _KEYWORDS + " SELECT video_id, segment, printf('seg_%04d', segment) AS segment_id, start_s, end_s, n_items, text, speaker, asr_confidence, coalesce(keywords, '') AS keywords FROM seg LEFT JOIN kw USING (video_id, segment)", True))
def c_segment_transcript(spark, d):
    rows = S.segment_transcript(_seconds(X.items(spark, d)))
    return rows.drop("entities").withColumn("keywords", F.array_join("keywords", " "))


@query("m_live_segments", sql("items", _fold_sql(False, 1800, 1800).replace("FROM items WHERE", "FROM (SELECT * REPLACE (trim(regexp_replace(text, '\\s+', ' ', 'g')) AS text) FROM items) i WHERE") + " SELECT video_id, segment, start_s, end_s, n_items, text FROM seg", True))
def m_live_segments(spark, d):
    """The conversations as they come in, file by file: ingested by one stream, segmented by another."""
    return _live(spark, d, A.segments)


@query("m_live_snapshots", sql("items", _fold_sql(False, 1800, 1800).replace("FROM items WHERE", "FROM (SELECT * REPLACE (trim(regexp_replace(text, '\\s+', ' ', 'g')) AS text) FROM items) i WHERE") + " SELECT video_id, count(*) AS n_segments, max(m) + 1 AS next_ord, 'succeeded' AS status FROM seg JOIN (SELECT video_id, max(item_ord) AS m FROM items GROUP BY 1) l USING (video_id) GROUP BY 1", True))
def m_live_snapshots(spark, d):
    return _live(spark, d, A.snapshots).select("video_id", "n_segments", "next_ord", "status")


@query("r_udtf_segments", sql("items", _fold_sql(False, 1800, 1800).replace("FROM items WHERE", "FROM (SELECT * REPLACE (trim(regexp_replace(text, '\\s+', ' ', 'g')) AS text) FROM items) i WHERE") + " SELECT video_id, segment, start_s, end_s, n_items, text FROM seg", True))
def r_udtf_segments(spark, d):
    """Segmentation as a table function in SQL."""
    tables.register(spark)
    rows = _seconds(X.items(spark, d)).withColumn("text", T.normalize_asr(F.col("text")))
    return spark.sql("SELECT * FROM ev_segment(TABLE(SELECT video_id, item_ord, start_s, end_s, text FROM {rows}), key => 'video_id', ord => 'item_ord')", rows=rows)


@query("r_udtf_top", "SELECT event_type, event_id, value, rank FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS rank FROM events) e WHERE rank <= 7")
def r_udtf_top(spark, d):
    """The first rows of each partition as a table function in SQL."""
    tables.register(spark)
    return spark.sql("SELECT event_type, event_id, value, rank FROM ev_top(TABLE(SELECT event_type, event_id, value FROM {rows}) PARTITION BY event_type ORDER BY (value DESC, event_id), k => 7)", rows=X.table(spark, d, "events"))


def _live(spark, d, read):
    items = _seconds(X.items(spark, d)).select("video_id", F.col("item_ord").cast("long").alias("item_ord"), "start_s", "end_s", "text")
    kind, folder = dict(items.dtypes)["video_id"], new_folder(spark, "live")
    A.land(items, f"{folder}/landing")
    landed = spark.readStream.schema(A.ITEM.format(kind=kind)).option("maxFilesPerTrigger", 3).parquet(f"{folder}/landing")
    A.ingest(landed, folder, f"{folder}/ingested").awaitTermination()
    A.run_analysis(spark, folder, f"{folder}/analysed", kind, first=items.agg(F.min("item_ord")).first()[0] or 0).awaitTermination()
    return read(spark, folder)


@query("c_merge_segments", sql("items", _SEG + " SELECT video_id, segment, printf('seg_%04d', segment) AS segment_id, start_s, end_s, n_items, text FROM seg", True))
def c_merge_segments(spark, d):
    return _segments(spark, d)


@query("c_silence_sessions", sql("items", "g AS (SELECT *, CASE WHEN start_ms - lag(end_ms) OVER (PARTITION BY video_id ORDER BY start_ms, end_ms) > 4000 THEN 1 ELSE 0 END AS nw FROM items), s AS (SELECT *, CAST(sum(nw) OVER (PARTITION BY video_id ORDER BY start_ms, end_ms ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session FROM g) SELECT video_id, session, min(start_ms) AS start_ms, max(end_ms) AS end_ms, count(*) AS n FROM s GROUP BY 1, 2"))
def c_silence_sessions(spark, d):
    return S.silence_sessions(X.items(spark, d), "video_id", "start_ms", "end_ms", 4000)


def _aligned(spark, d):
    items = X.items(spark, d).select("video_id", F.col("item_ord").alias("segment"), (F.col("start_ms") / 1000).alias("start_s"), (F.col("end_ms") / 1000).alias("end_s"))
    return S.align_frames(items, X.frames(spark, d).withColumn("ts_s", F.col("ts_ms") / 1000))


_ALIGN = "al AS (SELECT i.video_id, i.item_ord AS segment, i.start_ms, i.end_ms, f.frame_id, f.ts_ms, f.selected FROM items i JOIN frames f ON f.video_id = i.video_id AND f.ts_ms BETWEEN i.start_ms AND i.end_ms)"


@query("c_align_frames", sql("items frames", _ALIGN + " SELECT video_id, segment, frame_id, ts_ms / 1000.0::DOUBLE AS ts_s FROM al"))
def c_align_frames(spark, d):
    return _aligned(spark, d).select("video_id", "segment", "frame_id", "ts_s")


@query("c_representative", sql("items frames", _ALIGN + ", s AS (SELECT *, row_number() OVER (PARTITION BY video_id, segment, selected ORDER BY ts_ms, frame_id) AS rs, row_number() OVER (PARTITION BY video_id, segment ORDER BY abs(2 * ts_ms - start_ms - end_ms), ts_ms, frame_id) AS rn FROM al) SELECT video_id, segment, coalesce(string_agg(frame_id::VARCHAR, ',' ORDER BY rs) FILTER (WHERE selected AND rs <= 3), max(frame_id::VARCHAR) FILTER (WHERE rn = 1)) AS frames FROM s GROUP BY 1, 2"))
def c_representative(spark, d):
    return S.representative_frames(_aligned(spark, d)).select("video_id", "segment", F.array_join(F.transform("frames", lambda x: x.cast("string")), ",").alias("frames"))


@query("c_refined_text_segment", sql("items", "r AS (SELECT DISTINCT video_id, k AS range_id, k * 90000 AS r0, k * 90000 + 30000 AS r1 FROM items, generate_series(0, 3) g(k)) SELECT i.video_id, range_id, min(start_ms) / 1000.0::DOUBLE AS start_s, max(end_ms) / 1000.0::DOUBLE AS end_s, string_agg(text, ' ' ORDER BY start_ms, item_ord) AS text FROM r JOIN items i ON i.video_id = r.video_id AND i.start_ms <= r.r1 AND i.end_ms >= r.r0 GROUP BY 1, 2"))
def c_refined_text_segment(spark, d):
    items = _seconds(X.items(spark, d)).select("video_id", F.col("item_ord").alias("segment"), "start_s", "end_s", "text")
    ranges = items.select("video_id").distinct().withColumn("range_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(3).cast("long"))))
    return S.refined_text(items, ranges.withColumn("start_s", F.col("range_id") * 90.0).withColumn("end_s", F.col("range_id") * 90.0 + 30))


@query("c_sanitize", sql("items", "SELECT video_id, item_ord, CASE WHEN trim(text) <> '' THEN 'speech,frame' ELSE 'frame' END AS types FROM items"))
def c_sanitize(spark, d):
    return X.items(spark, d).select("video_id", "item_ord", F.array_join(S.evidence_types(F.col("text"), F.lit(True), F.lit("")), ",").alias("types"))


@query("d_hamming", sql("frames", "p AS (SELECT video_id, frame_id, phash, lag(phash) OVER (PARTITION BY video_id ORDER BY ts_ms) AS prev FROM frames) SELECT video_id, frame_id, bit_count(xor(('0x' || phash)::UBIGINT, ('0x' || prev)::UBIGINT))::BIGINT AS bits FROM p WHERE prev IS NOT NULL"))
def d_hamming(spark, d):
    w = Window.partitionBy("video_id").orderBy("ts_ms")
    rows = X.frames(spark, d).withColumn("prev", F.lag("phash").over(w)).where("prev IS NOT NULL")
    return rows.select("video_id", "frame_id", V.hamming(F.col("phash"), F.col("prev")).alias("bits"))


@query("d_dedupe_frames", sql("frames", "o AS (SELECT video_id, frame_id, ts_ms, phash, row_number() OVER (PARTITION BY video_id ORDER BY ts_ms, frame_id) AS rn FROM frames), f AS (SELECT video_id, rn, frame_id, true AS kept, [{'t': ts_ms, 'h': phash}] AS recent FROM o WHERE rn = 1 UNION ALL SELECT o.video_id, o.rn, o.frame_id, NOT dup, CASE WHEN dup THEN near ELSE list_append(near, {'t': o.ts_ms, 'h': o.phash}) END FROM (SELECT o.*, list_filter(f.recent, lambda r: o.ts_ms - r.t <= 1500) AS near, len(list_filter(f.recent, lambda r: o.ts_ms - r.t <= 1500 AND bit_count(xor(('0x' || r.h)::UBIGINT, ('0x' || o.phash)::UBIGINT)) <= 3)) > 0 AS dup FROM f JOIN o ON o.video_id = f.video_id AND o.rn = f.rn + 1) o) SELECT video_id, frame_id FROM f WHERE kept", True))
def d_dedupe_frames(spark, d):
    return V.dedupe_frames(X.frames(spark, d)).select("video_id", "frame_id")


def _named(spark, d):
    return _aligned(spark, d).withColumn("segment_id", F.format_string("seg_%04d", "segment"))


def _minimum(spark, d, chosen):
    segments = _seconds(X.items(spark, d)).select("video_id", F.col("item_ord").alias("segment"), "start_s", "end_s")
    return V.with_minimum(chosen, segments, X.frames(spark, d).withColumn("ts_s", F.col("ts_ms") / 1000))


@query("d_keyframes")
def d_keyframes(spark, d):
    return _minimum(spark, d, V.keyframes(_named(spark, d)))


@query("d_keyframes_random")
def d_keyframes_random(spark, d):
    return _minimum(spark, d, V.keyframes(_named(spark, d), strategy="random"))


@query("d_average_hash")
def d_average_hash(spark, d):
    """Vectors as grey pictures of 8 x 8 pixels."""
    pixels = F.to_binary(F.array_join(F.transform("embedding", lambda x: F.lpad(F.hex(F.least(F.lit(255), F.greatest(F.lit(0), F.floor((x + 1) * 127.5))).cast("long")), 2, "0")), ""), F.lit("hex"))
    e = X.table(spark, d, "embeddings").select("vec_id", pixels.alias("pixels"), F.lit(8).alias("wide"), F.lit(8).alias("high"))
    return V.image_hashes(e).select("vec_id", "phash")


@query("d_nearest_frame", sql("items frames", _ALIGN + ", s AS (SELECT *, row_number() OVER (PARTITION BY video_id, segment ORDER BY abs(2 * ts_ms - start_ms - end_ms), ts_ms, frame_id) AS rn FROM al) SELECT video_id, segment, frame_id FROM s WHERE rn = 1"))
def d_nearest_frame(spark, d):
    return V.nearest_frame(_aligned(spark, d))


@query("d_random_timestamps")
def d_random_timestamps(spark, d):
    return V.random_timestamps(X.items(spark, d).groupBy("video_id").agg((F.max("end_ms") / 1000).alias("duration")), "video_id", "duration", 4)


_DUR = "v AS (SELECT video_id, max(end_ms) / 1000.0::DOUBLE AS duration FROM items GROUP BY 1)"


def _videos(spark, d):
    return X.items(spark, d).groupBy("video_id").agg((F.max("end_ms") / 1000).alias("duration"))


@query("d_probe_timestamps", sql("items", _DUR + " SELECT video_id, i, round(duration * (i + 0.5::DOUBLE) / 8, 6) AS ts_s FROM v, generate_series(0, 7) g(i)"))
def d_probe_timestamps(spark, d):
    return V.probe_timestamps(_videos(spark, d), "video_id", "duration", 8).withColumn("ts_s", F.round("ts_s", 6))


@query("d_motion_score", "WITH p AS (SELECT label, [x::DOUBLE for x in embedding] AS e, lag([x::DOUBLE for x in embedding]) OVER (PARTITION BY label ORDER BY vec_id) AS q FROM embeddings) SELECT CAST(label AS BIGINT) AS video_id, round(least(1.0, coalesce(avg(list_sum([abs(e[i] - q[i]) for i in generate_series(1, len(e))]) / len(e)), 0) * 2.8::DOUBLE), 6) AS motion FROM p GROUP BY label")
def d_motion_score(spark, d):
    e = X.table(spark, d, "embeddings").select(F.col("label").cast("long").alias("video_id"), "vec_id", "embedding")
    return V.motion_scores(e, "video_id", "vec_id", "embedding").withColumn("motion", F.round("motion", 6))


@query("d_visual_profile", "SELECT l_orderkey, l_linenumber, round(s, 6) AS strength, CASE WHEN s >= 0.48 THEN 'strong' ELSE 'weak' END AS class FROM (SELECT l_orderkey, l_linenumber, least(1.0, greatest(0.0, 0.36::DOUBLE * (l_quantity / 50.0::DOUBLE) + 0.32::DOUBLE * (l_discount * 10.0::DOUBLE) + 0.18::DOUBLE * (l_tax * 10.0::DOUBLE) + 0.14::DOUBLE * 0.5 - 0.08::DOUBLE * 0.25)) AS s FROM lineitem) x")
def d_visual_profile(spark, d):
    """Shares of order lines as the scores of a video."""
    share = lambda c, k: F.col(c).cast("double") * k
    s = V.visual_strength(F.col("l_quantity").cast("double") / 50.0, share("l_discount", 10.0), share("l_tax", 10.0), F.lit(0.5), F.lit(0.25))
    return X.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(s, 6).alias("strength"), V.visual_class(s).alias("class"))


@query("d_correlation_level", "SELECT user_id, a AS avg, CASE WHEN a < 0.2 THEN 'low' WHEN a < 0.8 THEN 'medium' ELSE 'high' END AS level, CASE WHEN a < 0.2 THEN 60.0::DOUBLE WHEN a < 0.8 THEN 2.0 ELSE 1.0 END AS frame_interval, CASE WHEN a < 0.2 THEN 2::BIGINT WHEN a < 0.8 THEN 5 ELSE 10 END AS refine_frames, CASE WHEN a < 0.2 THEN 'random' ELSE 'default' END AS strategy FROM (SELECT user_id, round(avg((event_id % 9) / 8.0::DOUBLE), 6) AS a FROM events GROUP BY 1) x")
def d_correlation_level(spark, d):
    e = X.table(spark, d, "events").select("user_id", (F.col("event_id") % 9 / 8).alias("score"))
    return V.correlation_profile(e, "user_id", "score")


@query("d_text_at_timestamp", sql("items", "p AS (SELECT DISTINCT video_id, k * 40.25::DOUBLE AS at_s FROM items, generate_series(0, 9) g(k)), c AS (SELECT p.video_id, at_s, item_ord, start_ms / 1000.0::DOUBLE AS s, end_ms / 1000.0::DOUBLE AS e FROM p JOIN items USING (video_id)), r AS (SELECT *, row_number() OVER (PARTITION BY video_id, at_s ORDER BY CASE WHEN at_s BETWEEN s AND e THEN 0 ELSE 1 END, CASE WHEN at_s BETWEEN s AND e THEN 0 ELSE least(abs(at_s - s), abs(at_s - e)) END, s, item_ord) AS rn FROM c) SELECT video_id, at_s, item_ord FROM r WHERE rn = 1"))
def d_text_at_timestamp(spark, d):
    items = _seconds(X.items(spark, d)).select("video_id", "item_ord", "start_s", "end_s")
    points = items.select("video_id").distinct().withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(9)))).select("video_id", (F.col("k") * 40.25).alias("at_s"))
    return I.nearest_interval(points, items, "at_s", ("start_s", "end_s"), ["video_id"], "item_ord").select("video_id", "at_s", "item_ord")


@query("d_refined_timestamps", sql("items", "r AS (SELECT video_id, item_ord, start_ms / 1000.0::DOUBLE AS a, end_ms / 1000.0::DOUBLE AS b FROM items), n AS (SELECT *, CASE WHEN b <= a THEN 1 ELSE least(10, greatest(3, floor(b - a)::INT + 1)) END AS n FROM r) SELECT video_id, item_ord, i, round(a + (b - a) / greatest(n - 1, 1) * i, 6) AS ts_s FROM n, generate_series(0, 9) g(i) WHERE i < n"))
def d_refined_timestamps(spark, d):
    return V.refined_timestamps(_seconds(X.items(spark, d)), ["video_id", "item_ord"], "start_s", "end_s").withColumn("ts_s", F.round("ts_s", 6))


@query("d_stratified_select", sql("frames", "n AS (SELECT video_id, frame_id, row_number() OVER (PARTITION BY video_id ORDER BY ts_ms, frame_id) - 1 AS pos, count(*) OVER (PARTITION BY video_id) AS n FROM frames), e AS (SELECT DISTINCT video_id, round_even(i * n / 7.0, 0)::BIGINT AS l, round_even((i + 1) * n / 7.0, 0)::BIGINT AS r FROM n, generate_series(0, 6) g(i)) SELECT DISTINCT n.video_id, frame_id FROM n JOIN e USING (video_id) WHERE pos = l + (greatest(l + 1, r) - l) // 2"))
def d_stratified_select(spark, d):
    return V.stratified_select(X.frames(spark, d), "video_id", ["ts_ms", "frame_id"], 7).select("video_id", "frame_id")


@query("d_refine_attach", sql("items frames", _ALIGN + ", h AS (SELECT * FROM al WHERE start_ms % 2 = 0) SELECT video_id, segment, string_agg(DISTINCT frame_id::VARCHAR, ',' ORDER BY frame_id::VARCHAR) AS frames, count(DISTINCT frame_id) AS n FROM h GROUP BY 1, 2"))
def d_refine_attach(spark, d):
    rows = _aligned(spark, d).where(F.round(F.col("start_s") * 1000).cast("long") % 2 == 0).groupBy("video_id", "segment").agg(F.array_sort(F.collect_set(F.col("frame_id").cast("string"))).alias("f"))
    return rows.select("video_id", "segment", F.array_join("f", ",").alias("frames"), F.size("f").cast("long").alias("n"))


@query("d_refine_trigger", sql("asked", f"SELECT question_id, {LOOKS_SQL} OR question_id % 5 = 0 AS refine FROM asked"))
def d_refine_trigger(spark, d):
    from tessera.functions.routing import needs_visual

    return X.asked(spark, d).select("question_id", (needs_visual(F.col("question")) | (F.col("question_id") % 5 == 0)).alias("refine"))


@query("d_fps_policy", sql("items", _DUR + " SELECT video_id, CASE video_id % 3 WHEN 0 THEN 0.016667 WHEN 1 THEN 0.5 ELSE 1.0 END::DOUBLE AS fps, least(600, ceil(duration * CASE video_id % 3 WHEN 0 THEN 1.0::DOUBLE / 60 WHEN 1 THEN 0.5 ELSE 1.0 END))::BIGINT AS max_frames FROM v"))
def d_fps_policy(spark, d):
    level = F.element_at(F.array(F.lit("low"), F.lit("medium"), F.lit("high")), (F.col("video_id") % 3 + 1).cast("int"))
    return _videos(spark, d).select("video_id", V.fps_policy(level, F.col("duration")).alias("p")).select("video_id", F.round("p.fps", 6).alias("fps"), "p.max_frames")


@query("d_fact_frame_rank", sql("query_texts", "q AS (SELECT DISTINCT query_id, lower(unnest(regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_.-]*|[0-9]+(?:\\.[0-9]+)?'))) AS term FROM query_texts), c AS (SELECT DISTINCT doc_id, lower(unnest(regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_.-]*|[0-9]+(?:\\.[0-9]+)?'))) AS term FROM documents), h AS (SELECT query_id, doc_id, count(*) AS hits FROM q JOIN c USING (term) GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY hits DESC, doc_id) AS rank FROM h) SELECT query_id AS question_id, doc_id AS frame_id, hits, rank FROM r WHERE rank <= 3"))
def d_fact_frame_rank(spark, d):
    q = X.query_texts(spark, d).select(F.col("query_id").alias("question_id"), F.col("text").alias("question"))
    return V.term_overlap_rank(q, X.table(spark, d, "documents").select(F.col("doc_id").alias("frame_id"), F.col("text").alias("caption")))


# --- evidence and ranges ------------------------------------------------------------------------------------------


@query("g_time_constrained", sql("items", "c AS (SELECT DISTINCT video_id, k * 100.0::DOUBLE AS at_s FROM items, generate_series(0, 3) g(k)) SELECT DISTINCT c.video_id, at_s, item_ord FROM c JOIN items i USING (video_id) WHERE greatest(0, i.start_ms / 1000.0 - at_s, at_s - i.end_ms / 1000.0) <= 90"))
def g_time_constrained(spark, d):
    items = _seconds(X.items(spark, d)).select("video_id", "item_ord", "start_s", "end_s")
    at = items.select("video_id").distinct().withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(3)))).select("video_id", (F.col("k") * 100.0).alias("at_s"))
    return I.point_join(at, items, "at_s", ("start_s", "end_s"), ["video_id"], 60.0, 90.0).select("video_id", "at_s", "item_ord")


@query("g_time_band", sql("items", "c AS (SELECT DISTINCT video_id, k * 100.0::DOUBLE AS at_s FROM items, generate_series(0, 3) g(k)), m AS (SELECT c.video_id, at_s, item_ord, greatest(0, start_ms / 1000.0::DOUBLE - at_s, at_s - end_ms / 1000.0::DOUBLE) AS dist, start_ms FROM c JOIN items USING (video_id)) SELECT video_id, at_s, item_ord, round(1 - dist / 90, 6) AS score, row_number() OVER (PARTITION BY video_id, at_s ORDER BY round(1 - dist / 90, 6) DESC, start_ms, item_ord) AS rank FROM m WHERE dist <= 90"))
def g_time_band(spark, d):
    items = _seconds(X.items(spark, d)).select("video_id", "item_ord", "start_s", "end_s")
    at = items.select("video_id").distinct().withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(3)))).select("video_id", (F.col("k") * 100.0).alias("at_s"))
    rows = I.point_join(at, items, "at_s", ("start_s", "end_s"), ["video_id"], 60.0, 90.0)
    far = F.greatest(F.lit(0.0), F.col("start_s") - F.col("at_s"), F.col("at_s") - F.col("end_s"))
    rows = rows.withColumn("score", F.round(1 - far / 90, 6))
    w = Window.partitionBy("video_id", "at_s").orderBy(F.desc("score"), "start_s", "item_ord")
    return rows.select("video_id", "at_s", "item_ord", "score", F.row_number().over(w).cast("long").alias("rank"))


@query("h_interval_join", sql("ranges", "SELECT a.key, a.event_id AS left_id, b.event_id AS right_id FROM ranges a JOIN ranges b ON a.key = b.key AND a.start_s <= b.end_s AND b.start_s <= a.end_s AND a.event_id < b.event_id"))
def h_interval_join(spark, d):
    r = X.ranges(spark, d)
    right = r.select("key", F.col("event_id").alias("right_id"), F.col("start_s").alias("s2"), F.col("end_s").alias("e2"))
    met = I.interval_join(r.withColumnRenamed("event_id", "left_id"), right, ("start_s", "end_s"), ("s2", "e2"), ["key"], 3600)
    return met.where("left_id < right_id").select("key", "left_id", "right_id")


@query("h_merge_ranges", sql("ranges", "g AS (SELECT *, CASE WHEN start_s > max(end_s) OVER (PARTITION BY key ORDER BY start_s, end_s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 2 THEN 1 ELSE 0 END AS nw FROM ranges), s AS (SELECT *, sum(nw) OVER (PARTITION BY key ORDER BY start_s, end_s ROWS UNBOUNDED PRECEDING) AS island FROM g) SELECT key, min(start_s) AS start_s, max(end_s) AS end_s, count(*) AS n FROM s GROUP BY key, island"))
def h_merge_ranges(spark, d):
    return I.merge_ranges(X.ranges(spark, d), "key", "start_s", "end_s")


@query("h_agreement", sql("items", "a AS (SELECT video_id, list(DISTINCT item_ord) FILTER (WHERE item_ord % 2 = 0) AS x, list(DISTINCT item_ord) FILTER (WHERE item_ord % 3 = 0) AS y FROM items GROUP BY 1) SELECT video_id, round(CASE WHEN coalesce(len(x), 0) = 0 OR coalesce(len(y), 0) = 0 THEN 0 ELSE len(list_intersect(x, y)) / least(len(x), len(y))::DOUBLE END, 6) AS agreement FROM a"))
def h_agreement(spark, d):
    a = X.items(spark, d).groupBy("video_id").agg(F.collect_set(F.when(F.col("item_ord") % 2 == 0, F.col("item_ord"))).alias("x"), F.collect_set(F.when(F.col("item_ord") % 3 == 0, F.col("item_ord"))).alias("y"))
    return a.select("video_id", F.round(C.overlap_coefficient(F.col("x"), F.col("y")), 6).alias("agreement"))


_SIDES = "l AS (SELECT video_id, item_ord AS id, start_ms, end_ms FROM items WHERE item_ord % 2 = 0), r AS (SELECT video_id, start_ms + 3000 AS start_ms, end_ms + 3000 AS end_ms FROM items WHERE item_ord % 3 = 0), nl AS (SELECT video_id, count(*) AS nl FROM l GROUP BY 1), nr AS (SELECT video_id, count(*) AS nr FROM r GROUP BY 1), hit AS (SELECT l.video_id, count(DISTINCT id) AS hit FROM l JOIN r ON l.video_id = r.video_id AND l.start_ms <= r.end_ms AND r.start_ms <= l.end_ms GROUP BY 1)"


def _sides(spark, d):
    items = _seconds(X.items(spark, d))
    left = items.where("item_ord % 2 = 0").select("video_id", F.col("item_ord").alias("id"), "start_s", "end_s")
    return left, items.where("item_ord % 3 = 0").select("video_id", (F.col("start_s") + 3).alias("start_s"), (F.col("end_s") + 3).alias("end_s"))


@query("h_time_overlap", sql("items", _SIDES + " SELECT video_id, round(coalesce(hit, 0) / least(nl, nr)::DOUBLE, 6) AS score FROM nl JOIN nr USING (video_id) LEFT JOIN hit USING (video_id)"))
def h_time_overlap(spark, d):
    return C.time_overlap(*_sides(spark, d), "video_id").withColumn("score", F.round("score", 6))


@query("h_agreement_mm", sql("items", _SIDES + ", t AS (SELECT video_id, coalesce(hit, 0) / least(nl, nr)::DOUBLE AS score FROM nl JOIN nr USING (video_id) LEFT JOIN hit USING (video_id)), m AS (SELECT video_id, round(greatest(0, least(1, 0.5::DOUBLE * 0.5 + 0.3::DOUBLE * score + 0.2::DOUBLE * 0.4)), 6) AS agreement FROM t) SELECT video_id, agreement, CASE WHEN agreement >= 0.6 THEN 'high' WHEN agreement >= 0.3 THEN 'medium' ELSE 'low' END AS confidence FROM m"))
def h_agreement_mm(spark, d):
    t = C.time_overlap(*_sides(spark, d), "video_id")
    rows = t.select("video_id", F.round(C.agreement(F.lit(0.5), F.col("score"), F.lit(0.4)), 6).alias("agreement"))
    return rows.withColumn("confidence", C.confidence(F.col("agreement")))


@query("h_confidence", "WITH l AS (SELECT l_orderkey, l_linenumber, l_quantity / 50.0::DOUBLE AS a, l_tax * 10.0::DOUBLE AS b FROM lineitem) SELECT l_orderkey, l_linenumber, CASE WHEN least(a, b) >= 0.6 THEN 'high' WHEN least(a, b) >= 0.3 THEN 'medium' ELSE 'low' END AS confidence FROM l")
def h_confidence(spark, d):
    """Shares of order lines as a model's score and the agreement; the weaker level of both."""
    a, b = F.col("l_quantity").cast("double") / 50.0, F.col("l_tax").cast("double") * 10.0
    return X.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", C.weaker(C.confidence(a), C.confidence(b)).alias("confidence"))


@query("h_target_ranges", sql("items", "a AS (SELECT DISTINCT video_id, k * 100.0::DOUBLE AS at_s FROM items, generate_series(1, 2) g(k) WHERE video_id % 3 = 0), e AS (SELECT video_id, start_ms / 1000.0::DOUBLE AS s, end_ms / 1000.0::DOUBLE AS e, row_number() OVER (PARTITION BY video_id ORDER BY length(text) DESC, item_ord) AS rank FROM items WHERE video_id % 3 = 1), u AS (SELECT video_id, greatest(0, at_s - 60) AS start_s, at_s + 60 AS end_s, 1 AS priority FROM a UNION ALL SELECT video_id, greatest(0, s - 15), e + 15, 2 FROM e WHERE rank <= 2 UNION ALL SELECT video_id, start_ms / 1000.0::DOUBLE, end_ms / 1000.0::DOUBLE, 3 FROM items WHERE video_id % 3 = 2 AND item_ord = 0), g AS (SELECT *, CASE WHEN start_s > max(end_s) OVER (PARTITION BY video_id ORDER BY start_s, end_s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 2 THEN 1 ELSE 0 END AS nw FROM u), s AS (SELECT *, sum(nw) OVER (PARTITION BY video_id ORDER BY start_s, end_s ROWS UNBOUNDED PRECEDING) AS island FROM g) SELECT video_id, min(start_s) AS start_s, max(end_s) AS end_s, count(*) AS n, min(priority)::BIGINT AS priority FROM s GROUP BY video_id, island"))
def h_target_ranges(spark, d):
    items = _seconds(X.items(spark, d))
    anchors = items.where("video_id % 3 = 0").select("video_id").distinct().withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(2)))).select("video_id", (F.col("k") * 100.0).alias("at_s"))
    rank = F.row_number().over(Window.partitionBy("video_id").orderBy(F.desc(F.length("text")), "item_ord"))
    found = items.where("video_id % 3 = 1").select("video_id", "start_s", "end_s", rank.alias("rank"))
    return C.target_ranges(anchors, found, items.where("item_ord = 0"), "video_id").withColumn("priority", F.col("priority").cast("long"))


@query("h_sanitize_ranges", sql("items", "r AS (SELECT i.video_id, item_ord % 3 AS priority, start_ms / 1000.0::DOUBLE - 20 AS s, end_ms / 1000.0::DOUBLE + 20 AS e, m.m AS dur, row_number() OVER (PARTITION BY i.video_id ORDER BY item_ord % 3, start_ms, end_ms) AS rn FROM items i JOIN (SELECT video_id, max(end_ms) / 1000.0::DOUBLE AS m FROM items GROUP BY 1) m USING (video_id)) SELECT video_id, round(greatest(0, s), 6) AS start_s, round(least(dur, e), 6) AS end_s, priority FROM r WHERE rn <= 2"))
def h_sanitize_ranges(spark, d):
    items = _seconds(X.items(spark, d)).join(_videos(spark, d), "video_id")
    rows = items.select("video_id", "duration", (F.col("item_ord") % 3).alias("priority"), (F.col("start_s") - 20).alias("start_s"), (F.col("end_s") + 20).alias("end_s"))
    return I.sanitize_ranges(rows, "video_id", "duration", 2).select("video_id", F.round("start_s", 6).alias("start_s"), F.round("end_s", 6).alias("end_s"), "priority")


@query("h_coverage_ranges", sql("items", _DUR + " SELECT video_id, k AS part, round(k * duration / 3, 6) AS start_s, round((k + 1) * duration / 3, 6) AS end_s, 'coverage_fallback:' || CASE k WHEN 0 THEN 'early' WHEN 1 THEN 'middle' ELSE 'late' END AS reason FROM v, generate_series(0, 2) g(k)"))
def h_coverage_ranges(spark, d):
    rows = I.coverage_ranges(_videos(spark, d), "video_id", "duration")
    return rows.withColumn("start_s", F.round("start_s", 6)).withColumn("end_s", F.round("end_s", 6))


@query("h_resolve_ranges", sql("items", _DUR + " SELECT video_id, CASE video_id % 3 WHEN 0 THEN 'planner' WHEN 1 THEN 'speech_guided' ELSE 'coverage_fallback' END AS source, CASE video_id % 3 WHEN 0 THEN 1 WHEN 1 THEN 1 ELSE 3 END::BIGINT AS n FROM v"))
def h_resolve_ranges(spark, d):
    v = _videos(spark, d)
    a = v.where("video_id % 3 = 0").select("video_id", F.lit("planner").alias("source"))
    b = v.where("video_id % 3 = 1").select("video_id", F.lit("speech_guided").alias("source"))
    c = I.coverage_ranges(v.join(a.union(b), "video_id", "left_anti"), "video_id", "duration").select("video_id", F.lit("coverage_fallback").alias("source"))
    return a.union(b).union(c).groupBy("video_id", "source").agg(F.count("*").alias("n"))


_BINS = "e AS (SELECT video_id, min(start_ms) AS lo, max(end_ms) AS hi FROM items GROUP BY 1), o AS (SELECT video_id, (start_ms + end_ms) / 2.0::DOUBLE AS m FROM items WHERE length(text) % 3 <> 1), b AS (SELECT DISTINCT e.video_id, k FROM e JOIN o USING (video_id), generate_series(0, 2) g(k) WHERE hi > lo AND m >= lo + k * (hi - lo) / 3.0::DOUBLE AND m <= CASE k WHEN 2 THEN hi ELSE lo + (k + 1) * (hi - lo) / 3.0::DOUBLE END), c AS (SELECT e.video_id, count(k) AS covered FROM e LEFT JOIN b USING (video_id) GROUP BY 1)"


def _covered(spark, d):
    items = X.items(spark, d)
    extents = items.groupBy("video_id").agg(F.min("start_ms").alias("lo"), F.max("end_ms").alias("hi"))
    seen = items.where(F.length("text") % 3 != 1).select("video_id", ((F.col("start_ms") + F.col("end_ms")) / 2).alias("m"))
    return I.coverage_bins(seen, extents, "video_id", "m")


@query("h_coverage_bins", sql("items", _BINS + " SELECT video_id, covered FROM c"))
def h_coverage_bins(spark, d):
    return _covered(spark, d)


@query("h_scope", sql("items", _BINS + " SELECT video_id, CASE WHEN video_id % 4 = 0 THEN 'not_applicable' WHEN covered >= 3 THEN 'complete' ELSE 'incomplete' END AS scope FROM c"))
def h_scope(spark, d):
    return _covered(spark, d).select("video_id", C.scope_status(F.col("video_id") % 4 != 0, F.col("covered"), F.lit(1)).alias("scope"))


@query("h_contract", sql("evidence", "e AS (SELECT coalesce(video_id, '') || '-' || (doc_id % 61) AS video_id, evidence_type, text FROM evidence), q AS (SELECT DISTINCT video_id, unnest(['speech', 'visual']) AS modality FROM e) SELECT q.video_id, modality, count(*) FILTER (WHERE trim(text) <> '' AND ((modality = 'speech' AND evidence_type = 'speech') OR (modality = 'visual' AND evidence_type <> 'speech'))) > 0 AS available FROM q JOIN e USING (video_id) GROUP BY 1, 2"))
def h_contract(spark, d):
    e = X.evidence(spark, d).withColumn("video_id", F.concat_ws("-", F.coalesce("video_id", F.lit("")), (F.col("doc_id") % 61).cast("string")))
    q = e.select("video_id").distinct().withColumn("required", F.array(F.lit("speech"), F.lit("visual")))
    return C.modality_contract(q, e, "video_id")


@query("h_fact_support", "SELECT item_id AS question_id, 'Fact ' || item_id AS fact, CASE WHEN item_id % 4 = 0 THEN 'unsupported' WHEN item_id % 4 = 1 THEN 'unsupported' ELSE 'supported' END AS status, CASE WHEN item_id % 4 < 2 THEN 0 ELSE 1 END::BIGINT AS n_valid FROM benchmark")
def h_fact_support(spark, d):
    b = X.table(spark, d, "benchmark").select(F.col("item_id").alias("question_id"))
    expected = b.withColumn("fact", F.concat(F.lit("Fact "), F.col("question_id").cast("string")))
    ids = F.when(F.col("question_id") % 4 == 1, F.array(F.lit("nowhere"))).otherwise(F.array(F.lit("nowhere"), F.concat(F.lit("e"), F.col("question_id").cast("string"))))
    reported = expected.where("question_id % 4 <> 0").select("question_id", F.upper("fact").alias("fact"), F.lit("supported").alias("status"), ids.alias("evidence_ids"))
    return C.fact_support(expected, reported, b.select("question_id", F.concat(F.lit("e"), F.col("question_id").cast("string")).alias("evidence_id")))


@query("h_gate", "SELECT item_id AS question_id, CASE WHEN item_id % 5 = 0 THEN 'needs_refinement' WHEN item_id % 5 = 1 THEN 'needs_refinement' WHEN item_id % 5 = 2 THEN 'needs_refinement' WHEN item_id % 5 = 3 THEN 'supported_with_scope_limit' ELSE 'fully_supported' END AS status FROM benchmark")
def h_gate(spark, d):
    b = X.table(spark, d, "benchmark").select(F.col("item_id").alias("question_id"))
    k = F.col("question_id") % 5
    facts = b.select("question_id", F.when(k == 0, "unsupported").otherwise("supported").alias("status"))
    relations = b.select("question_id", F.when(k == 1, 1).otherwise(2).alias("n_times"))
    scopes = b.select("question_id", F.lit(1).alias("n_evidence"), F.when(k == 2, "strict").otherwise("best_effort").alias("completeness"), F.when(k.isin(2, 3), "incomplete").otherwise("complete").alias("scope"), F.lit(True).alias("partial_ok"))
    return C.gate(facts, scopes, relations)


@query("h_bundle", sql("evidence", "e AS (SELECT video_id, doc_id // 3 AS segment_id, evidence_type, doc_id % 2 AS frame_id, doc_id AS evidence_id, start_s FROM evidence WHERE (doc_id // 3) % 5 <> 0), f AS (SELECT *, row_number() OVER (PARTITION BY video_id, segment_id, evidence_type, frame_id ORDER BY start_s, evidence_id) AS rn FROM e) SELECT video_id, evidence_id, row_number() OVER (PARTITION BY video_id ORDER BY start_s, evidence_type, evidence_id) AS place FROM f WHERE rn = 1"))
def h_bundle(spark, d):
    e = X.evidence(spark, d).select("video_id", F.floor(F.col("doc_id") / 3).alias("segment_id"), "evidence_type", (F.col("doc_id") % 2).alias("frame_id"), F.col("doc_id").alias("evidence_id"), "start_s", F.col("start_s").alias("ts_s"))
    return C.bundle(e, e.where("segment_id % 5 <> 0"), ["video_id"]).select("video_id", "evidence_id", "place")


@query("h_gap_review", sql("items", "a AS (SELECT DISTINCT video_id, k * 50.0::DOUBLE AS at_s FROM items, generate_series(0, 12) g(k)) SELECT video_id, at_s FROM a WHERE NOT EXISTS (SELECT 1 FROM items i WHERE i.video_id = a.video_id AND item_ord % 2 = 0 AND a.at_s BETWEEN i.start_ms / 1000.0 - 5 AND i.end_ms / 1000.0 + 5)"))
def h_gap_review(spark, d):
    items = _seconds(X.items(spark, d))
    anchors = items.select("video_id").distinct().withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(12)))).select("video_id", (F.col("k") * 50.0).alias("at_s"))
    return C.missing_anchors(anchors, items.where("item_ord % 2 = 0"), ["video_id"])


@query("h_refine_delta", sql("frames", "SELECT video_id, count(*) AS added FROM (SELECT video_id, phash FROM frames WHERE frame_id % 2 = 0 EXCEPT SELECT video_id, phash FROM frames WHERE frame_id % 2 = 1 AND ts_ms < 20000) x GROUP BY 1"))
def h_refine_delta(spark, d):
    f = X.frames(spark, d)
    return f.where("frame_id % 2 = 0").select("video_id", "phash").subtract(f.where("frame_id % 2 = 1 AND ts_ms < 20000").select("video_id", "phash")).groupBy("video_id").agg(F.count("*").alias("added"))


@query("h_valid_ids", "SELECT e.event_id FROM events e WHERE EXISTS (SELECT 1 FROM documents d WHERE d.doc_id = e.event_id AND d.doc_id % 3 = 0)")
def h_valid_ids(spark, d):
    known = X.table(spark, d, "documents").where("doc_id % 3 = 0").select(F.col("doc_id").alias("event_id"))
    return C.valid_ids(X.table(spark, d, "events").select("event_id"), known, ["event_id"])


@query("h_compose_answer", sql("items", "r AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY item_ord) AS rank FROM items) SELECT video_id, string_agg(substr(text, 1, 120), chr(10) ORDER BY rank) FILTER (WHERE rank <= 3) AS answer, string_agg(item_ord::VARCHAR, ',' ORDER BY rank) FILTER (WHERE rank <= 4) AS cited FROM r GROUP BY 1"))
def h_compose_answer(spark, d):
    rank = F.row_number().over(Window.partitionBy("video_id").orderBy("item_ord"))
    return C.compose_answer(X.items(spark, d).select("video_id", F.col("item_ord").alias("evidence_id"), "text", rank.alias("rank")), "video_id")


@query("h_audit", sql("evidence", "s AS (SELECT video_id, doc_id AS segment_id, CASE WHEN doc_id % 11 = 0 THEN 'ocr' ELSE evidence_type END AS evidence_type, CASE WHEN doc_id % 13 = 0 THEN ' ' ELSE text END AS text FROM evidence) SELECT video_id, 'dangling_segment' AS issue, (segment_id + 1000000)::VARCHAR AS subject FROM s WHERE segment_id % 10 = 0 UNION ALL SELECT video_id, 'illegal_type', segment_id::VARCHAR FROM s WHERE evidence_type = 'ocr' UNION ALL SELECT video_id, 'empty_text', segment_id::VARCHAR FROM s WHERE trim(coalesce(text, '')) = ''"))
def h_audit(spark, d):
    e = X.evidence(spark, d).withColumnRenamed("doc_id", "segment_id")
    s = e.withColumn("evidence_type", F.when(F.col("segment_id") % 11 == 0, "ocr").otherwise(F.col("evidence_type"))).withColumn("text", F.when(F.col("segment_id") % 13 == 0, " ").otherwise(F.col("text")))
    nodes = e.where("segment_id % 10 = 0").select("video_id", F.array("segment_id", F.col("segment_id") + 1000000).alias("segment_ids"))
    return C.audit(nodes, s)


@query("h_plan", sql("asked", ANCHORS_SQL.replace("contains(question, '结尾')", "false") + f" SELECT asked.question_id, CASE WHEN len(found) > 0 THEN 'time_window' WHEN {LOOKS_SQL} THEN 'visual_refine' ELSE 'text_only' END AS action FROM asked JOIN r USING (question_id)"))
def h_plan(spark, d):
    from tessera.functions.routing import needs_visual
    from tessera.functions.timeparse import time_anchors

    q = F.col("question")
    return X.asked(spark, d).select("question_id", F.when(F.size(time_anchors(q)) > 0, "time_window").when(needs_visual(q), "visual_refine").otherwise("text_only").alias("action"))


# --- storylines ---------------------------------------------------------------------------------------------------


@query("i_fallback_storyline", sql("items", _SEG + r", n AS (SELECT video_id, printf('node_%04d', segment) AS node_id, start_s AS time_start, end_s AS time_end, trim(regexp_replace(text, '\s+', ' ', 'g')) AS p FROM seg) SELECT video_id, node_id, time_start, time_end, CASE WHEN length(p) <= 160 THEN p ELSE rtrim(substr(p, 1, 159)) || '...' END AS claim, CASE WHEN p <> '' THEN 0.55::DOUBLE ELSE 0.2 END AS confidence, CASE WHEN p <> '' THEN 0.45::DOUBLE ELSE 0.8 END AS uncertainty, CASE WHEN p <> '' THEN 'weakly_supported' ELSE 'needs_review' END AS status FROM n", True))
def i_fallback_storyline(spark, d):
    return N.fallback_storyline(_segments(spark, d))


@query("i_validate_nodes", "SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'needs_review' WHEN event_id % 3 <> 0 THEN CASE WHEN (event_id % 10) / 10.0 < 0.75 THEN 'weakly_supported' ELSE 'supported' END WHEN (event_id % 10) / 10.0 < 0.75 THEN 'weakly_supported' ELSE 'supported' END AS status FROM events")
def i_validate_nodes(spark, d):
    k = F.col("event_id")
    return X.table(spark, d, "events").select("event_id", N.node_status(F.lit("supported"), (k % 4), k % 3 == 0, F.lit(False), k % 10 / 10).alias("status"))


_NODES = "s AS (SELECT video_id, item_ord AS segment_id, start_ms / 1000.0::DOUBLE AS start_s, end_ms / 1000.0::DOUBLE AS end_s, row_number() OVER (PARTITION BY video_id ORDER BY start_ms, item_ord) AS pos FROM items), n AS (SELECT video_id, item_ord % 2 AS node_order, 'n' || (item_ord % 2) AS node_id, item_ord AS segment_id FROM items WHERE item_ord % 5 < 3 UNION ALL SELECT video_id, 2, 'n2', item_ord FROM items WHERE item_ord % 5 < 4)"


def _nodes(spark, d):
    items = X.items(spark, d)
    part = F.col("item_ord") % 2
    a = items.where("item_ord % 5 < 3").select("video_id", part.alias("node_order"), F.concat(F.lit("n"), part.cast("string")).alias("node_id"), F.col("item_ord").alias("segment_id"))
    b = items.where("item_ord % 5 < 4").select("video_id", F.lit(2).cast("long").alias("node_order"), F.lit("n2").alias("node_id"), F.col("item_ord").alias("segment_id"))
    return a.union(b), _seconds(items).select("video_id", F.col("item_ord").alias("segment_id"), "start_s", "end_s")


@query("i_split_nodes", sql("items", _NODES + ", c AS (SELECT *, row_number() OVER (PARTITION BY video_id, segment_id ORDER BY node_order, node_id) AS rn FROM n JOIN s USING (video_id, segment_id)), r AS (SELECT *, pos - row_number() OVER (PARTITION BY video_id, node_id ORDER BY pos) AS run FROM c WHERE rn = 1), p AS (SELECT video_id, node_id, run, min(start_s) AS time_start, max(end_s) AS time_end, count(*) AS n FROM r GROUP BY 1, 2, 3) SELECT video_id, node_id, time_start, time_end, n, row_number() OVER (PARTITION BY video_id, node_id ORDER BY time_start) AS part FROM p"))
def i_split_nodes(spark, d):
    return N.split_nodes(*_nodes(spark, d))


@query("i_coverage_gaps", sql("items", _NODES + ", u AS (SELECT *, pos - row_number() OVER (PARTITION BY video_id ORDER BY start_s, segment_id) AS run FROM s WHERE segment_id % 4 <> 0) SELECT video_id, arg_min(segment_id, pos) AS first_segment, count(*) AS n, min(start_s) AS start_s, arg_max(end_s, pos) AS end_s FROM u GROUP BY video_id, run HAVING arg_max(end_s, pos) - min(start_s) >= 60"))
def i_coverage_gaps(spark, d):
    segments = _nodes(spark, d)[1]
    return N.coverage_gaps(segments, segments.where("segment_id % 4 = 0"))


@query("i_story_metadata", sql("items", _SEG + " SELECT video_id, count(*) AS n, CAST(round(sum(end_s - start_s), 3) AS DOUBLE) AS covered_s, 0::BIGINT AS n_supported, 'weakly_supported' AS statuses FROM seg GROUP BY 1", True))
def i_story_metadata(spark, d):
    return N.story_metadata(N.fallback_storyline(_segments(spark, d)))


@query("i_map_reduce", sql("items", "c AS (SELECT video_id, (row_number() OVER (PARTITION BY video_id ORDER BY item_ord) - 1) // 3 AS chunk, length(text) AS len FROM items), m AS (SELECT video_id, chunk, sum(len) AS len, count(*) AS n FROM c GROUP BY 1, 2) SELECT video_id, count(*) AS chunks, max(n) AS largest, CAST(sum(len) AS BIGINT) AS chars FROM m GROUP BY 1"))
def i_map_reduce(spark, d):
    mapped = N.chunks(X.items(spark, d), "video_id", "item_ord", 3).groupBy("video_id", "chunk").agg(F.sum(F.length("text")).alias("len"), F.count("*").alias("n"))
    return mapped.groupBy("video_id").agg(F.count("*").alias("chunks"), F.max("n").alias("largest"), F.sum("len").alias("chars"))


@query("i_summary_grounding", sql("items", "SELECT video_id, item_ord AS item, CASE item_ord % 3 WHEN 0 THEN 0 ELSE 1 END::BIGINT AS n_valid, CASE item_ord % 3 WHEN 0 THEN 'low' ELSE 'high' END AS confidence FROM items"))
def i_summary_grounding(spark, d):
    items = X.items(spark, d)
    cited = F.when(F.col("item_ord") % 3 == 0, F.array(F.lit(-1).cast("long"))).otherwise(F.array(F.col("item_ord"), F.lit(-5).cast("long")))
    return N.citation_confidence(items.select("video_id", F.col("item_ord").alias("item"), cited.alias("cited")), items.select("video_id", F.col("item_ord").alias("segment_id")), "video_id")


@query("i_fallback_summary", sql("items", "r AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY item_ord) AS rn FROM items) SELECT video_id, string_agg(substr(text, 1, 40), ' | ' ORDER BY rn) AS summary FROM r WHERE rn <= 6 GROUP BY 1"))
def i_fallback_summary(spark, d):
    rn = F.row_number().over(Window.partitionBy("video_id").orderBy("item_ord"))
    rows = X.items(spark, d).withColumn("rn", rn).where("rn <= 6").groupBy("video_id").agg(F.array_sort(F.collect_list(F.struct("rn", F.substring("text", 1, 40).alias("t")))).alias("x"))
    return rows.select("video_id", F.array_join(F.transform("x", lambda x: x["t"]), " | ").alias("summary"))


@query("i_outline_tail", sql("items", "s AS (SELECT video_id, item_ord, start_ms, end_ms FROM items), l AS (SELECT video_id, max(end_ms) AS last FROM s WHERE item_ord < 2 GROUP BY 1), e AS (SELECT video_id, max(end_ms) AS fin FROM s GROUP BY 1), r AS (SELECT s.*, row_number() OVER (PARTITION BY s.video_id ORDER BY start_ms) AS rn FROM s JOIN l USING (video_id) JOIN e USING (video_id) WHERE last < 0.75 * fin AND start_ms >= last) SELECT video_id, item_ord FROM r WHERE rn <= 3"))
def i_outline_tail(spark, d):
    s = _seconds(X.items(spark, d))
    return N.outline_tail(s.where("item_ord < 2"), s, "video_id").select("video_id", "item_ord")


@query("i_outline_ranges", sql("items", "SELECT video_id, item_ord // 2 AS item, min(start_ms) / 1000.0::DOUBLE AS start_s, max(end_ms) / 1000.0::DOUBLE AS end_s FROM items GROUP BY 1, 2"))
def i_outline_ranges(spark, d):
    s = _seconds(X.items(spark, d)).withColumn("segment_id", F.col("item_ord"))
    cited = s.groupBy("video_id", F.floor(F.col("item_ord") / 2).alias("item")).agg(F.collect_list("item_ord").alias("cited"))
    return N.evidence_extent(cited, s.select("video_id", "segment_id", "start_s", "end_s"), "video_id")


@query("i_coerce_nodes", sql("items", "SELECT video_id, count(*) AS n, round(avg(least(1, greatest(0, (item_ord % 5 - 1) / 2.0::DOUBLE))), 6) AS mean_confidence FROM items GROUP BY 1"))
def i_coerce_nodes(spark, d):
    node = F.to_json(F.struct(F.col("item_ord").alias("id"), ((F.col("item_ord") % 5 - 1) / 2).alias("confidence")))
    replies = X.items(spark, d).groupBy("video_id").agg(F.concat(F.lit('{"nodes":['), F.array_join(F.collect_list(node), ","), F.lit("]}")).alias("reply"))
    nodes = replies.select("video_id", F.explode(F.from_json("reply", "nodes array<struct<id:long,confidence:double>>")["nodes"]).alias("n"))
    return nodes.groupBy("video_id").agg(F.count("*").alias("n"), F.round(F.avg(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("n.confidence")))), 6).alias("mean_confidence"))


