"""Queries of metrics, viewpoints, memory, state, streams and plain relational categories."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.operators import memory as M
from tessera.operators import metrics as J
from tessera.operators import state as P
from tessera.operators import topics as K
from tessera.plans.registry import query
from tessera.sources import fixtures as X
from tessera.sources.fixtures import sql
from tessera.streaming import live

NOW_US = 1706745600000000


def _pred_gold(spark, d):
    e = X.table(spark, d, "events").select("user_id", F.col("event_id").alias("item"), "value")
    return e.select("user_id").distinct(), e.where("value < 120").select("user_id", "item"), e.where("item % 3 = 0").select("user_id", "item")


_PG = "c AS (SELECT DISTINCT user_id FROM events), p AS (SELECT user_id, event_id AS item FROM events WHERE value < 120), g AS (SELECT user_id, event_id AS item FROM events WHERE event_id % 3 = 0)"


@query("j_prf1", f"WITH {_PG}, n AS (SELECT c.user_id, (SELECT count(*) FROM p WHERE p.user_id = c.user_id) AS np, (SELECT count(*) FROM g WHERE g.user_id = c.user_id) AS ng, (SELECT count(*) FROM p JOIN g USING (user_id, item) WHERE p.user_id = c.user_id) AS o FROM c), s AS (SELECT user_id, CASE WHEN np = 0 AND ng = 0 THEN 1.0::DOUBLE WHEN np = 0 OR ng = 0 THEN 0 ELSE o / np::DOUBLE END AS precision, CASE WHEN np = 0 AND ng = 0 THEN 1.0::DOUBLE WHEN np = 0 OR ng = 0 THEN 0 ELSE o / ng::DOUBLE END AS recall FROM n) SELECT user_id, round(precision, 6) AS precision, round(recall, 6) AS recall, round(CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END, 6) AS f1 FROM s")
def j_prf1(spark, d):
    rows = J.prf1(*_pred_gold(spark, d), "user_id", "item")
    return rows.select("user_id", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@query("j_mrr", f"WITH {_PG}, r AS (SELECT user_id, item, row_number() OVER (PARTITION BY user_id ORDER BY item DESC) AS rank FROM p), b AS (SELECT r.user_id, min(rank) AS r FROM r JOIN g USING (user_id, item) GROUP BY 1) SELECT c.user_id, round(coalesce(1.0::DOUBLE / r, 0), 6) AS reciprocal_rank FROM c LEFT JOIN b USING (user_id)")
def j_mrr(spark, d):
    cases, predicted, gold = _pred_gold(spark, d)
    ranked = predicted.withColumn("rank", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("item"))))
    return J.reciprocal_rank(cases, ranked, gold, "user_id", "item").withColumn("reciprocal_rank", F.round("reciprocal_rank", 6))


@query("j_temporal_iou", sql("ranges", "SELECT event_id, round(greatest(0, least(end_s, start_s + 5400) - greatest(start_s, start_s + 1800))::DOUBLE / (greatest(end_s, start_s + 5400) - least(start_s, start_s + 1800)), 6) AS iou FROM ranges"))
def j_temporal_iou(spark, d):
    s = F.col("start_s")
    return X.ranges(spark, d).select("event_id", F.round(J.temporal_iou(s, F.col("end_s"), s + 1800, s + 5400), 6).alias("iou"))


@query("j_mean_best_iou", sql("items", "p AS (SELECT video_id, start_ms / 1000.0::DOUBLE AS p0, end_ms / 1000.0::DOUBLE AS p1 FROM items WHERE item_ord % 2 = 0), g AS (SELECT video_id, item_ord, start_ms / 1000.0::DOUBLE + 4 AS g0, end_ms / 1000.0::DOUBLE + 4 AS g1 FROM items WHERE item_ord % 3 = 0), b AS (SELECT g.video_id, item_ord, coalesce(max(greatest(0, least(g1, p1) - greatest(g0, p0)) / (greatest(g1, p1) - least(g0, p0))), 0) AS x FROM g LEFT JOIN p USING (video_id) GROUP BY 1, 2) SELECT video_id, round(avg(x), 6) AS iou FROM b GROUP BY 1"))
def j_mean_best_iou(spark, d):
    i = X.items(spark, d).select("video_id", F.col("item_ord").alias("gold_id"), (F.col("start_ms") / 1000).alias("start_s"), (F.col("end_ms") / 1000).alias("end_s"))
    gold = i.where("gold_id % 3 = 0").withColumn("start_s", F.col("start_s") + 4).withColumn("end_s", F.col("end_s") + 4)
    return J.mean_best_iou(i.where("gold_id % 2 = 0"), gold, "video_id").withColumn("iou", F.round("iou", 6))


@query("j_token_f1", "WITH p AS (SELECT item_id, text AS a, substr(text, 20) AS b FROM benchmark), x AS (SELECT item_id, t, count(*) AS n FROM (SELECT item_id, lower(unnest(regexp_extract_all(a, '[A-Za-z0-9_]+|[\\x{4e00}-\\x{9fff}]'))) AS t FROM p) z GROUP BY ALL), y AS (SELECT item_id, t, count(*) AS n FROM (SELECT item_id, lower(unnest(regexp_extract_all(b, '[A-Za-z0-9_]+|[\\x{4e00}-\\x{9fff}]'))) AS t FROM p) z GROUP BY ALL), o AS (SELECT item_id, sum(least(x.n, y.n)) AS o FROM x JOIN y USING (item_id, t) GROUP BY 1), nx AS (SELECT item_id, sum(n) AS nx FROM x GROUP BY 1), ny AS (SELECT item_id, sum(n) AS ny FROM y GROUP BY 1) SELECT item_id, round(CASE WHEN coalesce(o, 0) = 0 THEN 0 ELSE 2.0::DOUBLE * (o / nx) * (o / ny) / (o / nx + o / ny) END, 6) AS f1 FROM nx JOIN ny USING (item_id) LEFT JOIN o USING (item_id)")
def j_token_f1(spark, d):
    p = X.table(spark, d, "benchmark").select("item_id", F.col("text").alias("a"), F.expr("substr(text, 20)").alias("b"))
    return J.token_f1(p, "item_id", "a", "b").withColumn("f1", F.round("f1", 6))


@query("j_contains_recall", "SELECT doc_id, round((CASE WHEN contains(lower(text), 'the') THEN 1 ELSE 0 END + CASE WHEN contains(lower(text), 'zzz') THEN 1 ELSE 0 END + CASE WHEN contains(lower(text), 'de') THEN 1 ELSE 0 END) / 3.0::DOUBLE, 6) AS recall FROM documents")
def j_contains_recall(spark, d):
    need = F.array(F.lit("The"), F.lit("zzz"), F.lit("de"))
    return X.table(spark, d, "documents").select("doc_id", F.round(J.contains_recall(F.col("text"), need), 6).alias("recall"))


_CASES = "s AS (SELECT d.doc_id, CASE WHEN l.quality = 1 THEN 1.0::DOUBLE ELSE 0 END AS retrieval_hit_rate, CASE WHEN l.toxic = 0 THEN 0.8::DOUBLE ELSE 0.2 END AS segment_recall, CASE WHEN d.doc_id % 4 > 0 THEN 1.0::DOUBLE END AS grounding_precision, (d.doc_id % 5) / 4.0::DOUBLE AS answer_contains_recall FROM documents d JOIN labels l USING (doc_id))"


def _cases(spark, d):
    rows = X.table(spark, d, "documents").select("doc_id").join(X.table(spark, d, "labels"), "doc_id")
    return rows.select("doc_id", F.when(F.col("quality") == 1, 1.0).otherwise(0.0).alias("retrieval_hit_rate"), F.when(F.col("toxic") == 0, 0.8).otherwise(0.2).alias("segment_recall"), F.when(F.col("doc_id") % 4 > 0, 1.0).alias("grounding_precision"), (F.col("doc_id") % 5 / 4).alias("answer_contains_recall"))


@query("j_score_case", f"WITH {_CASES} SELECT doc_id, round((retrieval_hit_rate + segment_recall + coalesce(grounding_precision, 0) + answer_contains_recall) / CASE WHEN grounding_precision IS NULL THEN 3 ELSE 4 END, 6) AS mean FROM s")
def j_score_case(spark, d):
    names = list(J.THRESHOLDS)
    have = F.filter(F.array(*names), lambda x: x.isNotNull())
    return _cases(spark, d).select("doc_id", F.round(F.aggregate(have, F.lit(0.0), lambda a, x: a + x) / F.size(have), 6).alias("mean"))


@query("j_aggregate", f"WITH {_CASES}, u AS (SELECT 'retrieval_hit_rate' AS metric, retrieval_hit_rate AS v, 0.70::DOUBLE AS threshold FROM s UNION ALL SELECT 'segment_recall', segment_recall, 0.60 FROM s UNION ALL SELECT 'grounding_precision', grounding_precision, 0.80 FROM s UNION ALL SELECT 'answer_contains_recall', answer_contains_recall, 0.60 FROM s) SELECT metric, round(avg(v), 6) AS mean, count(v) AS n, any_value(threshold) AS threshold, avg(v) >= any_value(threshold) AS ok FROM u GROUP BY metric")
def j_aggregate(spark, d):
    return J.aggregate(_cases(spark, d), list(J.THRESHOLDS)).withColumn("mean", F.round("mean", 6))


@query("j_report", "SELECT event_type, count(*) AS n, round(avg(CASE WHEN event_id % 3 = 0 THEN 1.0::DOUBLE ELSE 0 END), 6) AS accuracy, round(avg(value), 4) AS mean_latency, round(quantile_cont(value, 0.5), 6) AS median_latency FROM events GROUP BY 1")
def j_report(spark, d):
    e = X.table(spark, d, "events").withColumn("correct", F.col("event_id") % 3 == 0)
    rows = J.report(e, ["event_type"], "correct", "value")
    return rows.select("event_type", "n", F.round("accuracy", 6).alias("accuracy"), F.round("mean_latency", 4).alias("mean_latency"), F.round("median_latency", 6).alias("median_latency"))


@query("k_kmeans")
def k_kmeans(spark, d):
    return K.kmeans_clusters(X.table(spark, d, "embeddings"))


_SIM = "v AS (SELECT vec_id, cluster_id, author, embedding AS e FROM views)"


@query("k_leader_clusters", sql("views", "o AS (SELECT cluster_id, vec_id, embedding AS e, row_number() OVER (PARTITION BY cluster_id ORDER BY vec_id) AS rn FROM views), f AS (SELECT cluster_id, rn, vec_id, vec_id AS leader, [{'id': vec_id, 'e': e}] AS leaders FROM o WHERE rn = 1 UNION ALL SELECT o.cluster_id, o.rn, o.vec_id, coalesce(hit, o.vec_id), CASE WHEN hit IS NULL THEN list_append(leaders, {'id': o.vec_id, 'e': o.e}) ELSE leaders END FROM (SELECT o.*, f.leaders, list_filter(f.leaders, lambda l: round(list_cosine_similarity(l.e, o.e), 9) >= 0.72)[1].id AS hit FROM f JOIN o ON o.cluster_id = f.cluster_id AND o.rn = f.rn + 1) o) SELECT cluster_id, vec_id, leader FROM f", True))
def k_leader_clusters(spark, d):
    return K.leader_clusters(X.views(spark, d), "cluster_id")


@query("k_pairwise", sql("views", _SIM + " SELECT a.cluster_id, a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(a.e, b.e), 4) + 0.0::DOUBLE AS similarity FROM v a JOIN v b ON a.cluster_id = b.cluster_id AND a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0"))
def k_pairwise(spark, d):
    return K.pairwise(X.views(spark, d), "cluster_id", F.col("vec_id") % 50 == 0)


@query("k_consensus", sql("views", _SIM + ", p AS (SELECT a.cluster_id, a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(a.e, b.e), 4) + 0.0::DOUBLE AS similarity FROM v a JOIN v b ON a.cluster_id = b.cluster_id AND a.vec_id < b.vec_id), k AS (SELECT *, CASE WHEN similarity >= 0.78 THEN 'consensus' WHEN similarity <= 0.45 THEN 'disagreement' END AS kind FROM p), r AS (SELECT *, row_number() OVER (PARTITION BY cluster_id, kind ORDER BY a, b) AS place FROM k WHERE kind IS NOT NULL) SELECT cluster_id, a, b, similarity, kind, place FROM r WHERE place <= 12"))
def k_consensus(spark, d):
    return K.consensus(X.views(spark, d), "cluster_id")


@query("k_author_changes", sql("views", "p AS (SELECT cluster_id, author, vec_id, embedding AS e, lag(embedding) OVER (PARTITION BY cluster_id, author ORDER BY vec_id) AS q FROM views) SELECT cluster_id, author, vec_id, round(list_cosine_similarity(e, q), 4) + 0.0::DOUBLE AS similarity, CASE WHEN list_cosine_similarity(e, q) >= 0.78 THEN 'stable' ELSE 'changed' END AS change FROM p WHERE q IS NOT NULL"))
def k_author_changes(spark, d):
    return K.author_changes(X.views(spark, d), ["cluster_id", "author"], "vec_id").withColumn("similarity", F.col("similarity") + 0.0)


@query("k_describe", "WITH w AS (SELECT source, unnest(string_split_regex(translate(text, ',.，。', '    '), '\\s+')) AS word FROM documents), c AS (SELECT source, word, count(*) AS n FROM w WHERE length(word) >= 2 GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, word) AS rn FROM c) SELECT source, string_agg(word, ' / ' ORDER BY rn) AS description FROM r WHERE rn <= 5 GROUP BY 1")
def k_describe(spark, d):
    return K.describe(X.table(spark, d, "documents"), "source")


@query("k_viewpoints", sql("items", "SELECT video_id, item_ord AS node_id, 'claim ' || item_ord || CASE WHEN item_ord % 4 <> 0 AND trim(text) <> '' THEN chr(10) || 'Evidence: ' || substr(text, 1, 60) ELSE '' END AS text FROM items WHERE item_ord % 4 <> 0 OR item_ord % 8 <> 0"))
def k_viewpoints(spark, d):
    items = X.items(spark, d)
    refs = F.when(F.col("item_ord") % 4 != 0, F.array("item_ord")).otherwise(F.array().cast("array<bigint>"))
    nodes = items.select("video_id", F.col("item_ord").alias("node_id"), refs.alias("segment_ids"), F.concat(F.lit("claim "), F.col("item_ord").cast("string")).alias("claim"), F.when(F.col("item_ord") % 8 == 0, "unsupported").otherwise("supported").alias("status"))
    return K.viewpoints(nodes, items.select("video_id", F.col("item_ord").alias("segment_id"), "text"))


@query("k_topics", sql("views", "SELECT cluster_id, count(*) AS n, count(DISTINCT author) AS authors, min(vec_id) AS first FROM views GROUP BY 1"))
def k_topics(spark, d):
    return X.views(spark, d).groupBy("cluster_id").agg(F.count("*").alias("n"), F.countDistinct("author").alias("authors"), F.min("vec_id").alias("first"))


#: The kinds that events stand for; 'remark' is a kind that no rule knows.
_KIND = "CASE WHEN user_id % 11 = 0 THEN 'remark' WHEN user_id % 7 = 0 THEN 'model_summary' WHEN event_type = 'view' THEN 'speech' WHEN event_type = 'click' THEN 'frame_caption' WHEN event_type = 'signup' THEN 'user_preference' WHEN event_type = 'purchase' THEN 'user_verified' ELSE 'derived_insight' END"
_DECAY = "CASE kind WHEN 'speech' THEN 0.015 WHEN 'frame_caption' THEN 0.012 WHEN 'user_preference' THEN 0.00375 WHEN 'model_summary' THEN 0.009 WHEN 'user_verified' THEN 0.00225 WHEN 'derived_insight' THEN 0.0075 ELSE 0.015 END::DOUBLE"
_MEM = f"m AS (SELECT event_type || '-' || user_id AS memory_id, event_type, {_KIND} AS kind, frequency, (1706745600000000 - last_us) / 86400000000.0::DOUBLE AS age, (user_id % 10) / 10.0::DOUBLE AS sim, (user_id % 4) / 2.0::DOUBLE AS importance FROM memories), w AS (SELECT *, greatest(0, sim) * exp(-({_DECAY}) * greatest(0, age)) * (1 + 0.25::DOUBLE * ln(greatest(1, frequency) + 1)) * greatest(0, importance) AS weight FROM m)"


def _memories(spark, d):
    m = X.memories(spark, d)
    rows = m.select(F.concat_ws("-", "event_type", F.col("user_id").cast("string")).alias("memory_id"), "event_type", F.expr(_KIND).alias("memory_type"), "frequency", "last_us", ((NOW_US - F.col("last_us")) / 86400000000).alias("age"), (F.col("user_id") % 10 / 10).alias("similarity"), (F.col("user_id") % 4 / 2).alias("importance"))
    return rows.withColumn("weight", M.decay_weight(F.col("similarity"), F.col("age"), F.col("frequency"), F.col("importance"), M.alpha_of(F.col("memory_type"))))


@query("l_decay_weight", sql("memories", _MEM + " SELECT memory_id, round(weight, 6) AS weight FROM w"))
def l_decay_weight(spark, d):
    return _memories(spark, d).select("memory_id", F.round("weight", 6).alias("weight"))


@query("l_decay_search", sql("memories", _MEM + ", n AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY sim DESC, memory_id) AS r FROM w), k AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY weight DESC, memory_id) AS place FROM n WHERE r <= 20) SELECT event_type, memory_id, round(weight, 6) AS weight, place FROM k WHERE place <= 8"))
def l_decay_search(spark, d):
    return M.decay_search(_memories(spark, d), "event_type", 20, 8)


@query("l_mark_used", sql("memories", "SELECT event_type, user_id, frequency + CASE WHEN user_id % 3 = 0 THEN 1 ELSE 0 END AS frequency, CASE WHEN user_id % 3 = 0 THEN 1706745600000000 ELSE last_us END AS last_us FROM memories"))
def l_mark_used(spark, d):
    m = X.memories(spark, d).withColumn("memory_id", F.concat_ws("-", "event_type", F.col("user_id").cast("string")))
    return M.mark_used(m, m.where("user_id % 3 = 0").select("memory_id"), NOW_US).select("event_type", "user_id", "frequency", "last_us")


@query("l_cleanup", sql("memories", _MEM + f" SELECT memory_id FROM m WHERE exp(-({_DECAY}) * greatest(0, age + 300)) * (1 + 0.25::DOUBLE * ln(greatest(1, frequency) + 1)) * greatest(0, importance) >= 0.01"))
def l_cleanup(spark, d):
    """What is left of the memories 300 days on."""
    return M.cleanup(_memories(spark, d).withColumn("age", F.col("age") + 300)).select("memory_id")


@query("l_add", "SELECT doc_id, trim(text) AS content FROM documents WHERE trim(text) <> '' AND doc_id % 5 <> 0")
def l_add(spark, d):
    rows = X.table(spark, d, "documents").select("doc_id", F.col("text").alias("content"), F.when(F.col("doc_id") % 5 == 0, -1.0).otherwise(0.5).alias("importance"), F.lit(None).cast("long").alias("frequency"))
    return M.add_memories(rows).select("doc_id", "content")


_TOPICS = "t AS (SELECT video_id, stage AS topic, row_number() OVER (PARTITION BY video_id ORDER BY min(ts_us), stage) - 1 AS pos FROM stages WHERE (video_id + event_id) % 3 = 0 GROUP BY video_id, stage)"


def _topics(spark, d):
    s = X.stages(spark, d).where("(video_id + event_id) % 3 = 0").groupBy("video_id", F.col("stage").alias("topic")).agg(F.min("ts_us").alias("first"))
    w = Window.partitionBy("video_id").orderBy("first", "topic")
    return s.select("video_id", "topic", (F.row_number().over(w) - 1).alias("pos"))


@query("l_related_rooms", sql("stages", _TOPICS + ", o AS (SELECT a.video_id, b.video_id AS other, count(*) AS overlap FROM t a JOIN t b ON a.topic = b.topic AND a.video_id <> b.video_id GROUP BY 1, 2), r AS (SELECT o.video_id, p.topic AS room, max(overlap) AS overlap FROM o JOIN t p ON p.video_id = o.other AND p.pos = 0 GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY overlap DESC, room) AS place FROM r) SELECT * FROM k WHERE place <= 2"))
def l_related_rooms(spark, d):
    return M.related_rooms(_topics(spark, d))


@query("l_assign_topics", sql("stages", _TOPICS + " SELECT video_id, CASE WHEN video_id % 5 = 0 THEN 'by hand' ELSE string_agg(topic, ',' ORDER BY pos) END AS topics FROM t GROUP BY 1"))
def l_assign_topics(spark, d):
    t = _topics(spark, d)
    manual = t.where("video_id % 5 = 0").select("video_id").distinct().select("video_id", F.array(F.lit("by hand")).alias("topics"))
    return M.assign_topics(t.select("video_id", F.col("pos").alias("ord"), F.concat(F.lit(" "), F.upper("topic"), F.lit(".")).alias("label")), manual).select("video_id", F.array_join("topics", ",").alias("topics"))


@query("l_topic_cache", "SELECT count(*) FILTER (WHERE hit) AS hits, count(*) FILTER (WHERE NOT hit) AS misses FROM (SELECT doc_id % 2 = 0 AS hit FROM documents) x")
def l_topic_cache(spark, d):
    docs = X.table(spark, d, "documents").select("doc_id", F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("f"))
    cached = docs.where("doc_id % 2 = 0").select("doc_id", F.col("f").alias("g"))
    rows = docs.join(cached, "doc_id", "left").select((F.col("f") == F.col("g")).alias("same"))
    return rows.agg(F.count_if(F.coalesce("same", F.lit(False))).alias("hits"), F.count_if(~F.coalesce("same", F.lit(False))).alias("misses"))


@query("l_ingest", "SELECT doc_id AS id, source AS video_id, CASE WHEN source NOT IN (SELECT source FROM documents WHERE doc_id % 4 = 1) THEN true WHEN doc_id % 4 = 1 THEN true ELSE false END AS active, doc_id % 2 = 0 AND doc_id % 3 <> 0 AS synced FROM documents WHERE doc_id % 3 <> 0 OR doc_id % 4 = 1")
def l_ingest(spark, d):
    docs = X.table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("video_id"))
    stored = docs.where("id % 3 <> 0").select("id", "video_id", F.lit(True).alias("active"), (F.col("id") % 2 == 0).alias("synced"))
    return M.catalog_sync(stored, docs.where("id % 4 = 1")).select("id", "video_id", "active", "synced")


@query("l_outbox", "WITH o AS (SELECT user_id, event_id, value > 200 AS bad, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM events), s AS (SELECT *, sum(bad::INT) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS b FROM o WHERE rn <= 50) SELECT user_id, event_id FROM s WHERE b = 0")
def l_outbox(spark, d):
    return M.outbox(X.table(spark, d, "events"), "user_id", "event_id", F.col("value") > 200, 50).select("user_id", "event_id")


@query("l_stats", "SELECT count(*) AS active, CAST(sum(CASE WHEN doc_id % 2 = 0 THEN 0 ELSE 1 END) AS BIGINT) AS pending FROM documents WHERE doc_id % 3 > 0")
def l_stats(spark, d):
    return M.catalog_stats(X.table(spark, d, "documents").select((F.col("doc_id") % 3 > 0).alias("active"), (F.col("doc_id") % 2 == 0).alias("synced")))


_KEY = "'vka_' || substr(sha256(doc_id::VARCHAR), 1, 24)"


@query("l_resolve", f"SELECT doc_id, {_KEY} AS id FROM documents WHERE doc_id % 2 = 0 AND doc_id % 3 > 0")
def l_resolve(spark, d):
    key = F.concat(F.lit("vka_"), F.substring(F.sha2(F.col("doc_id").cast("string"), 256), 1, 24))
    docs = X.table(spark, d, "documents").select("doc_id", key.alias("id"), F.concat(F.lit("see "), key, F.lit(".json")).alias("said"), (F.col("doc_id") % 3 > 0).alias("active"), (F.col("doc_id") % 2 == 0).alias("synced"))
    return M.resolve_ids(docs.select("doc_id", "said"), docs.select("id", "active", "synced"), "said").select("doc_id", "id")


@query("l_verify", sql("items", "SELECT video_id AS claim_id, bool_and(item_ord % 6 <> 5) AS ok FROM items GROUP BY 1"))
def l_verify(spark, d):
    items = X.items(spark, d).select(F.col("video_id").alias("claim_id"), (F.col("video_id") * 1000 + F.col("item_ord")).alias("segment_id"), "item_ord", F.col("start_ms").alias("start_s"), F.concat(F.lit("q"), "text").alias("text"))
    claims = items.select("claim_id", "segment_id", "start_s", F.when(F.col("item_ord") % 6 == 5, "changed").otherwise(F.col("text")).alias("quote"))
    return M.verify(claims, items.select("segment_id", "start_s", "text"))




_HISTORY = """q AS (SELECT user_id % 50 AS question_id, min(source) AS video_id FROM events, (SELECT DISTINCT source, dense_rank() OVER (ORDER BY source) - 1 AS place, 0 AS z FROM documents) s WHERE place = user_id % 5 GROUP BY 1),
 c AS (SELECT doc_id AS memory_id, source AS video_id, (doc_id % 11) / 10.0::DOUBLE AS importance, doc_id % 13 = 0 AS pinned, 'c' || (doc_id % 17) AS claim, 200 + (doc_id * 31) % 900 AS size, doc_id % 9 <> 4 AS stands FROM documents),
 f AS (SELECT question_id, q.video_id AS asked, c.*, ((memory_id * 37 + question_id * 11) % 101) / 100.0::DOUBLE AS similarity FROM q, c WHERE (memory_id + question_id) % 7 = 0),
 t AS (SELECT DISTINCT source AS video_id, lang AS topic FROM documents WHERE doc_id % 3 = 0),
 k AS (SELECT question_id, memory_id, video_id, claim, size, round(similarity + CASE WHEN EXISTS (SELECT 1 FROM t a, t b WHERE a.video_id = f.asked AND b.video_id = f.video_id AND a.topic = b.topic) THEN 0.08 ELSE 0 END + 0.05::DOUBLE * importance + CASE WHEN pinned THEN 0.05 ELSE 0 END, 9) AS score FROM f WHERE asked <> video_id AND similarity >= 0.35 AND stands),
 o AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, memory_id) AS rn FROM k),
 g AS (SELECT DISTINCT question_id, 0::BIGINT AS rn, 0::BIGINT AS used, []::BIGINT[] AS picked, []::VARCHAR[] AS videos, []::VARCHAR[] AS claims FROM o UNION ALL
  SELECT question_id, rn, CASE WHEN fits THEN used + size ELSE used END, CASE WHEN fits THEN list_append(picked, memory_id) ELSE picked END, CASE WHEN fits THEN list_append(videos, video_id) ELSE videos END, CASE WHEN fits THEN list_append(claims, claim) ELSE claims END
  FROM (SELECT g.question_id, o.rn, used, picked, videos, claims, memory_id, size, video_id, claim, used + size <= 3010 AND len(picked) < 4 AND NOT list_contains(claims, claim) AND len(list_filter(videos, lambda l: l = video_id)) < 2 AS fits FROM g JOIN o ON o.question_id = g.question_id AND o.rn = g.rn + 1) x),
 z AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY rn DESC) AS r FROM g) SELECT question_id, array_to_string(picked, ',') AS picked FROM z WHERE r = 1"""


@query("l_historical_context", "WITH RECURSIVE " + _HISTORY)
def l_historical_context(spark, d):
    docs = X.table(spark, d, "documents")
    places = docs.select("source").distinct().withColumn("place", F.dense_rank().over(Window.orderBy("source")) - 1)
    users = X.table(spark, d, "events").select((F.col("user_id") % 50).alias("question_id"), (F.col("user_id") % 5).alias("place")).distinct()
    questions = users.join(places, "place").groupBy("question_id").agg(F.min("source").alias("video_id"))
    k = F.col("doc_id")
    catalog = docs.select(k.alias("memory_id"), F.col("source").alias("video_id"), (k % 11 / 10).alias("importance"), (k % 13 == 0).alias("pinned"), F.concat(F.lit("c"), (k % 17).cast("string")).alias("claim"), (200 + k * 31 % 900).alias("size"))
    asked = docs.select(k.alias("memory_id"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(49).cast("long"))).alias("question_id")).where((F.col("memory_id") + F.col("question_id")) % 7 == 0)
    found = asked.withColumn("similarity", (F.col("memory_id") * 37 + F.col("question_id") * 11) % 101 / 100)
    topics = docs.where("doc_id % 3 = 0").select(F.col("source").alias("video_id"), F.col("lang").alias("topic")).distinct()
    rows = M.historical_context(questions, found, catalog, docs.where("doc_id % 9 <> 4").select(k.alias("memory_id")), topics)
    return rows.select("question_id", F.array_join(F.transform("picked", lambda x: x.cast("string")), ",").alias("picked"))


@query("l_memory_context", "WITH RECURSIVE u AS (SELECT source, substr(text, 1, 200) AS c, min(doc_id) AS doc_id, any_value(n_chars)::BIGINT AS n FROM documents WHERE text IS NOT NULL GROUP BY 1, 2), o AS (SELECT source, doc_id, least(n, 700) AS size, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn FROM u), f AS (SELECT DISTINCT source, 0::BIGINT AS rn, 0::BIGINT AS used, []::BIGINT[] AS picked FROM o UNION ALL SELECT f.source, o.rn, CASE WHEN used + size <= 3000 THEN used + size ELSE used END, CASE WHEN used + size <= 3000 THEN list_append(picked, doc_id) ELSE picked END FROM f JOIN o ON o.source = f.source AND o.rn = f.rn + 1), z AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY rn DESC) AS k FROM f) SELECT source, array_to_string(picked, ',') AS picked FROM z WHERE k = 1")
def l_memory_context(spark, d):
    docs = X.table(spark, d, "documents").where("text IS NOT NULL").select(F.col("source").alias("key"), F.substring("text", 1, 200).alias("claim"), "doc_id", "n_chars")
    first = docs.groupBy("key", "claim").agg(F.min("doc_id").alias("id"), F.min_by("n_chars", "doc_id").alias("n"))
    rows = first.select("key", "id", (-F.col("id")).alias("score"), F.least(F.col("n"), F.lit(700)).cast("long").alias("size"), F.lit("s").alias("source"), F.col("id").cast("string").alias("claim"))
    return M.budget_fill(rows, "key", 3000, 1_000_000).select(F.col("key").alias("source"), F.array_join(F.transform("picked", lambda x: x.cast("string")), ",").alias("picked"))


@query("l_promotion", "SELECT event_id FROM events WHERE event_type = 'purchase' AND value <= 100 AND user_id % 2 = 0")
def l_promotion(spark, d):
    rows = X.table(spark, d, "events").select("event_id", F.when(F.col("event_type") == "purchase", "supported").otherwise("weak").alias("status"), (F.col("value") / 200).alias("uncertainty"), F.lit("claim").alias("claim"), (1 - F.col("user_id") % 2).alias("n_evidence"))
    return M.promotable(rows).select("event_id")


@query("l_supplements", "SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM events WHERE event_id % 3 = 0) x WHERE rn <= 4")
def l_supplements(spark, d):
    e = X.table(spark, d, "events").where("event_id % 3 = 0")
    return e.withColumn("rn", F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))).where("rn <= 4").select("event_id")


@query("l_memory_stats", "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def l_memory_stats(spark, d):
    return X.table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"))


@query("l_pin", "SELECT doc_id, doc_id % 2 = 0 AS pinned FROM documents")
def l_pin(spark, d):
    from tessera.sources.adapters import upsert

    docs = X.table(spark, d, "documents").select("doc_id", F.lit(False).alias("pinned"))
    return upsert(docs, docs.where("doc_id % 2 = 0").withColumn("pinned", F.lit(True)), ["doc_id"], "doc_id")


@query("m_stage_state", sql("stages", "SELECT video_id, stage, arg_max(status, printf('%020d%010d', ts_us, event_id)) AS status, count(*) AS n_events, count(*) FILTER (WHERE status = 'failed_retryable') AS n_failures FROM stages GROUP BY 1, 2"))
def m_stage_state(spark, d):
    return P.stage_state(X.stages(spark, d), ["video_id", "stage"], ["ts_us", "event_id"])


@query("m_stage_timings", sql("stages", "SELECT event_id, round((n - ts_us) / 1e6::DOUBLE, 6) AS seconds FROM (SELECT event_id, ts_us, lead(ts_us) OVER (PARTITION BY video_id, stage ORDER BY ts_us, event_id) AS n FROM stages) x WHERE n IS NOT NULL"))
def m_stage_timings(spark, d):
    return P.stage_timings(X.stages(spark, d), ["video_id", "stage"], ["ts_us", "event_id"], "ts_us").select("event_id", F.round("seconds", 6).alias("seconds"))


@query("m_resume", sql("stages", "s AS (SELECT video_id, stage, arg_max(status, printf('%020d%010d', ts_us, event_id)) AS status FROM stages GROUP BY 1, 2) SELECT video_id, stage, CASE WHEN status IN ('succeeded', 'degraded') AND video_id % 3 > 0 THEN 'skip' ELSE 'run' END AS action FROM s"))
def m_resume(spark, d):
    s = P.stage_state(X.stages(spark, d), ["video_id", "stage"], ["ts_us", "event_id"])
    prints = s.select("video_id", "stage", F.lit("a").alias("fingerprint"), F.when(F.col("video_id") % 3 > 0, "a").otherwise("b").alias("current"))
    return P.resume(s, prints, ["video_id", "stage"])


@query("m_timeout", sql("items", "SELECT video_id, CASE WHEN 10 * max(end_ms) <= 1200000 THEN 180 WHEN 10 * max(end_ms) <= 2400000 THEN 240 ELSE 360 END AS timeout FROM items GROUP BY 1"))
def m_timeout(spark, d):
    return X.items(spark, d).groupBy("video_id").agg((F.max("end_ms") / 100).alias("s")).select("video_id", P.request_timeout(F.col("s")).alias("timeout"))


@query("m_retry_classify", "SELECT conv_id, turn, CASE WHEN status = 429 THEN 'cooldown' WHEN status IN (500, 502, 503, 504) OR regexp_matches(lower(text), 'timeout|timed out') THEN 'retry' ELSE 'fail' END AS class FROM (SELECT conv_id, turn, 400 + (conv_id * 7 + turn) % 120 AS status, CASE WHEN turn % 5 = 0 THEN 'Read timed out: ' ELSE '' END || coalesce(text, '') AS text FROM conversations) c")
def m_retry_classify(spark, d):
    """Turns of conversations as replies of a service, with a status."""
    from tessera.sources.adapters import retry_class

    status = 400 + (F.col("conv_id") * 7 + F.col("turn")) % 120
    said = F.concat(F.when(F.col("turn") % 5 == 0, "Read timed out: ").otherwise(""), F.coalesce("text", F.lit("")))
    return X.table(spark, d, "conversations").select("conv_id", "turn", retry_class(status, said).alias("class"))


@query("m_task_progress", "SELECT user_id, count(*) AS n, string_agg(event_type, ',' ORDER BY event_id) AS last FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM events) x WHERE rn <= 20 GROUP BY 1")
def m_task_progress(spark, d):
    return P.progress(X.table(spark, d, "events"), "user_id", ["event_id"], "event_type", 20)


@query("m_history_window", "SELECT conv_id, turn FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM conversations) x WHERE rn <= 6")
def m_history_window(spark, d):
    return P.history(X.table(spark, d, "conversations"), "conv_id", "turn").select("conv_id", "turn")


@query("m_latest_completed", sql("stages", "SELECT stage, max(ts_us) AS ts_us FROM stages WHERE status = 'succeeded' GROUP BY 1"))
def m_latest_completed(spark, d):
    return P.latest_completed(X.stages(spark, d), "stage", "ts_us")


@query("m_upload_validation", "SELECT page_id, lower(regexp_extract(name, '\\.[A-Za-z0-9]+$')) IN ('.mp4', '.mov', '.mkv', '.webm', '.mp3', '.wav', '.m4a') AND size > 0 AND size <= 4294967296 AS ok FROM (SELECT page_id, url || ['', '.MP4', '.exe', '.webm', '.wav'][1 + page_id % 5] AS name, (page_id * 100000007) % 6000000000 AS size FROM pages) p")
def m_upload_validation(spark, d):
    """Addresses as names of uploads."""
    from tessera.sources.adapters import upload_checks

    ends = F.element_at(F.array(*[F.lit(x) for x in ("", ".MP4", ".exe", ".webm", ".wav")]), (F.col("page_id") % 5 + 1).cast("int"))
    rows = X.table(spark, d, "pages").select("page_id", F.concat("url", ends).alias("name"), (F.col("page_id") * 100000007 % 6000000000).alias("size"))
    return upload_checks(rows, "name", "size").select("page_id", "ok")


def _stream(spark, d, columns):
    schema = X.table(spark, d, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d).select(*columns)


def _folder(spark):
    """A fresh checkpoint folder where the session keeps its checkpoints."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{base}/stream-{uuid.uuid4().hex}"


@query("m_stream_counts", sql("stages", "SELECT stage, status, count(*) AS n FROM stages GROUP BY 1, 2"))
def m_stream_counts(spark, d):
    rows = X.stages(spark, d)
    fold = rows.select("stage", "status", "event_id")
    source = _stream(spark, d, ["event_id"])
    return live.run_to_end(live.stage_counts(source.join(fold, "event_id")), "stage_counts_out", "complete", _folder(spark))


@query("n_timeline", sql("items", "SELECT video_id, item_ord, round(100.0::DOUBLE * (end_ms - start_ms) / sum(end_ms - start_ms) OVER (PARTITION BY video_id), 4) AS width FROM items"))
def n_timeline(spark, d):
    long = F.col("end_ms") - F.col("start_ms")
    return X.items(spark, d).select("video_id", "item_ord", F.round(100 * long / F.sum(long).over(Window.partitionBy("video_id")), 4).alias("width"))


@query("n_diagnostics", sql("items", "SELECT video_id, count(*) FILTER (WHERE item_ord % 4 = 0) AS unsupported, count(*) FILTER (WHERE trim(text) = '') AS missing FROM items GROUP BY 1"))
def n_diagnostics(spark, d):
    return X.items(spark, d).groupBy("video_id").agg(F.count_if(F.col("item_ord") % 4 == 0).alias("unsupported"), F.count_if(F.trim("text") == "").alias("missing"))


@query("n_progress", "SELECT event_id, round(0.2::DOUBLE + 0.6::DOUBLE * (event_id % 101) / 100, 6) AS shown FROM events")
def n_progress(spark, d):
    return X.table(spark, d, "events").select("event_id", F.round(0.2 + 0.6 * (F.col("event_id") % 101) / 100, 6).alias("shown"))


# --- plain relational categories ----------------------------------------------------------------------------------


@query("r_rollup", sql("evidence", "SELECT coalesce(video_id, '*') AS video_id, coalesce(evidence_type, '*') AS evidence_type, count(*) AS n FROM evidence GROUP BY ROLLUP (video_id, evidence_type)"))
def r_rollup(spark, d):
    return X.evidence(spark, d).rollup("video_id", "evidence_type").agg(F.count("*").alias("n")).select(F.coalesce("video_id", F.lit("*")).alias("video_id"), F.coalesce("evidence_type", F.lit("*")).alias("evidence_type"), "n")


@query("r_cube", "SELECT coalesce(event_type, '*') AS event_type, coalesce(u, -1) AS u, count(*) AS n FROM (SELECT event_type, user_id % 5 AS u FROM events) x GROUP BY CUBE (event_type, u)")
def r_cube(spark, d):
    e = X.table(spark, d, "events").select("event_type", (F.col("user_id") % 5).alias("u"))
    return e.cube("event_type", "u").agg(F.count("*").alias("n")).select(F.coalesce("event_type", F.lit("*")).alias("event_type"), F.coalesce("u", F.lit(-1)).alias("u"), "n")


@query("r_pivot", sql("evidence", "SELECT video_id, count(*) FILTER (WHERE evidence_type = 'speech') AS speech, count(*) FILTER (WHERE evidence_type = 'frame') AS frame, count(*) FILTER (WHERE evidence_type = 'frame_caption') AS frame_caption FROM evidence GROUP BY 1"))
def r_pivot(spark, d):
    return X.evidence(spark, d).groupBy("video_id").pivot("evidence_type", ["speech", "frame", "frame_caption"]).count().na.fill(0)


@query("r_join_aggregate", "SELECT n_name, count(*) AS orders, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")
def r_join_aggregate(spark, d):
    o, c, n = (X.table(spark, d, t) for t in ("orders", "customer", "nation"))
    rows = o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey)
    return rows.groupBy("n_name").agg(F.count("*").alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("r_set_operations", "SELECT event_type FROM events WHERE value > 50 INTERSECT SELECT event_type FROM events WHERE value < 60 EXCEPT SELECT 'error'")
def r_set_operations(spark, d):
    e = X.table(spark, d, "events")
    return e.where("value > 50").select("event_type").intersect(e.where("value < 60").select("event_type")).where("event_type <> 'error'")


@query("r_approx", None)
def r_approx(spark, d):
    return X.table(spark, d, "events").groupBy("event_type").agg(F.approx_count_distinct("user_id").alias("users"), F.percentile_approx("value", 0.5).alias("median"))


@query("r_session_windows", "WITH g AS (SELECT user_id, event_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) >= INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS nw FROM events), s AS (SELECT *, sum(nw) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, epoch_us(min(ts)) AS start_us, count(*) AS n FROM s GROUP BY user_id, k")
def r_session_windows(spark, d):
    e = X.table(spark, d, "events").withColumn("t", F.col("ts").cast("timestamp"))
    rows = e.groupBy(F.session_window("t", "30 minutes").alias("w"), "user_id").agg(F.count("*").alias("n"))
    return rows.select("user_id", F.unix_micros("w.start").alias("start_us"), "n")


@query("r_tumbling_windows", "SELECT event_type, epoch_us(time_bucket(INTERVAL 1 HOUR, ts)) AS start_us, count(*) AS n FROM events GROUP BY 1, 2")
def r_tumbling_windows(spark, d):
    e = X.table(spark, d, "events").withColumn("t", F.col("ts").cast("timestamp"))
    return e.groupBy("event_type", F.window("t", "1 hour").alias("w")).agg(F.count("*").alias("n")).select("event_type", F.unix_micros("w.start").alias("start_us"), "n")
