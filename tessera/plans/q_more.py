"""Queries of media boundaries, formats, traces, samples, restarts and admission."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions import formats as O
from tessera.operators import retrieve as R
from tessera.operators import state as P
from tessera.plans.registry import query
from tessera.sources import fixtures as X
from tessera.sources import media as A
from tessera.sources.fixtures import sql


@query("a_json3_track", "SELECT event_id, CASE event_id % 4 WHEN 0 THEN '/own/' || event_id WHEN 1 THEN '/auto/' || event_id WHEN 2 THEN '/second/' || event_id END AS path FROM events")
def a_json3_track(spark, d):
    k = F.col("event_id").cast("string")
    own = F.concat(F.lit('{"subtitles":{"en":[{"ext":"vtt","filepath":"/x"},{"ext":"json3","filepath":"/own/'), k, F.lit('"}]},"automatic_captions":{"en":[{"ext":"json3","filepath":"/auto"}]}}'))
    auto = F.concat(F.lit('{"subtitles":{},"automatic_captions":{"de":[{"ext":"json3","filepath":"/auto/'), k, F.lit('"}]}}'))
    second = F.concat(F.lit('{"subtitles":{"en":[{"ext":"json3"}],"de":[{"ext":"json3","filepath":"/second/'), k, F.lit('"}]}}'))
    info = F.when(F.col("event_id") % 4 == 0, own).when(F.col("event_id") % 4 == 1, auto).when(F.col("event_id") % 4 == 2, second).otherwise('{"title":"none"}')
    return X.table(spark, d, "events").select("event_id", A.json3_track(info).alias("path"))


@query("a_cookie_spec", "SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'chrome' WHEN 1 THEN 'firefox' ELSE event_type END AS browser, CASE event_id % 3 WHEN 1 THEN 'Profile ' || user_id END AS profile, event_id % 3 < 2 AS known FROM events")
def a_cookie_spec(spark, d):
    k = F.col("event_id") % 3
    value = F.when(k == 0, " Chrome : ").when(k == 1, F.concat(F.lit("firefox: Profile "), F.col("user_id").cast("string"))).otherwise(F.upper("event_type"))
    return X.table(spark, d, "events").select("event_id", A.cookie_spec(value).alias("c")).select("event_id", "c.browser", "c.profile", "c.known")


@query("a_cookie_file", "SELECT event_id, event_id % 6 IN (0, 1, 4) AS ok FROM events")
def a_cookie_file(spark, d):
    row = F.concat_ws("\t", F.lit("host"), F.lit("TRUE"), F.lit("/"), F.lit("FALSE"), F.lit("0"), F.col("event_type"), F.col("user_id").cast("string"))
    kinds = [F.concat(F.lit("\n# Netscape HTTP Cookie File\n"), F.lit("a=b")), F.concat(F.lit("# a note\n\n"), row), F.lit("session=abc"), F.lit("  \n"), F.concat(F.lit("plain words\r\n"), row, F.lit("\nx=y")), F.concat(F.lit("https://x\n"), row)]
    return X.table(spark, d, "events").select("event_id", A.is_cookie_file(F.element_at(F.array(*kinds), (F.col("event_id") % 6 + 1).cast("int"))).alias("ok"))


@query("a_recognised_items", sql("items", "SELECT video_id, rn - 1 AS item_ord, start_ms / 1000.0::DOUBLE AS start_s, end_ms / 1000.0::DOUBLE AS end_s, text FROM (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY item_ord) AS rn FROM items WHERE text <> '' AND video_id % 5 > 0) x UNION ALL SELECT video_id, 0, 0, 0, 'whole ' || video_id FROM items WHERE video_id % 5 = 0 GROUP BY video_id"))
def a_recognised_items(spark, d):
    part = F.struct("item_ord", (F.col("start_ms") / 1000).alias("start"), (F.col("end_ms") / 1000).alias("end"), "text")
    rows = X.items(spark, d).groupBy("video_id").agg(F.array_sort(F.collect_list(part)).alias("segments"))
    reply = F.when(F.col("video_id") % 5 > 0, F.to_json(F.struct("segments"))).otherwise(F.to_json(F.struct(F.concat(F.lit("whole "), F.col("video_id").cast("string")).alias("text"))))
    return A.recognised_items(rows.select("video_id", reply.alias("reply")), "video_id", "reply")


@query("a_mock", "SELECT v AS video_id, i AS item_ord, i * 55.0::DOUBLE AS start_s, i * 55.0::DOUBLE + 50 AS end_s, printf('f_%010d', i * 55000) AS frame_id FROM (SELECT unnest(generate_series(0, (SELECT count(DISTINCT conv_id) FROM conversations) - 1)) AS v) a, generate_series(0, 5) b(i)")
def a_mock(spark, d):
    """A stand-in transcript for each conversation."""
    items = A.mock_items(spark, X.table(spark, d, "conversations").agg(F.countDistinct("conv_id")).first()[0])
    frames = A.mock_frames(items)
    return items.join(frames.select("video_id", F.col("ts_s").alias("start_s"), "frame_id"), ["video_id", "start_s"]).select("video_id", "item_ord", "start_s", "end_s", "frame_id")


@query("a_frame_command", "SELECT event_id, 'ffmpeg -y -hwaccel none -analyzeduration 100M -probesize 100M ' || CASE event_id % 3 WHEN 0 THEN '' WHEN 1 THEN '-ss 2.5 ' ELSE '-ss 2.5 -t ' || CASE WHEN event_id % 2 = 0 THEN '4.5 ' ELSE '0.0 ' END END || '-i in_' || event_id || '.mp4 -vf fps=0.5 -q:v 3 out_%06d.jpg' AS command FROM events")
def a_frame_command(spark, d):
    k = F.col("event_id")
    start, end = F.when(k % 3 > 0, 2.5), F.when(k % 3 == 2, F.when(k % 2 == 0, 7.0).otherwise(1.0))
    command = A.frame_command(F.concat(F.lit("in_"), k.cast("string"), F.lit(".mp4")), F.lit("out_%06d.jpg"), F.lit(0.5), start, end)
    return X.table(spark, d, "events").select("event_id", F.array_join(command, " ").alias("command"))


@query("a_other_codec", "SELECT event_id, event_id % 3 = 0 AS other FROM events")
def a_other_codec(spark, d):
    said = F.when(F.col("event_id") % 6 == 0, "[AV1 @ 0x1] hardware").when(F.col("event_id") % 6 == 3, "Function Not implemented").otherwise("No space left on device")
    return X.table(spark, d, "events").select("event_id", A.needs_other_codec(said).alias("other"))


@query("a_search_rows", "SELECT event_id, CAST(g.i AS INT) AS pos, CASE event_id % 4 WHEN 0 THEN 'row ' || g.i WHEN 1 THEN 'plain ' || event_id ELSE 'one' || chr(10) || 'two' END AS content FROM events, (SELECT unnest([0, 1]) AS i) g WHERE event_id % 4 < 3 AND (event_id % 4 = 0 OR g.i = 0)")
def a_search_rows(spark, d):
    k = F.col("event_id").cast("string")
    reply = F.when(F.col("event_id") % 4 == 0, '{"results":[{"content":"row 0"},{"content":"row 1"}]}').when(F.col("event_id") % 4 == 1, F.concat(F.lit('{"result":"plain '), k, F.lit('"}'))).when(F.col("event_id") % 4 == 2, '{"content":[{"text":"one"},{"text":"two"}]}').otherwise('{"items":[]}')
    return A.search_rows(X.table(spark, d, "events").select("event_id", reply.alias("reply")), "event_id", "reply")


@query("b_endpoint", "WITH g AS (SELECT page_id, ' ' || url || ['', '/', '/chat/completions/', '/EMBEDDINGS'][1 + page_id % 4] || ' ' AS given FROM pages), b AS (SELECT page_id, rtrim(regexp_replace(regexp_replace(rtrim(trim(given), '/'), '/chat/completions$', '', 'i'), '/embeddings$', '', 'i'), '/') AS base FROM g) SELECT page_id, base, CASE WHEN ends_with(base, 'embeddings') THEN base ELSE base || '/embeddings' END AS url FROM b")
def b_endpoint(spark, d):
    """Addresses as services', with and without the path of a call."""
    ends = F.element_at(F.array(*[F.lit(x) for x in ("", "/", "/chat/completions/", "/EMBEDDINGS")]), (F.col("page_id") % 4 + 1).cast("int"))
    base = O.base_url(F.concat(F.lit(" "), F.col("url"), ends, F.lit(" ")))
    return X.table(spark, d, "pages").select("page_id", base.alias("base"), O.endpoint(base, "embeddings").alias("url"))


@query("g_trace", sql("evidence", "r AS (SELECT video_id, doc_id, row_number() OVER (PARTITION BY video_id ORDER BY length(text) DESC NULLS LAST, doc_id) AS rank FROM evidence), s AS (SELECT video_id, doc_id, row_number() OVER (PARTITION BY video_id ORDER BY doc_id DESC) AS rank FROM evidence) SELECT video_id, (SELECT string_agg(doc_id::VARCHAR, ',' ORDER BY rank) FROM r WHERE r.video_id = v.video_id AND rank <= 20) AS by_length, (SELECT string_agg(doc_id::VARCHAR, ',' ORDER BY rank) FROM s WHERE s.video_id = v.video_id AND rank <= 20) AS by_id FROM (SELECT DISTINCT video_id FROM evidence) v"))
def g_trace(spark, d):
    e = X.evidence(spark, d)
    w = Window.partitionBy("video_id")
    one = e.select("video_id", "doc_id", F.row_number().over(w.orderBy(F.desc_nulls_last(F.length("text")), "doc_id")).alias("rank"))
    two = e.select("video_id", "doc_id", F.row_number().over(w.orderBy(F.desc("doc_id"))).alias("rank"))
    rows = R.trace({"by_length": one, "by_id": two}, ["video_id"], "doc_id")
    return rows.select("video_id", *[F.array_join(F.transform(c, lambda x: x["doc_id"].cast("string")), ",").alias(c) for c in ("by_length", "by_id")])


@query("j_case_sample", "SELECT item_id FROM (SELECT item_id, row_number() OVER (ORDER BY sha256('42:' || item_id), item_id) AS rn FROM benchmark) x WHERE rn <= 20")
def j_case_sample(spark, d):
    from tessera.operators.metrics import case_sample

    return case_sample(X.table(spark, d, "benchmark").select("item_id"), "item_id", 20, 42)


@query("j_seeded_sample")
def j_seeded_sample(spark, d):
    """Twenty documents' ids, as text, that the standard library's generator draws of all."""
    from tessera.operators.metrics import seeded_sample

    docs = X.table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("case_id"))
    return seeded_sample(docs, "case_id", 20, 42)


@query("j_router_smoke", "SELECT count(*) AS total, count(*) FILTER (WHERE event_id % 3 > 0 AND event_id % 2 = 0) AS passed FROM events")
def j_router_smoke(spark, d):
    from tessera.operators.metrics import smoke

    k = F.col("event_id")
    rows = X.table(spark, d, "events").select(F.when(k % 3 > 0, "llm").otherwise("fallback").alias("source"), F.lit("search_history").alias("expected"), F.when(k % 2 == 0, "search_history").otherwise("current_video_only").alias("route"))
    return smoke(rows)


@query("m_restarts", sql("stages", "f AS (SELECT video_id, stage, event_id, row_number() OVER (PARTITION BY video_id, stage ORDER BY ts_us, event_id) AS attempt FROM stages WHERE status = 'failed_retryable') SELECT video_id, stage, event_id, attempt, attempt > 2 AS exhausted, CASE WHEN attempt <= 2 THEN CASE WHEN event_id % 4 = 0 THEN greatest(30.0, 1.5 * attempt) ELSE least(5.0, 1.5 * attempt) END END::DOUBLE AS wait_s FROM f WHERE attempt <= 3"))
def m_restarts(spark, d):
    failed = X.stages(spark, d).where("status = 'failed_retryable'")
    return P.restarts(failed, ["video_id", "stage"], ["ts_us", "event_id"], F.col("event_id") % 4 == 0).select("video_id", "stage", "event_id", "attempt", "exhausted", "wait_s")


@query("m_admission")
def m_admission(spark, d):
    """Events as tasks of five servers that take a thousand minutes and their value in seconds."""
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    tasks = X.table(spark, d, "events").select((F.col("user_id") % 5).alias("server"), F.col("event_id").alias("task_id"), us.alias("submitted"), (us + (F.col("value") * 1000000).cast("long") + 60_000_000_000).alias("finished"))
    return P.admitted(tasks, "server", 4)


@query("m_lock_holders", "SELECT user_id, arg_min(event_id, printf('%020d%010d', epoch_us(ts), event_id)) AS event_id FROM events WHERE event_type <> 'signup' GROUP BY 1")
def m_lock_holders(spark, d):
    e = X.table(spark, d, "events").withColumn("released", F.col("event_type") == "signup")
    return P.lock_holders(e, "user_id", "event_id", ["ts", "event_id"])


@query("s_evidence_block", sql("evidence", "SELECT doc_id, 'evidence_id=' || doc_id || chr(10) || 'segment_id=s' || doc_id || chr(10) || 'type=' || evidence_type || chr(10) || 'time=' || printf('[%02d:%02d:%02d]', s // 3600, s % 3600 // 60, s % 60) || chr(10) || printf('start=%.2f', start_s) || chr(10) || printf('end=%.2f', end_s) || chr(10) || 'frame_id=' || CASE WHEN evidence_type = 'frame' THEN 'f' || doc_id ELSE '' END || chr(10) || 'text=' || coalesce(substr(text, 1, 420), '') AS block FROM (SELECT *, CAST(CASE WHEN evidence_type = 'frame' THEN start_s + 1 ELSE start_s END AS BIGINT) AS s FROM evidence) e"))
def s_evidence_block(spark, d):
    k, frame = F.col("doc_id").cast("string"), F.col("evidence_type") == "frame"
    block = O.evidence_block(k, F.concat(F.lit("s"), k), F.col("evidence_type"), F.col("start_s"), F.col("end_s"), F.col("text"), F.when(frame, F.col("start_s") + 1.25), F.when(frame, F.concat(F.lit("f"), k)))
    return X.evidence(spark, d).select("doc_id", block.alias("block"))


@query("s_segment_block", sql("items", "SELECT video_id, item_ord, 'segment_id=' || item_ord || chr(10) || printf('start=%.2f', start_ms / 1000.0::DOUBLE) || chr(10) || printf('end=%.2f', end_ms / 1000.0::DOUBLE) || chr(10) || 'transcript_text=' || substr(text, 1, 500) || chr(10) || 'representative_frame_ids=[''f' || item_ord || ''']' || chr(10) || 'visual_captions=' || substr(speaker, 1, 300) || chr(10) || 'evidence_types=[''speech'', ''frame'']' AS block FROM items"))
def s_segment_block(spark, d):
    k = F.col("item_ord").cast("string")
    block = O.segment_block(k, F.col("start_ms") / 1000, F.col("end_ms") / 1000, F.col("text"), F.array(F.concat(F.lit("f"), k)), F.col("speaker"), F.array(F.lit("speech"), F.lit("ocr"), F.lit("frame")))
    return X.items(spark, d).select("video_id", "item_ord", block.alias("block"))


@query("s_profile_defaults", "SELECT user_id, CASE WHEN user_id % 3 = 0 THEN 'weak_visual' ELSE 'strong' END AS class, CASE WHEN user_id % 3 = 0 THEN 0.0::DOUBLE ELSE (user_id % 10) / 10.0 END AS strength, CASE WHEN user_id % 3 = 0 THEN 'no_local_video_or_classifier_failed' ELSE 'measured' END AS reason FROM (SELECT DISTINCT user_id FROM events) e")
def s_profile_defaults(spark, d):
    from tessera.operators.frames import with_default_profiles

    users = X.table(spark, d, "events").select("user_id").distinct()
    known = users.where("user_id % 3 <> 0").select("user_id", F.lit("strong").alias("class"), (F.col("user_id") % 10 / 10).alias("strength"), F.lit("measured").alias("reason"))
    return with_default_profiles(users, known, "user_id")


@query("s_outline", sql("items", "SELECT video_id, string_agg(item_ord::VARCHAR, ',' ORDER BY item_ord) FILTER (WHERE rn <= 12) AS items, string_agg('q' || item_ord, ',' ORDER BY item_ord) FILTER (WHERE rn <= 8) AS questions FROM (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY item_ord) AS rn FROM items) x GROUP BY 1"))
def s_outline(spark, d):
    from tessera.operators.story import planner_outline

    rows = X.items(spark, d).groupBy("video_id").agg(F.array_sort(F.collect_list("item_ord")).alias("o"))
    listed = rows.select("video_id", F.transform("o", lambda x: x.cast("string")).alias("outline"), F.transform("o", lambda x: F.concat(F.lit("q"), x.cast("string"))).alias("questions"))
    found = planner_outline(listed)
    return found.select("video_id", F.array_join("outline", ",").alias("items"), F.array_join("questions", ",").alias("questions"))


@query("s_tool_guards", "SELECT event_id, greatest(1, event_id % 5 - 2) AS top_k, greatest(1, event_id % 4 - 1) AS max_ranges, greatest(0.0, event_id % 7 - 3)::DOUBLE AS padding FROM events")
def s_tool_guards(spark, d):
    from tessera.functions.planning import guarded

    k = F.col("event_id")
    return X.table(spark, d, "events").select("event_id", guarded(k % 5 - 2, k % 4 - 1, (k % 7 - 3).cast("double")).alias("g")).select("event_id", "g.top_k", "g.max_ranges", "g.padding")


@query("s_segments_by_id", sql("items", "SELECT c.video_id, c.item_ord AS cited, coalesce(i.text, '') AS text, i.text IS NOT NULL AS known FROM (SELECT video_id, item_ord + 2 AS item_ord FROM items) c LEFT JOIN items i ON i.video_id = c.video_id AND i.item_ord = c.item_ord"))
def s_segments_by_id(spark, d):
    items = X.items(spark, d).select("video_id", "item_ord", "text")
    cited = items.select("video_id", (F.col("item_ord") + 2).alias("item_ord"))
    rows = cited.join(items, ["video_id", "item_ord"], "left")
    return rows.select("video_id", F.col("item_ord").alias("cited"), F.coalesce("text", F.lit("")).alias("text"), F.col("text").isNotNull().alias("known"))


@query("s_frame_path", "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN '/v/frames/a/f_' || event_id || '.jpg' END AS path FROM events")
def s_frame_path(spark, d):
    from tessera.sources.adapters import frame_paths

    e = X.table(spark, d, "events")
    wanted = e.select("event_id", F.concat(F.lit("f_"), F.col("event_id").cast("string")).alias("frame_id"))
    files = e.where("event_id % 2 = 0").select(F.explode(F.array(F.concat(F.lit("/v/frames/b/f_"), F.col("event_id").cast("string"), F.lit(".png")), F.concat(F.lit("/v/frames/a/f_"), F.col("event_id").cast("string"), F.lit(".jpg")))).alias("path"))
    return frame_paths(wanted, files, "frame_id").select("event_id", "path")


@query("s_user_error", "SELECT doc_id, CASE WHEN contains(m, 'OPENAI_API_KEY') OR contains(m, 'LLM config') THEN 'LLM API key 未配置或不可用。' WHEN contains(m, 'embedding_unavailable') THEN 'Embedding 不可用，请检查 EMBEDDING_MODEL / API 配置。' ELSE substr(regexp_extract(m, '^([^\r\n]*)', 1), 1, 1000) END AS said FROM (SELECT doc_id, ['', 'missing OPENAI_API_KEY: ', 'embedding_unavailable: ', ''][1 + doc_id % 4] || text AS m FROM documents) x")
def s_user_error(spark, d):
    """Texts of documents as messages of a failure."""
    opens = F.element_at(F.array(*[F.lit(x) for x in ("", "missing OPENAI_API_KEY: ", "embedding_unavailable: ", "")]), (F.col("doc_id") % 4 + 1).cast("int"))
    return X.table(spark, d, "documents").select("doc_id", O.user_error(F.concat(opens, F.col("text"))).alias("said"))


@query("s_append_once", "SELECT event_id FROM events WHERE event_id % 3 <> 0")
def s_append_once(spark, d):
    from tessera.sources.adapters import append_once

    e = X.table(spark, d, "events").select("event_id")
    return append_once(e.where("event_id % 3 = 0"), e.union(e), "event_id")


@query("s_yaml_list", sql("stages", "SELECT video_id, '[' || string_agg('\"' || stage || '\"', ', ' ORDER BY stage) || ']' AS stages FROM (SELECT DISTINCT video_id, stage FROM stages) x GROUP BY 1"))
def s_yaml_list(spark, d):
    rows = X.stages(spark, d).groupBy("video_id").agg(F.array_sort(F.collect_set("stage")).alias("s"))
    return rows.select("video_id", O.yaml_list(F.col("s")).alias("stages"))


@query("s_score_prompts", sql("items", "SELECT video_id, count(*) AS n, string_agg('【第' || rn || '组】' || chr(10) || 'frame_id: ' || item_ord || chr(10) || printf('timestamp: %.2fs', start_ms / 1000.0::DOUBLE) || chr(10) || '输入文本：' || substr(text, 1, 900), chr(10) || chr(10) ORDER BY rn) AS prompt FROM (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY item_ord) AS rn FROM items) x GROUP BY 1"))
def s_score_prompts(spark, d):
    pairs = X.items(spark, d).select("video_id", "item_ord", F.col("item_ord").alias("frame_id"), (F.col("start_ms") / 1000).alias("ts_s"), "text")
    return O.score_prompts(pairs, "video_id", "item_ord")


@query("s_checked_scores", "SELECT event_id, CASE WHEN event_id % 4 > 0 THEN least(event_id % 4, 2) END AS n FROM events")
def s_checked_scores(spark, d):
    from tessera.functions.text import parse_scores

    k = F.col("event_id")
    said = F.array_join(F.transform(F.sequence(F.lit(1).cast("long"), F.greatest(k % 4, F.lit(1))), lambda i: F.lit("置信度：0.5")), "\n")
    found = O.checked_scores(F.when(k % 4 > 0, parse_scores(said)).otherwise(F.array().cast("array<double>")), F.least(k % 4, F.lit(2)))
    return X.table(spark, d, "events").select("event_id", F.size(found).cast("long").alias("n")).withColumn("n", F.when(F.col("n") >= 0, F.col("n")))
