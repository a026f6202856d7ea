"""Queries of question analysis, planning and refinement decisions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import planning as P
from tessera.functions import routing as R
from tessera.plans.q_text import CHOICES_SQL, LOOKS_SQL, RELATION_SQL, TIMES_SQL
from tessera.plans.registry import query
from tessera.sources import fixtures as X
from tessera.sources.fixtures import sql


def _case(options, column="question", default="explanation", test="contains({c}, '{w}')"):
    return "CASE " + " ".join(f"WHEN {' OR '.join(test.format(c=column, w=w) for w in words)} THEN '{name}'" for name, words in options) + f" ELSE '{default}' END"


_TASK = "CASE " + " ".join(f"WHEN regexp_matches(question, '(?i){p}') THEN '{n}'" for n, p in P.TASKS) + " ELSE 'factual' END"


@query("e_classify_question", sql("asked", f"SELECT question_id, {_case(P.CLASSES)} AS class FROM asked"))
def e_classify_question(spark, d):
    return X.asked(spark, d).select("question_id", P.classify_question(F.col("question")).alias("class"))


_SAID = f"CASE WHEN regexp_matches(question, '{R.EXPLICIT_SPEECH}') THEN CASE WHEN regexp_matches(question, '{R.EXPLICIT_VISUAL}') THEN 'speech,visual' ELSE 'speech' END WHEN regexp_matches(question, '{R.EXPLICIT_VISUAL}') THEN 'visual' WHEN question_id % 2 = 0 THEN 'speech' ELSE 'visual' END"
_ANALYSIS = f"{TIMES_SQL}, a0 AS (SELECT *, {_TASK} AS task, {RELATION_SQL} AS relation, {_SAID} AS modalities, len({CHOICES_SQL}) > 0 AS choice_based FROM times), a AS (SELECT *, CASE WHEN len(spans) > 0 THEN 'interval' WHEN len(points) > 0 THEN 'point' WHEN regexp_matches(question, '{R.WHOLE_VIDEO}') THEN 'whole_video' WHEN relation = 'before_after' THEN 'event_local' ELSE 'none' END AS scope FROM a0)"


def _analyses(spark, d):
    q = X.asked(spark, d)
    return q.withColumn("a", P.analysis(F.col("question"), F.col("question_id") % 2 == 0))


@query("e_question_analysis", sql("asked", _ANALYSIS + " SELECT question_id, task, scope, relation, modalities, choice_based FROM a"))
def e_question_analysis(spark, d):
    return _analyses(spark, d).select("question_id", "a.task", "a.scope", "a.relation", F.array_join("a.modalities", ",").alias("modalities"), "a.choice_based")


_STRICT = "whole AND (" + " OR ".join(f"contains(question, '{w}')" for w in P.ALL_OF_IT) + ")"
_PLAN = f"p0 AS (SELECT *, CASE WHEN relation <> 'none' OR scope = 'whole_video' THEN 2 ELSE 1 END::BIGINT AS min_timestamps, scope = 'whole_video' AS whole, len(string_split(modalities, ',')) AS n_facts FROM a), p AS (SELECT *, {_STRICT} AS strict FROM p0)"


@query("e_evidence_plan", sql("asked", _ANALYSIS + ", " + _PLAN + " SELECT question_id, n_facts, min_timestamps, relation <> 'none' AS ordered, whole, CASE WHEN whole THEN 'whole_video' WHEN n_facts > 1 THEN 'multi_event' ELSE 'local' END AS target, CASE WHEN strict THEN 'strict' WHEN whole THEN 'best_effort' ELSE 'none' END AS completeness, NOT strict AS partial_ok FROM p"))
def e_evidence_plan(spark, d):
    return _analyses(spark, d).select("question_id", P.evidence_plan(F.col("question"), F.col("a")).alias("p")).select("question_id", "p.*")


@query("e_intent_view", sql("asked", _ANALYSIS + ", " + _PLAN + " SELECT question_id, CASE modalities WHEN 'speech' THEN 'speech' WHEN 'visual' THEN 'frame_caption' ELSE 'speech,frame_caption' END AS required, CASE modalities WHEN 'speech' THEN 'frame_caption' WHEN 'visual' THEN 'speech' ELSE '' END AS optional, modalities <> 'speech' AS visual, task IN ('explanation', 'critique', 'action_items') AS general_ok, CASE WHEN modalities <> 'speech' THEN min_timestamps ELSE 0 END AS min_visual_times FROM p"))
def e_intent_view(spark, d):
    rows = _analyses(spark, d).withColumn("p", P.evidence_plan(F.col("question"), F.col("a")))
    v = rows.select("question_id", P.intent_view(F.col("a"), F.col("p")).alias("v"))
    return v.select("question_id", F.array_join("v.required", ",").alias("required"), F.array_join("v.optional", ",").alias("optional"), "v.visual", "v.general_ok", "v.min_visual_times")


@query("e_retrieval_plan", sql("asked", r"c AS (SELECT question_id, regexp_matches(question, '[\x{4e00}-\x{9fff}]') AS cjk, trim(regexp_replace(question, '\s+', ' ', 'g')) AS plain FROM asked) SELECT question_id, concat_ws('|', CASE WHEN NOT cjk THEN 'Establish from the video' END, substr(trim('确认 ' || plain), 1, 500), CASE WHEN plain <> '' THEN substr(plain, 1, 500) END) AS queries FROM c"))
def e_retrieval_plan(spark, d):
    """Candidates in both scripts, with repeats and blanks, for every question asked."""
    q = F.col("question")
    options = F.array(F.lit("Establish  from the video"), F.concat(F.lit("确认 "), q), q, F.concat(q, F.lit(" ")), F.lit(" "))
    return X.asked(spark, d).select("question_id", F.array_join(P.retrieval_queries(q, options), "|").alias("queries"))


_TITLE = "An introduction to Spark joins 学习 and the said"
_TERMS = r"regexp_extract_all(question, '[A-Za-z0-9_\x{4e00}-\x{9fff}]{2,}')"


@query("e_relevance", sql("asked", f"""x AS (SELECT question_id, question, trim(question) AS q, {_TERMS} AS terms FROM asked UNION ALL SELECT -1, ' ', '', [] UNION ALL SELECT -2, '你好', '你好', ['你好'] UNION ALL SELECT -3, '晚饭 吃饭', '晚饭 吃饭', ['晚饭', '吃饭']),
 y AS (SELECT question_id, CASE WHEN q = '' THEN 'empty_question' WHEN q IN ({", ".join(f"'{w}'" for w in P.SMALL_TALK)}) THEN 'chat_smalltalk' WHEN len(list_filter(terms, lambda t: contains(lower('{_TITLE}'), lower(t)))) > 0 THEN 'question_terms_overlap_video_metadata_or_transcript'
  WHEN {" OR ".join(f"contains(lower(q), '{w}')" for w in P.VIDEO_WORDS)} THEN 'question_asks_about_video_content_or_time' WHEN len(terms) <= 2 THEN 'no_overlap_with_video_topic' ELSE 'conservative_relevance_possible' END AS reason FROM x)
 SELECT question_id, reason NOT IN ('empty_question', 'chat_smalltalk', 'no_overlap_with_video_topic') AS relevant, reason FROM y"""))
def e_relevance(spark, d):
    more = spark.createDataFrame([(-1, " "), (-2, "你好"), (-3, "晚饭 吃饭")], "question_id long, question string")
    rows = X.asked(spark, d).union(more)
    return rows.select("question_id", P.relevance(F.col("question"), F.lit(_TITLE)).alias("r")).select("question_id", "r.*")


@query("e_memory_gate", "SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 'current_video_only' WHEN event_id % 5 = 0 THEN 'search_history' WHEN event_id % 3 = 0 THEN 'current_video_only' WHEN event_id % 2 = 0 THEN 'search_history' ELSE 'current_video_only' END AS route, CASE WHEN event_id % 7 = 0 OR event_id % 5 = 0 THEN 'config' WHEN event_id % 3 = 0 THEN 'fallback' WHEN event_id % 2 = 0 THEN 'llm' ELSE 'fallback' END AS source FROM events")
def e_memory_gate(spark, d):
    k = F.col("event_id")
    mode = F.when(k % 7 == 0, "off").when(k % 5 == 0, "always").otherwise("auto")
    route = P.memory_route(mode, F.lit("http"), k % 3 != 0, F.when(k % 2 == 0, "search_history").otherwise("not a route"))
    return X.table(spark, d, "events").select("event_id", route.alias("r")).select("event_id", "r.route", "r.source")


@query("h_trigger_reasons", "SELECT event_id, concat_ws(';', CASE WHEN event_id % 2 = 0 THEN 'gap' END, CASE WHEN event_id % 3 = 0 THEN 'fact unsupported: f1' END, CASE WHEN event_id % 5 = 0 THEN 'no_evidence' END, CASE WHEN event_id % 7 = 0 THEN 'low_confidence' END, CASE WHEN event_id % 5 = 0 OR event_id % 11 = 0 THEN 'legacy_insufficient_answer' END) AS reasons FROM events")
def h_trigger_reasons(spark, d):
    k = F.col("event_id")
    none = F.array().cast("array<string>")
    unmet = F.when(k % 2 == 0, F.array(F.lit("gap"), F.lit("gap"))).otherwise(none)
    facts = F.when(k % 3 == 0, F.array(F.lit("f1"))).otherwise(none)
    why = P.trigger_reasons(unmet, facts, k % 5, F.when(k % 7 == 0, "low").otherwise("high"), k % 11 == 0)
    return X.table(spark, d, "events").select("event_id", F.array_join(why, ";").alias("reasons"))


@query("h_diagnostics", "SELECT user_id, CASE WHEN bool_and(event_id % 4 > 0) THEN 'sufficient' WHEN bool_or(event_id % 4 > 0) THEN 'partial' ELSE 'insufficient' END AS grounding FROM events GROUP BY 1")
def h_diagnostics(spark, d):
    e = X.table(spark, d, "events").groupBy("user_id").agg(F.collect_set(F.when(F.col("event_id") % 4 > 0, "supported").otherwise("unsupported")).alias("s"))
    return e.select("user_id", P.grounding(F.col("s")).alias("grounding"))


@query("s_followups", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 2 WHEN event_id % 3 = 1 THEN 2 ELSE 3 END::BIGINT AS n FROM events")
def s_followups(spark, d):
    k = F.col("event_id")
    given = F.when(k % 3 == 0, F.array(F.lit(" a "), F.lit(" "), F.lit("b")))
    return X.table(spark, d, "events").select("event_id", F.size(P.followups(given, F.when(k % 3 == 1, "evidence_check").otherwise("summary"), k % 3 >= 1)).cast("long").alias("n"))


@query("s_intent_types", "SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'speech,frame_caption' WHEN 1 THEN 'frame,speech' ELSE 'frame_caption' END AS types FROM events")
def s_intent_types(spark, d):
    k = F.col("event_id")
    required = F.when(k % 3 == 0, F.array(F.lit("ocr"))).when(k % 3 == 1, F.array(F.lit("frame"))).otherwise(F.array(F.lit("frame_caption")))
    optional = F.when(k % 3 == 1, F.array(F.lit("speech"), F.lit("frame"))).otherwise(F.array(F.lit("other")))
    return X.table(spark, d, "events").select("event_id", F.array_join(P.intent_types(required, optional), ",").alias("types"))


@query("s_frame_name_ts", "SELECT page_id, CASE WHEN digits = '' THEN 0 ELSE CAST(digits AS DOUBLE) END AS seconds FROM (SELECT page_id, regexp_replace(url || '.jpg', '[^0-9]', '', 'g') AS digits FROM pages) p")
def s_frame_name_ts(spark, d):
    """Addresses as names of frames."""
    return X.table(spark, d, "pages").select("page_id", P.frame_name_seconds(F.concat("url", F.lit(".jpg"))).alias("seconds"))


@query("s_auto_refine", sql("asked", f"SELECT question_id, {LOOKS_SQL} AND question_id % 2 = 1 AS refine FROM asked"))
def s_auto_refine(spark, d):
    odd = F.col("question_id") % 2 == 1
    return X.asked(spark, d).select("question_id", P.auto_refine(F.col("question"), F.when(odd, "low").otherwise("high"), F.lit(0.5)).alias("refine"))


@query("s_abstain", sql("query_texts", "SELECT query_id, CASE WHEN query_id % 4 = 0 THEN 'insufficient_evidence' ELSE 'answered' END AS outcome FROM query_texts"))
def s_abstain(spark, d):
    q = X.query_texts(spark, d).select("query_id")
    answered = q.where("query_id % 4 <> 0").select("query_id", F.lit("answered").alias("outcome"))
    return answered.union(q.join(answered, "query_id", "left_anti").select("query_id", F.lit("insufficient_evidence")))


@query("a_read_artifacts", sql("items", "SELECT video_id, count(*) AS n, min(start_ms) / 1000.0::DOUBLE AS start_s FROM items GROUP BY 1"))
def a_read_artifacts(spark, d):
    """Segment documents as JSON text, one a source, read with their declared schema."""
    segment = F.struct(F.col("item_ord").cast("string").alias("segment_id"), (F.col("start_ms") / 1000).alias("start"), F.col("text").alias("transcript_text"))
    docs = X.items(spark, d).groupBy("video_id").agg(F.to_json(F.struct(F.collect_list(segment).alias("segments"))).alias("doc"))
    read = docs.select("video_id", F.explode(F.from_json("doc", "segments array<struct<segment_id:string,start:double,transcript_text:string,visual_summary:string>>")["segments"]).alias("s"))
    return read.groupBy("video_id").agg(F.count("*").alias("n"), F.min("s.start").alias("start_s"))
