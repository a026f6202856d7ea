"""Rule analysis of questions, evidence and retrieval plans, relevance, refinement triggers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions import routing as R
from tessera.functions.text import collapse, has_cjk
from tessera.functions.timeparse import choices, intervals, point_times

#: Ordered word lists of the question classes (fixed values): the first class with a word wins.
CLASSES = [
    ("time_navigation", ["分钟", "秒", "时间点", "十分钟", ":", "："]),
    ("action_items", ["操作建议", "操作上的建议", "实操建议", "行动建议", "风控建议", "交易建议", "清单", "怎么做"]),
    ("summary", ["总结", "核心", "概括", "主要论点"]),
    ("explanation", ["为什么", "解释", "什么意思", "怎么理解"]),
    ("evidence_check", ["证据", "依据", "是否支持", "证明"]),
    ("comparison", ["对比", "比较", "区别"]),
    ("navigation", ["跳到", "时间", "哪里", "哪一段"]),
    ("critique", ["漏洞", "反驳", "问题", "批判", "局限"]),
    ("action_items", ["行动", "步骤"]),
]
#: Ordered patterns of the task types (fixed values).
TASKS = [
    ("summary", r"总结|概括|主要内容|\bsummar(?:y|ize)\b|\boverview\b"), ("evidence_check", r"证据|依据|是否支持|证明|\bevidence\b|\bsupport\b"),
    ("comparison", r"比较|对比|区别|\bcompar(?:e|ison)\b|\bdifference\b"), ("critique", r"批判|局限|漏洞|反驳|\bcritique\b|\blimitation\b"),
    ("action_items", r"行动建议|操作建议|风控建议|清单|\baction items?\b|\brecommendations?\b"), ("procedure", r"步骤|流程|阶段|如何制作|\bprocedure\b|\bsteps?\b"),
    ("explanation", r"为什么|解释|怎么理解|\bwhy\b|\bexplain\b"),
]
ALL_OF_IT = ["完整", "全部", "所有", "一个都不要漏"]
VIDEO_WORDS = ["视频", "作者", "这段", "这里", "里面", "提到", "讲了", "总结", "核心观点", "画面", "图中", "界面", "按钮", "显示", "演示", "十分钟", "分钟", "秒", "video", "clip", "footage", "shown", "happens"]
SMALL_TALK = ["你好", "谢谢", "hello", "hi"]


def any_of(text: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(w)) for w in words])


def _first(options: list[tuple[str, Column]], default: str) -> Column:
    out = F.lit(default)
    for name, test in reversed(options):
        out = F.when(test, name).otherwise(out)
    return out


def classify_question(question: Column) -> Column:
    return _first([(name, any_of(question, words)) for name, words in CLASSES], "explanation")


def task_type(question: Column) -> Column:
    return _first([(name, R.matches(question, "(?i)" + pattern)) for name, pattern in TASKS], "factual")


def analysis(question: Column, has_speech: Column) -> Column:
    """(task, scope, relation, modalities, choice_based) of a question, by rules alone."""
    relation = R.temporal_relation(question)
    scope = (
        F.when(F.size(intervals(question)) > 0, "interval").when(F.size(point_times(question)) > 0, "point").when(R.matches(question, R.WHOLE_VIDEO), "whole_video")
        .when(relation == "before_after", "event_local").otherwise("none")
    )
    said = F.filter(F.array(F.when(R.matches(question, R.EXPLICIT_SPEECH), "speech"), F.when(R.matches(question, R.EXPLICIT_VISUAL), "visual")), lambda x: x.isNotNull())
    modalities = F.when(F.size(said) > 0, said).when(has_speech, F.array(F.lit("speech"))).otherwise(F.array(F.lit("visual")))
    return F.struct(task_type(question).alias("task"), scope.alias("scope"), relation.alias("relation"), modalities.alias("modalities"), (F.size(choices(question)) > 0).alias("choice_based"))


def evidence_plan(question: Column, found: Column) -> Column:
    """(n_facts, min_timestamps, ordered, whole, target, completeness, partial_ok) from an analysis."""
    ordered = found["relation"] != "none"
    whole = found["scope"] == "whole_video"
    n = F.size(found["modalities"])
    strict = whole & any_of(question, ALL_OF_IT)
    return F.struct(
        n.cast("long").alias("n_facts"), F.when(ordered | whole, 2).otherwise(1).cast("long").alias("min_timestamps"), ordered.alias("ordered"), whole.alias("whole"),
        F.when(whole, "whole_video").when(n > 1, "multi_event").otherwise("local").alias("target"), F.when(strict, "strict").when(whole, "best_effort").otherwise("none").alias("completeness"), (~strict).alias("partial_ok"),
    )


def intent_view(found: Column, plan: Column) -> Column:
    """The older view of a question: evidence types, visual need, whether general knowledge may help."""
    required = F.filter(F.array(F.when(F.array_contains(found["modalities"], "speech"), "speech"), F.when(F.array_contains(found["modalities"], "visual"), "frame_caption")), lambda x: x.isNotNull())
    optional = F.array_except(F.array(F.lit("speech"), F.lit("frame_caption")), required)
    visual = F.array_contains(found["modalities"], "visual")
    return F.struct(required.alias("required"), optional.alias("optional"), visual.alias("visual"), found["task"].isin("explanation", "critique", "action_items").alias("general_ok"), F.when(visual, plan["min_timestamps"]).otherwise(0).cast("long").alias("min_visual_times"))


def retrieval_queries(question: Column, candidates: Column, most: int = 8) -> Column:
    """Distinct candidates in order, in the question's script, the first ``most``; the question itself if none is left."""
    plain = F.filter(F.transform(candidates, collapse), lambda x: (x != "") & (~has_cjk(question) | has_cjk(x)))
    kept = F.slice(F.transform(F.array_distinct(plain), lambda x: F.substring(x, 1, 500)), 1, most)
    return F.when(F.size(kept) > 0, kept).otherwise(F.array(question))


def relevance(question: Column, video_text: Column) -> Column:
    """(relevant, reason) of a question to a video's title and first segments."""
    terms = F.transform(F.regexp_extract_all(question, F.lit(r"[A-Za-z0-9_\x{4e00}-\x{9fff}]{2,}"), F.lit(0)), lambda t: F.lower(t))
    low = F.lower(video_text)
    pick = lambda ok, why: F.struct(F.lit(ok).alias("relevant"), F.lit(why).alias("reason"))
    q = F.trim(question)
    return (
        F.when(q == "", pick(False, "empty_question")).when(q.isin(SMALL_TALK), pick(False, "chat_smalltalk"))
        .when(F.exists(terms, lambda t: F.contains(low, t)), pick(True, "question_terms_overlap_video_metadata_or_transcript"))
        .when(any_of(F.lower(q), VIDEO_WORDS), pick(True, "question_asks_about_video_content_or_time"))
        .when(F.size(terms) <= 2, pick(False, "no_overlap_with_video_topic")).otherwise(pick(True, "conservative_relevance_possible"))
    )


def memory_route(mode: Column, provider: Column, has_model: Column, reply_route: Column) -> Column:
    """(route, source) of the memory gate: configuration first, then the model's valid reply, else the current video."""
    pick = lambda route, source: F.struct(F.lit(route).alias("route"), F.lit(source).alias("source"))
    return (
        F.when((F.lower(provider) == "noop") | (mode == "off"), pick("current_video_only", "config")).when(mode == "always", pick("search_history", "config"))
        .when(~has_model, pick("current_video_only", "fallback")).when(reply_route == "search_history", pick("search_history", "llm"))
        .when(reply_route == "current_video_only", pick("current_video_only", "llm")).otherwise(pick("current_video_only", "fallback"))
    )


def trigger_reasons(unmet: Column, failed_facts: Column, n_evidence: Column, confidence: Column, insufficient: Column) -> Column:
    """Why an answer needs another look, distinct, in order."""
    own = F.filter(F.array(F.when(n_evidence == 0, "no_evidence"), F.when(confidence == "low", "low_confidence"), F.when(insufficient | (n_evidence == 0), "legacy_insufficient_answer")), lambda x: x.isNotNull())
    return F.array_distinct(F.concat(unmet, F.transform(failed_facts, lambda f: F.concat(F.lit("fact unsupported: "), f)), own))


def grounding(statuses: Column) -> Column:
    """sufficient, partial or insufficient by the statuses of some facts; not_applicable without any."""
    kinds = F.array_distinct(statuses)
    return F.when(F.size(kinds) == 0, "not_applicable").when((F.size(kinds) == 1) & F.array_contains(kinds, "supported"), "sufficient").when(F.array_contains(kinds, "supported"), "partial").otherwise("insufficient")


def followups(given: Column, question_class: Column, visual: Column, most: int = 5) -> Column:
    """Given follow-ups, the first non-blank ones; else suggestions by rule."""
    cleaned = F.filter(F.transform(F.coalesce(given, F.array().cast("array<string>")), lambda x: F.trim(x)), lambda x: x != "")
    rule = F.filter(F.array(F.lit("这个结论有哪些限制或反例？"), F.when(question_class != "evidence_check", "支持这个回答的关键证据在哪里？"), F.when(visual, "是否需要对相关时间段补充更多关键帧视觉描述？")), lambda x: x.isNotNull())
    return F.when(F.size(cleaned) > 0, F.slice(cleaned, 1, most)).otherwise(rule)


def intent_types(required: Column, optional: Column) -> Column:
    legal = F.filter(F.array_distinct(F.concat(required, optional)), lambda x: x.isin("speech", "frame_caption", "frame"))
    return F.when(F.size(legal) > 0, legal).otherwise(F.array(F.lit("speech"), F.lit("frame_caption")))


def frame_name_seconds(name: Column) -> Column:
    digits = F.regexp_replace(name, "[^0-9]", "")
    return F.when(digits == "", 0.0).otherwise(digits.try_cast("double"))


def auto_refine(question: Column, confidence: Column, agreement: Column) -> Column:
    """Refine frames for a question about pictures that words answer badly."""
    return ~((agreement >= 0.3) & (confidence != "low")) & R.needs_visual(question)


def guarded(top_k: Column, max_ranges: Column, padding: Column) -> Column:
    """A refinement call's arguments: counts of one at least, padding of none at least."""
    return F.struct(F.greatest(F.lit(1), top_k).alias("top_k"), F.greatest(F.lit(1), max_ranges).alias("max_ranges"), F.greatest(F.lit(0.0), padding).alias("padding"))
