"""Rules that route questions and sources: modality, question class, task, evidence plan."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import contains_any, has_cjk

#: Word lists of the rules (fixed values).
VISUAL_HINTS = ["教程", "演示", "代码", "ppt", "白板", "图表", "操作", "实验", "安装", "配置", "demo", "slide"]
QUESTION_VISUAL_HINTS = ["画面", "图中", "表格", "界面", "按钮", "代码", "公式", "演示", "操作界面", "点击", "视频里这一步", "截图", "ppt", "白板"]
ACTION_ADVICE = ["操作建议", "操作上的建议", "实操建议", "行动建议", "风控建议", "交易建议", "建议"]
ADVICE_VISUALS = ["画面", "图中", "界面", "按钮", "点击", "演示", "视频里这一步", "操作界面"]
#: Patterns of the fast/full router (fixed values).
CROSS_VIDEO = "(?i)上一个视频|之前那个视频|其他视频|跨视频|刚才另一个|以前问过|相比.*视频|another video|previous video"
COMPLEX = "(?i)为什么|为何|怎么理解|原因|先.+再|先后|顺序|阶段|整个视频|全片|全程|总结|概括|核心|比较|对比|区别|前后|流程|过程|why|before|after|sequence|stage|whole video|compare"
UI_DETAIL = "(?i)按钮|界面|点击|屏幕|画面|图中|截图|代码|公式|on[- ]screen|button|click"
ENTITY_FACT = "(?i)什么软件|哪个软件|什么工具|哪个工具|什么模型|哪个模型|什么库|哪个库|什么产品|哪个产品|什么版本|哪个版本|使用了什么|用了什么|提到了什么"
#: Patterns of the question context (fixed values).
WHOLE_VIDEO = r"(?i)整个视频|整段视频|全片|全程|贯穿视频|\b(?:entire|whole)\s+(?:video|clip)\b|\bthroughout\s+the\s+(?:video|clip)\b|\boverall\s+process\s+(?:shown\s+)?in\s+the\s+video\b"
EXPLICIT_VISUAL = r"(?i)画面里|画面中|图中|屏幕上|截图|按钮|界面上|视频里这一步|\b(?:on[- ]screen|in the (?:image|frame)|visually shown)\b"
EXPLICIT_SPEECH = r"(?i)说了什么|讲了什么|提到什么|原话|语音|台词|转录|\b(?:say|said|mention|speech|spoken|transcript|quote)\b"
RELATIONS = [
    ("before_after", r"(?i)之前|之后|以前|以后|\b(?:before|after)\b"), ("sequence", r"(?is)先.+(?:再|然后|还是)|先后|顺序|\b(?:first|then|in what order)\b"),
    ("stage", r"(?i)阶段|分为.+步|\b(?:phase|stage)s?\b"), ("transition", r"(?i)转变|转折|过渡|\b(?:transition|turning point)s?\b"),
]
SILENT = "silent video. no spoken transcript is available"


def _as_stated(pattern: str) -> str:
    """A pattern as the JVM must be told it: ASCII word ends and white space, a dot that stops at line feeds only, and s and k in all their cases."""
    told = {r"\b": r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))", r"\s": r"[\t\n\f\r ]", "s": "[s\u017f]", "k": "[k\u212a]"}
    return "(?d)" + re.sub(r"\\.|\(\?[a-z]+\)|[sk]", lambda m: told.get(m.group(), m.group()), pattern)


def matches(text: Column, pattern: str) -> Column:
    """Whether a case-insensitive pattern of this module is met, whatever characters stand around it."""
    return text.rlike(_as_stated(pattern))


def route_modality(videos: DataFrame, segments: DataFrame) -> DataFrame:
    """(video_id, mode, speech_density, visual_score): by the length and density of speech and by visual hints."""
    spoken = segments.groupBy("video_id").agg(F.sum(F.greatest(F.lit(0.0), F.col("end_s") - F.col("start_s"))).alias("spoken"), F.bool_or(contains_any(F.col("text"), VISUAL_HINTS)).alias("hinted"))
    rows = videos.join(spoken, "video_id", "left").select("video_id", "title", "duration", F.coalesce("spoken", F.lit(0.0)).alias("spoken"), F.coalesce("hinted", F.lit(False)).alias("hinted"))
    length = F.coalesce(F.nullif(F.col("duration"), F.lit(0.0)), F.nullif(F.col("spoken"), F.lit(0.0)), F.lit(1.0))
    hinted = F.col("hinted") | F.coalesce(contains_any(F.col("title"), VISUAL_HINTS), F.lit(False))
    rows = rows.withColumn("density", F.col("spoken") / length).withColumn("score", F.when(hinted, 0.65).otherwise(0.15))
    mode = F.when(F.col("score") >= 0.5, "vision_supportive").otherwise("text_dominant")
    return rows.select("video_id", mode.alias("mode"), F.round("density", 3).alias("speech_density"), F.col("score").alias("visual_score"))


def needs_visual(question: Column) -> Column:
    advice = reduce(lambda a, b: a | b, [F.contains(question, F.lit(w)) for w in ACTION_ADVICE])
    visual = reduce(lambda a, b: a | b, [F.contains(question, F.lit(w)) for w in ADVICE_VISUALS])
    return F.when(advice & ~visual, False).otherwise(contains_any(question, QUESTION_VISUAL_HINTS))


def route_question(question: Column) -> Column:
    """(mode, reason) of a question: fast only for a plain fact about the current video."""
    q = F.trim(question)
    pick = lambda mode, why: F.struct(F.lit(mode).alias("mode"), F.lit(why).alias("reason"))
    return (
        F.when((q == "") | q.rlike(CROSS_VIDEO), pick("full", "empty_or_cross_video_scope"))
        .when(q.rlike(COMPLEX) | q.rlike(UI_DETAIL), pick("full", "temporal_explanation_comparison_or_explicit_visual_detail"))
        .when(q.rlike(ENTITY_FACT), pick("fast", "simple_current_video_entity_fact"))
        .otherwise(pick("full", "not_high_confidence_simple_fact"))
    )


def temporal_relation(question: Column) -> Column:
    out = F.lit("none")
    for name, pattern in reversed(RELATIONS):
        out = F.when(matches(question, pattern), name).otherwise(out)
    return out


def modality_weight(text: Column, caption: Column, has_frames: Column, question: Column | None = None) -> Column:
    """(text, vision) shares, 3 places: speech length over 220 against caption length over 180, at most .8.

    Frames alone give vision .15, a visual hint in speech or caption .35, a question that needs to look .45, at least.
    """
    text, caption = F.trim(F.coalesce(text, F.lit(""))), F.trim(F.coalesce(caption, F.lit("")))
    t = F.least(F.lit(1.0), F.length(text) / 220)
    v = F.greatest(F.when(has_frames, 0.15).otherwise(0.0), F.least(F.lit(0.8), F.length(caption) / 180))
    v = F.when(contains_any(F.concat_ws(" ", text, caption), VISUAL_HINTS), F.greatest(v, F.lit(0.35))).otherwise(v)
    if question is not None:
        v = F.when(needs_visual(F.coalesce(question, F.lit(""))), F.greatest(v, F.lit(0.45))).otherwise(v)
    total = t + v
    share = lambda x: F.when(total > 0, F.round(x / total, 3)).otherwise(0.0)
    return F.struct(share(t).alias("text"), share(v).alias("vision"))


def keeps_language(query: Column, question: Column) -> Column:
    """A planned query in a script that the question does not use is left out."""
    return ~has_cjk(query) | has_cjk(question)
