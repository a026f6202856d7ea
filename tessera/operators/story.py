"""Storylines and summaries: node rules, runs and gaps, chunks, citations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import collapse, shorten


def fallback_storyline(segments: DataFrame, key: str = "video_id", order: str = "segment") -> DataFrame:
    """(key, node_id, time_start, time_end, claim, confidence, uncertainty, status): a node a segment."""
    at = F.row_number().over(Window.partitionBy(key).orderBy(order)) - 1
    plain = collapse(F.col("text"))
    has = plain != ""
    return segments.select(
        key, F.format_string("node_%04d", at).alias("node_id"), F.col("start_s").alias("time_start"), F.col("end_s").alias("time_end"), shorten(F.col("text"), 160).alias("claim"),
        F.when(has, 0.55).otherwise(0.2).alias("confidence"), F.when(has, 0.45).otherwise(0.8).alias("uncertainty"), F.when(has, "weakly_supported").otherwise("needs_review").alias("status"),
    )


def node_status(status: Column, n_refs: Column, has_caption: Column, visual_claim: Column, confidence: Column) -> Column:
    """A node without references is for review; one without captions that speaks of pictures, or is unsure, is weak."""
    first = F.when((n_refs == 0) & (status != "unsupported"), "needs_review").when((n_refs > 0) & ~has_caption & (visual_claim | (confidence < 0.75)), "weakly_supported").otherwise(status)
    return F.when((first == "supported") & (confidence < 0.75), "weakly_supported").otherwise(first)


def split_nodes(nodes: DataFrame, segments: DataFrame, key: str = "video_id") -> DataFrame:
    """(key, node_id, part, time_start, time_end, n): each segment goes to the first node that claims it; a node's runs of
    neighbouring segments become nodes of their own. nodes: (key, node_id, node_order, segment_id); segments: (key, segment_id, start_s, end_s)."""
    order = F.row_number().over(Window.partitionBy(key).orderBy("start_s", "segment_id"))
    placed = segments.withColumn("_at", order)
    claims = nodes.join(placed, [key, "segment_id"])
    first = F.row_number().over(Window.partitionBy(key, "segment_id").orderBy("node_order", "node_id"))
    own = claims.withColumn("_rn", first).where("_rn = 1")
    run = F.col("_at") - F.row_number().over(Window.partitionBy(key, "node_id").orderBy("_at"))
    parts = own.withColumn("_run", run).groupBy(key, "node_id", "_run").agg(F.min("start_s").alias("time_start"), F.max("end_s").alias("time_end"), F.count("*").alias("n"))
    return parts.withColumn("part", F.row_number().over(Window.partitionBy(key, "node_id").orderBy("time_start")).cast("long")).drop("_run")


def coverage_gaps(segments: DataFrame, covered: DataFrame, key: str = "video_id", least: float = 60.0) -> DataFrame:
    """(key, first_segment, n, start_s, end_s): runs of neighbouring segments that no node covers, of ``least`` seconds or more."""
    w = Window.partitionBy(key).orderBy("start_s", "segment_id")
    left = segments.withColumn("_at", F.row_number().over(w)).join(covered.select(key, "segment_id").distinct(), [key, "segment_id"], "left_anti")
    run = F.col("_at") - F.row_number().over(w)
    rows = left.withColumn("_run", run).groupBy(key, "_run").agg(F.min_by("segment_id", "_at").alias("first_segment"), F.count("*").alias("n"), F.min("start_s").alias("start_s"), F.max_by("end_s", "_at").alias("end_s"))
    return rows.where(F.col("end_s") - F.col("start_s") >= least).drop("_run")


def chunks(rows: DataFrame, key: str, order: str, size: int = 12) -> DataFrame:
    """Rows with the number of their chunk of ``size`` in a group's order."""
    return rows.withColumn("chunk", F.floor((F.row_number().over(Window.partitionBy(key).orderBy(order)) - 1) / size))


def citation_confidence(items: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """(key, item, n_valid, confidence): low without any cited id that exists, else high."""
    cited = items.select(key, "item", F.explode("cited").alias("segment_id")).join(known, [key, "segment_id"], "left_semi").groupBy(key, "item").agg(F.count("*").alias("n_valid"))
    rows = items.select(key, "item").join(cited, [key, "item"], "left").withColumn("n_valid", F.coalesce("n_valid", F.lit(0)))
    return rows.withColumn("confidence", F.when(F.col("n_valid") > 0, "high").otherwise("low"))


def outline_tail(outline: DataFrame, segments: DataFrame, key: str, share: float = 0.75, most: int = 3) -> DataFrame:
    """Segments past an outline that ends before ``share`` of its source: what to append, the first ones."""
    last = outline.groupBy(key).agg(F.max("end_s").alias("_last"))
    ends = segments.groupBy(key).agg(F.max("end_s").alias("_end"))
    late = ends.join(last, key, "left").where(F.coalesce("_last", F.lit(0.0)) < share * F.col("_end"))
    rest = segments.join(late, key).where(F.col("start_s") >= F.coalesce("_last", F.lit(0.0)))
    rank = F.row_number().over(Window.partitionBy(key).orderBy("start_s"))
    return rest.withColumn("_rn", rank).where(F.col("_rn") <= most).drop("_rn", "_last", "_end")


def evidence_extent(items: DataFrame, segments: DataFrame, key: str) -> DataFrame:
    """(key, item, start_s, end_s): the extent of the segments that an item cites."""
    cited = items.select(key, "item", F.explode("cited").alias("segment_id")).join(segments, [key, "segment_id"])
    return cited.groupBy(key, "item").agg(F.min("start_s").alias("start_s"), F.max("end_s").alias("end_s"))


def story_metadata(nodes: DataFrame, key: str = "video_id") -> DataFrame:
    """(key, n, covered_s, n_supported, statuses)."""
    return nodes.groupBy(key).agg(F.count("*").alias("n"), F.round(F.sum(F.col("time_end") - F.col("time_start")), 3).alias("covered_s"), F.count_if(F.col("status") == "supported").alias("n_supported"), F.array_join(F.array_sort(F.collect_set("status")), ",").alias("statuses"))


def planner_outline(rows: DataFrame, items: int = 12, questions: int = 8) -> DataFrame:
    """rows with the first entries of their outline and open questions, as many as a planner reads."""
    return rows.withColumn("outline", F.slice("outline", 1, items)).withColumn("questions", F.slice("questions", 1, questions))
