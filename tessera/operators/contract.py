"""Evidence agreement, the evidence contract, gates and audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.routing import SILENT
from tessera.operators.intervals import interval_join


def overlap_coefficient(a: Column, b: Column) -> Column:
    """Common distinct items over the smaller set; 0 if either is empty."""
    least = F.least(F.size(F.array_distinct(a)), F.size(F.array_distinct(b)))
    return F.when(least > 0, F.size(F.array_intersect(a, b)) / least).otherwise(0.0)


def time_overlap(left: DataFrame, right: DataFrame, key: str, width: float = 60.0) -> DataFrame:
    """(key, score): left ranges that meet any right one, over the smaller number of ranges; may pass 1."""
    l = left.select(key, F.col("start_s").alias("l0"), F.col("end_s").alias("l1"), F.col("id").alias("lid"))
    met = interval_join(l, right.select(key, "start_s", "end_s"), ("l0", "l1"), ("start_s", "end_s"), [key], width).select(key, "lid").distinct().groupBy(key).agg(F.count("*").alias("hit"))
    n = left.groupBy(key).agg(F.count("*").alias("nl")).join(right.groupBy(key).agg(F.count("*").alias("nr")), key)
    return n.join(met, key, "left").select(key, (F.coalesce("hit", F.lit(0)) / F.least("nl", "nr")).alias("score"))


def agreement(segments: Column, times: Column, semantic: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.5 * segments + 0.3 * times + 0.2 * semantic))


def confidence(score: Column) -> Column:
    return F.when(score >= 0.6, "high").when(score >= 0.3, "medium").otherwise("low")


def weaker(a: Column, b: Column) -> Column:
    """The lower of two confidences; an unknown word counts as low."""
    level = F.create_map(*[F.lit(x) for x in ("low", 0, "medium", 1, "high", 2)])
    return F.element_at(F.array(F.lit("low"), F.lit("medium"), F.lit("high")), F.least(F.coalesce(level[a], F.lit(0)), F.coalesce(level[b], F.lit(0))) + 1)


def modality_contract(questions: DataFrame, evidence: DataFrame, key: str = "question_id") -> DataFrame:
    """(key, modality, available): each required modality of a question, and whether its evidence has it."""
    need = questions.select(key, F.explode("required").alias("modality"))
    said = F.count_if((F.col("evidence_type") == "speech") & (F.trim("text") != "") & ~F.contains(F.lower("text"), F.lit(SILENT)))
    seen = F.count_if(F.col("evidence_type").isin("frame", "frame_caption") & (F.trim("text") != ""))
    have = evidence.groupBy(key).agg(said.alias("speech"), seen.alias("visual"))
    n = F.when(F.col("modality") == "speech", F.col("speech")).otherwise(F.col("visual"))
    return need.join(have, key, "left").select(key, "modality", (F.coalesce(n, F.lit(0)) > 0).alias("available"))


def scope_status(required: Column, covered: Column, n_evidence: Column) -> Column:
    return F.when(~required, "not_applicable").when(n_evidence == 0, "unknown").when(covered >= 3, "complete").otherwise("incomplete")


def fact_support(expected: DataFrame, reported: DataFrame, evidence: DataFrame, key: str = "question_id") -> DataFrame:
    """(key, fact, status, n_valid): reported support of expected facts, by case-folded match; cited ids must exist.

    Support without any valid id is no support; facts nobody reported are unsupported.
    """
    rows = expected.select(key, "fact", F.lower(F.trim("fact")).alias("_f")).join(reported.select(key, F.lower(F.trim("fact")).alias("_f"), "status", "evidence_ids"), [key, "_f"], "left")
    cited = rows.select(key, "_f", F.explode("evidence_ids").alias("evidence_id")).distinct().join(evidence.select(key, "evidence_id").distinct(), [key, "evidence_id"], "left_semi")
    valid = cited.groupBy(key, "_f").agg(F.count("*").alias("n_valid"))
    rows = rows.join(valid, [key, "_f"], "left").withColumn("n_valid", F.coalesce("n_valid", F.lit(0)))
    status = F.when(F.col("status").isNull(), "unsupported").when(F.col("status").isin("supported", "partial") & (F.col("n_valid") == 0), "unsupported").otherwise(F.col("status"))
    return rows.select(key, "fact", status.alias("status"), "n_valid")


def gate(facts: DataFrame, scopes: DataFrame, relations: DataFrame, key: str = "question_id") -> DataFrame:
    """(key, status): unsupported facts, then unproven relations, then strict scope send a question to refinement."""
    f = facts.groupBy(key).agg(F.count_if(F.col("status").isin("unsupported", "contradicted")).alias("failed"))
    r = relations.groupBy(key).agg(F.count_if(F.col("n_times") < 2).alias("open"))
    rows = scopes.join(f, key, "left").join(r, key, "left").na.fill(0, ["failed", "open"])
    again = F.when(F.col("n_evidence") > 0, "needs_refinement").otherwise("insufficient")
    status = F.when((F.col("failed") > 0) | (F.col("open") > 0), again).when((F.col("completeness") == "strict") & (F.col("scope") != "complete"), "needs_refinement")
    return rows.select(key, status.when((F.col("scope") == "incomplete") & F.col("partial_ok"), "supported_with_scope_limit").otherwise("fully_supported").alias("status"))


def bundle(evidence: DataFrame, segments: DataFrame, key: list[str]) -> DataFrame:
    """Evidence whose segment exists, one row for each segment, type and frame, ordered by start, time and type."""
    rows = evidence.join(segments.select("video_id", "segment_id").distinct(), ["video_id", "segment_id"], "left_semi")
    first = F.row_number().over(Window.partitionBy(*key, "segment_id", "evidence_type", "frame_id").orderBy("start_s", "ts_s", "evidence_id"))
    rows = rows.withColumn("_rn", first).where("_rn = 1").drop("_rn")
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(*key).orderBy("start_s", F.coalesce("ts_s", "start_s"), "evidence_type", "evidence_id")).cast("long"))


def dangling(references: DataFrame, known: DataFrame, on: list[str]) -> DataFrame:
    """References to what does not exist."""
    return references.join(known, on, "left_anti")


def valid_ids(cited: DataFrame, known: DataFrame, on: list[str]) -> DataFrame:
    return cited.join(known, on, "left_semi")


def audit(nodes: DataFrame, segments: DataFrame) -> DataFrame:
    """(video_id, issue, subject): dangling segment references, unknown evidence types, evidence without text."""
    refs = nodes.select("video_id", F.explode("segment_ids").alias("segment_id"))
    a = dangling(refs, segments, ["video_id", "segment_id"]).select("video_id", F.lit("dangling_segment").alias("issue"), F.col("segment_id").cast("string").alias("subject"))
    b = segments.where(~F.col("evidence_type").isin("speech", "frame", "frame_caption")).select("video_id", F.lit("illegal_type"), F.col("segment_id").cast("string"))
    c = segments.where("trim(coalesce(text, '')) = ''").select("video_id", F.lit("empty_text"), F.col("segment_id").cast("string"))
    return a.union(b).union(c)


def missing_anchors(anchors: DataFrame, evidence: DataFrame, key: list[str], slack: float = 5.0) -> DataFrame:
    """Anchors that no evidence comes within ``slack`` seconds of: a binned range anti join."""
    from tessera.operators.intervals import point_join

    near = point_join(anchors, evidence.select(*key, "start_s", "end_s"), "at_s", ("start_s", "end_s"), key, 60.0, slack)
    return anchors.join(near.select(*key, "at_s").distinct(), [*key, "at_s"], "left_anti")


def target_ranges(anchors: DataFrame, evidence: DataFrame, first_segments: DataFrame, key: str, window: float = 60.0) -> DataFrame:
    """(key, start_s, end_s, n, priority): around anchors, else around the two best pieces of evidence, else the first segment; merged, three at most."""
    from tessera.operators.intervals import merge_ranges

    a = anchors.select(key, F.greatest(F.lit(0.0), F.col("at_s") - window).alias("start_s"), (F.col("at_s") + window).alias("end_s"), F.lit(1).alias("priority"))
    b = evidence.where("rank <= 2").select(key, F.greatest(F.lit(0.0), F.col("start_s") - 15).alias("start_s"), (F.col("end_s") + 15).alias("end_s"), F.lit(2).alias("priority")).join(a.select(key).distinct(), key, "left_anti")
    some = a.select(key).union(b.select(key)).distinct()
    c = first_segments.select(key, "start_s", "end_s", F.lit(3).alias("priority")).join(some, key, "left_anti")
    merged = merge_ranges(a.unionByName(b).unionByName(c), key, "start_s", "end_s", 2, priority="priority")
    rank = F.row_number().over(Window.partitionBy(key).orderBy("start_s", "end_s"))
    return merged.withColumn("_rn", rank).where("_rn <= 3").drop("_rn")


def compose_answer(evidence: DataFrame, key: str, snippets: int = 3, citations: int = 4) -> DataFrame:
    """(key, answer, cited): the first snippets of an answer's evidence, and the ids it cites."""
    rows = evidence.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("rank", "evidence_id", "text"))).alias("x"))
    return rows.select(key, F.array_join(F.transform(F.slice("x", 1, snippets), lambda e: F.substring(e["text"], 1, 120)), "\n").alias("answer"), F.array_join(F.transform(F.slice("x", 1, citations), lambda e: e["evidence_id"].cast("string")), ",").alias("cited"))
