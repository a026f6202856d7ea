"""End-to-end jobs over many sources and questions at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import planning, routing, timeparse
from tessera.operators import contract, intervals, narrate, retrieve, segment, story
from tessera.operators import frames as selection
from tessera.sources.providers import Providers, captions
from tessera.storage import materialise


class Engine:
    """Build segments, an index, storylines and answers as DataFrames; nothing runs until a result is read."""

    def __init__(self, spark: SparkSession, providers: Providers | None = None):
        self.spark, self.providers = spark, providers or Providers()

    def segments(self, items: DataFrame) -> DataFrame:
        """items: (video_id, item_ord, start_s, end_s, text) -> merged segments."""
        return segment.merge_segments(items.where("trim(text) <> ''"))

    def evidence(self, segments: DataFrame, shown: DataFrame | None = None) -> DataFrame:
        """(video_id, doc_id, evidence_type, text, start_s, end_s): speech of segments, and captions of frames if given."""
        speech = segments.select("video_id", F.concat_ws(":", "video_id", "segment_id", F.lit("speech")).alias("doc_id"), F.lit("speech").alias("evidence_type"), "text", "start_s", "end_s")
        if shown is None:
            return speech
        seen = shown.where("trim(caption) <> ''").select("video_id", F.concat_ws(":", "video_id", F.lit("frame_caption"), F.col("frame_id").cast("string")).alias("doc_id"), F.lit("frame_caption").alias("evidence_type"), F.col("caption").alias("text"), F.col("ts_s").alias("start_s"), F.col("ts_s").alias("end_s"))
        return speech.unionByName(seen)

    def storyline(self, segments: DataFrame) -> DataFrame:
        """Nodes by the chat provider, checked against the segments, with rules where it fails; without one by rule alone."""
        if self.providers.chat is None:
            return story.fallback_storyline(segments)
        return narrate.story_nodes(segments, self.providers.chat)

    def summary(self, segments: DataFrame, size: int = 12) -> DataFrame:
        """(video_id, n_chunks, summary, ...): by the chat provider, with its claims; without one the first words of each chunk of segments, in order."""
        if self.providers.chat is not None:
            return narrate.summaries(segments, self.providers.chat, size=size)
        parts = story.chunks(segments, "video_id", "segment", size).groupBy("video_id", "chunk").agg(F.min_by("text", "segment").alias("t"))
        rows = parts.groupBy("video_id").agg(F.count("*").alias("n_chunks"), F.array_sort(F.collect_list(F.struct("chunk", F.substring("t", 1, 160).alias("t")))).alias("x"))
        return rows.select("video_id", "n_chunks", F.array_join(F.transform("x", lambda x: x["t"]), "\n").alias("summary"))

    def route(self, questions: DataFrame) -> DataFrame:
        """Questions with their route, class, analysis and plan."""
        q = F.col("question")
        rows = questions.withColumn("route", routing.route_question(q)).withColumn("class", planning.classify_question(q)).withColumn("analysis", planning.analysis(q, F.lit(True)))
        return rows.withColumn("plan", planning.evidence_plan(q, F.col("analysis")))

    def retrieve(self, evidence: DataFrame, questions: DataFrame, mode: str = "hybrid", top_k: int = 8) -> DataFrame:
        return retrieve.hybrid(evidence, questions.select(F.col("question_id").alias("query_id"), F.col("question").alias("text")), mode, top_k)

    def answer(self, evidence: DataFrame, questions: DataFrame, mode: str = "hybrid", top_k: int = 4) -> DataFrame:
        """(query_id, video_id, answer, cited, confidence): grounded answers; a question without evidence in any source abstains."""
        found = self.retrieve(evidence, questions, mode, top_k).join(evidence.select("video_id", "doc_id", "text"), ["video_id", "doc_id"])
        rows = found.withColumn("key", F.struct("query_id", "video_id")).select("key", "rank", F.col("doc_id").alias("evidence_id"), "text")
        said = contract.compose_answer(rows, "key")
        best = found.groupBy("query_id", "video_id").agg(F.avg("score").alias("s"))
        answers = said.select("key.query_id", "key.video_id", "answer", "cited").join(best, ["query_id", "video_id"]).withColumn("confidence", contract.confidence(F.col("s"))).drop("s")
        silent = questions.select(F.col("question_id").alias("query_id")).join(answers.select("query_id").distinct(), "query_id", "left_anti")
        return answers.unionByName(silent.select("query_id", F.lit("insufficient evidence").alias("answer"), F.lit("low").alias("confidence")), allowMissingColumns=True)

    def refine(self, asked: DataFrame, evidence: DataFrame, found: DataFrame, frames: DataFrame) -> DataFrame:
        """New caption evidence for (query_id, video_id, question) rows: captions of frames near what the question points at.

        Ranges lie around its time anchors, else around its best evidence, else at the first segment; of each a few evenly
        spaced moments are taken, and of each moment the nearest frame. frames: (video_id, frame_id, ts_s, path).
        """
        key = F.concat_ws("|", F.col("query_id").cast("string"), F.col("video_id").cast("string")).alias("k")
        rows = asked.select(key, "video_id", "question")
        anchors = rows.select("k", F.explode(timeparse.time_anchors(F.col("question"))).alias("at_s"))
        near = found.select(key, "rank", "doc_id", "video_id").join(evidence.select("video_id", "doc_id", "start_s", "end_s"), ["video_id", "doc_id"]).select("k", "rank", "start_s", "end_s").join(rows.select("k"), "k", "left_semi")
        first = rows.join(evidence.groupBy("video_id").agg(F.min(F.struct("start_s", "end_s")).alias("f")), "video_id").select("k", "f.start_s", "f.end_s")
        ranges = contract.target_ranges(anchors, near, first, "k").join(rows.select("k", "video_id"), "k")
        moments = selection.refined_timestamps(ranges, ["k", "video_id", "start_s", "end_s"], "start_s", "end_s").select("video_id", "ts_s").distinct()
        points = frames.select("video_id", "frame_id", F.col("ts_s").alias("f0"), F.col("ts_s").alias("f1"))
        chosen = intervals.nearest_interval(moments, points, "ts_s", ("f0", "f1"), ["video_id"], "frame_id").select("video_id", "frame_id").distinct()
        shown = frames.join(chosen, ["video_id", "frame_id"])
        said = captions(shown.select(F.concat_ws(":", F.col("video_id").cast("string"), F.col("frame_id").cast("string")).alias("name"), "path"), self.providers.caption, "name").where("status = 'success' AND trim(caption) <> ''")
        named = shown.withColumn("name", F.concat_ws(":", F.col("video_id").cast("string"), F.col("frame_id").cast("string"))).join(said, "name")
        return named.select("video_id", F.concat_ws(":", F.col("video_id").cast("string"), F.lit("frame_caption"), F.col("frame_id").cast("string")).alias("doc_id"), F.lit("frame_caption").alias("evidence_type"), F.col("caption").alias("text"), F.col("ts_s").alias("start_s"), F.col("ts_s").alias("end_s"))

    def ask(self, evidence: DataFrame, questions: DataFrame, frames: DataFrame | None = None, mode: str = "hybrid", top_k: int = 4) -> DataFrame:
        """(query_id, video_id, answer, cited, confidence, reasons, refined): answers, looked at again once where they fall short.

        A question that its evidence answers badly, or that asks for pictures without any among it, gets captions of frames
        where it points and is answered anew on all evidence; the others keep their first answer.
        """
        first = materialise(self.answer(evidence, questions, mode, top_k))
        asked = questions.select(F.col("question_id").alias("query_id"), "question")
        looks = routing.needs_visual(F.col("question")) & ~F.coalesce(F.contains("cited", F.lit(":frame_caption")), F.lit(False))
        unmet = F.when(looks, F.array(F.lit("missing_visual_evidence"))).otherwise(F.array().cast("array<string>"))
        n = F.when(F.col("video_id").isNull(), 0).otherwise(1)
        why = planning.trigger_reasons(unmet, F.array().cast("array<string>"), n, F.col("confidence"), F.col("answer") == "insufficient evidence")
        judged = first.join(asked, "query_id").withColumn("reasons", why)
        if frames is None:
            return judged.drop("question").withColumn("refined", F.lit(False))
        again = judged.where((F.size("reasons") > 0) & F.col("video_id").isNotNull())
        wanted = again.select("query_id", "video_id", "question")
        found = self.retrieve(evidence, questions, mode, top_k)
        more = materialise(self.refine(wanted, evidence, found, frames))
        second = self.answer(evidence.unionByName(more), questions.join(wanted.select(F.col("query_id").alias("question_id")).distinct(), "question_id", "left_semi"), mode, top_k)
        new = second.join(wanted, ["query_id", "video_id"]).join(again.select("query_id", "video_id", "reasons"), ["query_id", "video_id"]).withColumn("refined", F.lit(True))
        keep = judged.join(new.select("query_id", "video_id"), ["query_id", "video_id"], "left_anti").withColumn("refined", F.lit(False))
        return keep.drop("question").unionByName(new.drop("question"))
