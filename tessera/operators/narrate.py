"""Storylines and summaries by a model: segments in chunks, a call each, replies checked against the chunk, rules where a call fails."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import collapse, salvage_json, shorten
from tessera.operators.story import chunks, fallback_storyline
from tessera.sources.providers import called
from tessera.storage import materialise

#: Segments of a chunk, characters of each that a model reads, and of a claim that are kept.
CHUNK, SEGMENT_CHARS, CLAIM_CHARS = 12, 500, 220
#: Confidence below which a node is weakly supported, and that of a node that states none, with and without evidence (fixed values).
SURE, STATED, UNSTATED = 0.75, 0.8, 0.3
STATUSES = ("supported", "weakly_supported", "needs_review")
_NODES = "nodes array<struct<title:string,topic:string,summary:string,claim:string,time_start:double,time_end:double,confidence:double,status:string,evidence_segment_ids:array<string>,evidence_refs:array<struct<segment_id:string>>>>"
_SUMMARY = "chunk_overview string, cited_segment_ids array<string>, local_claims array<struct<claim:string,segment_ids:array<string>>>"

ASK_NODES = 'Tell the story of these segments. Use nothing else. Reply with JSON only: {"nodes": [{"title": "", "claim": "", "time_start": 0, "time_end": 0, "confidence": 0, "status": "supported", "evidence_segment_ids": []}]}'
ASK_SUMMARY = 'Summarise these segments. Use nothing else. Reply with JSON only: {"chunk_overview": "", "local_claims": [{"claim": "", "segment_ids": []}], "cited_segment_ids": []}'
ASK_WHOLE = 'Join these summaries of the parts of one source. Use nothing else. Reply with JSON only: {"quick_overview": ""}'


def _asked(segments: DataFrame, chat: Callable, ask: str, key: str, size: int, options: dict) -> DataFrame:
    """(key, chunk, parts, found, status): a row a chunk with its (segment_id, start_s, end_s, text) in order and the JSON object of the model's reply, null if there is none."""
    part = F.struct("segment", "segment_id", "start_s", "end_s", "text")
    rows = chunks(segments.select(key, "segment", "segment_id", "start_s", "end_s", "text"), key, "segment", size)
    rows = rows.groupBy(key, "chunk").agg(F.array_sort(F.collect_list(part)).alias("parts"))
    line = lambda p: F.concat(F.lit("["), p["segment_id"], F.lit(" "), F.format_string("%.0f-%.0f", p["start_s"], p["end_s"]), F.lit("] "), F.substring(F.coalesce(p["text"], F.lit("")), 1, SEGMENT_CHARS))
    rows = materialise(rows.withColumn("call", F.to_json(F.struct(key, "chunk"))).withColumn("prompt", F.concat(F.lit(ask + "\n\n"), F.array_join(F.transform("parts", line), "\n"))))
    replies = materialise(called(rows, "call", "prompt", chat, **options))
    return rows.join(replies, "call").select(key, "chunk", "parts", F.when(F.col("status") == "succeeded", salvage_json(F.col("reply"))).alias("found"), "status")


def _cited(ids, parts):
    """Distinct ids that name a segment of the chunk, in their order."""
    return F.filter(F.array_distinct(F.coalesce(ids, F.array().cast("array<string>"))), lambda i: F.array_contains(F.transform(parts, lambda p: p["segment_id"]), i))


def story_nodes(segments: DataFrame, chat: Callable, key: str = "video_id", size: int = CHUNK, **options) -> DataFrame:
    """(key, node_id, time_start, time_end, topic, claim, segment_ids, confidence, uncertainty, status) of every source.

    A node's evidence are the segments of its chunk that it names; its times are what it says, else theirs; without evidence it is
    unsupported, and weakly supported where it is not sure. A chunk whose call fails, or whose reply has no nodes, gets a node a segment by rule.
    segments: (key, segment, segment_id, start_s, end_s, text). Nodes are numbered in the order of chunks and replies.
    """
    asked = materialise(_asked(segments, chat, ASK_NODES, key, size, options).withColumn("nodes", F.from_json("found", _NODES)["nodes"]))
    n = asked.where(F.size("nodes") > 0).select(key, "chunk", "parts", F.posexplode("nodes").alias("pos", "n"))
    refs = _cited(F.transform("n.evidence_refs", lambda r: r["segment_id"]), F.col("parts"))
    n = n.withColumn("segment_ids", F.when(F.size(refs) > 0, refs).otherwise(_cited(F.col("n.evidence_segment_ids"), F.col("parts"))))
    own = F.filter("parts", lambda p: F.array_contains(F.col("segment_ids"), p["segment_id"]))
    has = F.size("segment_ids") > 0
    sure = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("n.confidence", F.when(has, STATED).otherwise(UNSTATED))))
    status = F.when(F.col("n.status").isin(*STATUSES), F.col("n.status")).otherwise("needs_review")
    claim = F.coalesce(F.nullif(F.trim(F.coalesce("n.summary", "n.claim")), F.lit("")), F.lit("not enough evidence; to be reviewed"))
    said = n.select(
        key, "chunk", "pos", F.coalesce("n.time_start", F.array_min(F.transform(own, lambda p: p["start_s"])), F.lit(0.0)).alias("time_start"),
        F.coalesce("n.time_end", F.array_max(F.transform(own, lambda p: p["end_s"])), F.lit(0.0)).alias("time_end"), F.coalesce("n.title", "n.topic").alias("topic"),
        F.substring(claim, 1, CLAIM_CHARS).alias("claim"), "segment_ids", sure.alias("confidence"),
        F.when(~has, "unsupported").when(sure < SURE, "weakly_supported").otherwise(status).alias("status"),
    )
    rest = asked.where("nodes IS NULL OR size(nodes) = 0").select(key, "chunk", F.inline("parts"))
    ruled = fallback_storyline(rest, key).join(rest.select(key, "chunk", "segment", "segment_id", F.format_string("node_%04d", F.row_number().over(Window.partitionBy(key).orderBy("segment")) - 1).alias("node_id")), [key, "node_id"])
    ruled = ruled.select(key, "chunk", F.col("segment").cast("int").alias("pos"), "time_start", "time_end", F.lit(None).cast("string").alias("topic"), "claim", F.array("segment_id").alias("segment_ids"), "confidence", "status")
    number = F.row_number().over(Window.partitionBy(key).orderBy("chunk", "pos")) - 1
    rows = said.unionByName(ruled).withColumn("node_id", F.format_string("node_%04d", number)).withColumn("uncertainty", F.round(1 - F.col("confidence"), 3))
    return rows.select(key, "node_id", "time_start", "time_end", "topic", "claim", "segment_ids", "confidence", "uncertainty", "status")


def summaries(segments: DataFrame, chat: Callable, key: str = "video_id", size: int = CHUNK, **options) -> DataFrame:
    """(key, n_chunks, n_by_rule, summary, claims array<(claim, segment_ids, confidence)>) of every source.

    Each chunk is summarised by a call, and the chunks' overviews by one more for a source that has several; a chunk whose call fails gives its first words, a
    source whose last call fails its overviews line by line. A claim that names no segment of its chunk has low confidence, others high.
    """
    asked = _asked(segments, chat, ASK_SUMMARY, key, size, options).withColumn("s", F.from_json("found", _SUMMARY))
    overview = F.nullif(F.trim("s.chunk_overview"), F.lit(""))
    first = shorten(collapse(F.array_join(F.transform("parts", lambda p: F.coalesce(p["text"], F.lit(""))), " ")), 160)
    claims = F.transform(F.filter(F.coalesce("s.local_claims", F.from_json(F.lit("[]"), "array<struct<claim:string,segment_ids:array<string>>>")), lambda c: F.trim(F.coalesce(c["claim"], F.lit(""))) != ""), lambda c: F.struct(c["claim"].alias("claim"), _cited(c["segment_ids"], F.col("parts")).alias("segment_ids")))
    claims = F.transform(claims, lambda c: F.struct(c["claim"].alias("claim"), c["segment_ids"].alias("segment_ids"), F.when(F.size(c["segment_ids"]) > 0, "high").otherwise("low").alias("confidence")))
    mapped = materialise(asked.select(key, "chunk", overview.isNull().alias("ruled"), F.coalesce(overview, first).alias("overview"), claims.alias("claims")))
    rows = mapped.groupBy(key).agg(F.count("*").alias("n_chunks"), F.count_if("ruled").alias("n_by_rule"), F.array_sort(F.collect_list(F.struct("chunk", "overview", "claims"))).alias("x"))
    rows = materialise(rows.select(key, "n_chunks", "n_by_rule", F.array_join(F.transform("x", lambda x: x["overview"]), "\n").alias("joined"), F.flatten(F.transform("x", lambda x: x["claims"])).alias("claims")))
    several = rows.where("n_chunks > 1").withColumn("prompt", F.concat(F.lit(ASK_WHOLE + "\n\n"), F.col("joined")))
    whole = called(several, key, "prompt", chat, **options).where("status = 'succeeded'").select(F.col(key).alias("_k"), F.nullif(F.trim(F.from_json(salvage_json(F.col("reply")), "quick_overview string")["quick_overview"]), F.lit("")).alias("_whole"))
    both = rows.join(whole, rows[key] == F.col("_k"), "left")
    return both.select(key, "n_chunks", "n_by_rule", F.coalesce("_whole", "joined").alias("summary"), "claims")
