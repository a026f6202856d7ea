"""Texts that are shown or sent: evidence, segments, errors, lists, prompts. All are JVM expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import format_timestamp


def _lines(*pairs: tuple[str, Column]) -> Column:
    return F.concat_ws("\n", *[F.concat(F.lit(f"{name}="), F.coalesce(value, F.lit(""))) for name, value in pairs])


def evidence_block(evidence_id: Column, segment_id: Column, kind: Column, start: Column, end: Column, text: Column, at: Column | None = None, frame: Column | None = None, most: int = 420) -> Column:
    """An evidence row as the model reads it."""
    at, frame = at if at is not None else F.lit(None).cast("double"), frame if frame is not None else F.lit(None).cast("string")
    return _lines(
        ("evidence_id", evidence_id), ("segment_id", segment_id), ("type", kind), ("time", format_timestamp(F.coalesce(at, start))), ("start", F.format_string("%.2f", start)),
        ("end", F.format_string("%.2f", end)), ("frame_id", frame), ("text", F.substring(text, 1, most)),
    )


def segment_block(segment_id: Column, start: Column, end: Column, text: Column, frames: Column, captions: Column, types: Column, chars: int = 500, caption_chars: int = 300) -> Column:
    """A segment as the model reads it; of its evidence types the three legal ones."""
    listed = lambda x: F.concat(F.lit("["), F.array_join(F.transform(x, lambda y: F.concat(F.lit("'"), y, F.lit("'"))), ", "), F.lit("]"))
    return _lines(
        ("segment_id", segment_id), ("start", F.format_string("%.2f", start)), ("end", F.format_string("%.2f", end)), ("transcript_text", F.substring(text, 1, chars)),
        ("representative_frame_ids", listed(frames)), ("visual_captions", F.substring(captions, 1, caption_chars)), ("evidence_types", listed(F.filter(types, lambda t: t.isin("speech", "frame", "frame_caption")))),
    )


def yaml_list(values: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(F.transform(values, lambda v: F.concat(F.lit('"'), v, F.lit('"'))), ", "), F.lit("]"))


def user_error(message: Column) -> Column:
    """What a user is told of a failure (the two messages are fixed values), else the first line of it."""
    first = F.substring(F.regexp_extract(message, r"^([^\r\n]*)", 1), 1, 1000)
    return (
        F.when(F.contains(message, F.lit("OPENAI_API_KEY")) | F.contains(message, F.lit("LLM config")), "LLM API key 未配置或不可用。")
        .when(F.contains(message, F.lit("embedding_unavailable")), "Embedding 不可用，请检查 EMBEDDING_MODEL / API 配置。").otherwise(first)
    )


def base_url(value: Column) -> Column:
    """A service's base address, however much of the full one was given."""
    plain = F.rtrim(F.trim(value), F.lit("/"))
    return F.rtrim(F.regexp_replace(F.regexp_replace(plain, "(?i)/chat/completions$", ""), "(?i)/embeddings$", ""), F.lit("/"))


def endpoint(base: Column, path: str) -> Column:
    """A service's address: the base without trailing slashes, and the path once."""
    plain = F.rtrim(base, F.lit("/"))
    return F.when(plain.endswith(path), plain).otherwise(F.concat(plain, F.lit("/" + path)))


def score_prompts(pairs: DataFrame, key: str, order: str, most: int = 900) -> DataFrame:
    """(key, n, prompt): frames and texts of a batch to score, numbered in order."""
    row = F.struct(F.col(order).alias("o"), "frame_id", "ts_s", F.substring("text", 1, most).alias("t"))
    rows = pairs.groupBy(key).agg(F.array_sort(F.collect_list(row)).alias("x"))
    said = F.transform("x", lambda x, i: F.concat(F.lit("【第"), (i + 1).cast("string"), F.lit("组】\nframe_id: "), x["frame_id"].cast("string"), F.lit("\ntimestamp: "), F.format_string("%.2f", x["ts_s"]), F.lit("s\n输入文本："), F.coalesce(x["t"], F.lit(""))))
    return rows.select(key, F.size("x").cast("long").alias("n"), F.array_join(said, "\n\n").alias("prompt"))


def checked_scores(scores: Column, n: Column) -> Column:
    """A reply's scores, one for each of n pairs; null if it gives fewer, since then none can be told apart."""
    return F.when((F.size(scores) > 0) & (F.size(scores) >= n), F.slice(scores, F.lit(1), n.cast("int")))
