"""Subtitle files: JSON3, WebVTT and SRT to transcript items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import clean_markup, collapse
from tessera.functions.timeparse import subtitle_seconds

JSON3 = "events array<struct<tStartMs:double,dDurationMs:double,segs:array<struct<utf8:string>>>>"


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, kind, content): whole files by suffix; others are left out."""
    rows = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))
    return rows.withColumn("kind", subtitle_kind(F.col("path"))).where("kind IS NOT NULL")


def subtitle_kind(path: Column) -> Column:
    suffix = F.lower(F.regexp_extract(path, r"(\.[A-Za-z0-9]+)$", 1))
    return F.when(suffix == ".json3", "json3").when(suffix == ".vtt", "vtt").when(suffix == ".srt", "srt")


def parse_json3(rows: DataFrame, content: str = "content") -> DataFrame:
    """Rows with start, end and text of each JSON3 event that says something."""
    events = rows.withColumn("event", F.explode(F.from_json(F.col(content), f"struct<{JSON3.replace(' array', ':array', 1)}>")["events"])).where("event.segs IS NOT NULL")
    text = collapse(F.array_join(F.transform(F.col("event.segs"), lambda s: F.coalesce(s["utf8"], F.lit(""))), ""))
    start = F.coalesce("event.tStartMs", F.lit(0.0)) / 1000
    out = events.withColumn("text", text).withColumn("start", start).withColumn("end", start + F.coalesce("event.dDurationMs", F.lit(0.0)) / 1000)
    return out.where("text <> ''").drop("event", content)


def parse_blocks(rows: DataFrame, content: str = "content") -> DataFrame:
    """Rows with start, end and text of each WebVTT or SRT block that has a timing line and says something."""
    block = F.explode(F.split(F.replace(F.col(content), F.lit("\r\n"), F.lit("\n")), r"\n\s*\n"))
    lines = F.filter(F.transform(F.split(F.col("block"), "\n"), lambda x: F.trim(x)), lambda x: x != "")
    at = F.array_position(F.transform(F.col("lines"), lambda x: F.contains(x, F.lit("-->"))), True)
    out = rows.withColumn("block", block).withColumn("lines", lines).withColumn("at", at).where("at > 0")
    timing = F.element_at("lines", F.col("at").cast("int"))
    body = F.array_join(F.slice("lines", F.col("at").cast("int") + 1, F.greatest(F.size("lines") - F.col("at").cast("int"), F.lit(0))), " ")
    left, right = F.trim(F.substring_index(timing, "-->", 1)), F.split(F.trim(F.regexp_replace(timing, "^.*?-->", "")), r"\s+")
    out = out.withColumn("start", subtitle_seconds(left)).withColumn("end", subtitle_seconds(F.get(right, F.lit(0)))).withColumn("text", clean_markup(body))
    return out.where("text <> ''").drop("block", "lines", "at", content)


def parse_subtitles(files: DataFrame) -> DataFrame:
    """(path, start, end, text) of files of any of the three kinds."""
    return parse_json3(files.where("kind = 'json3'")).unionByName(parse_blocks(files.where("kind IN ('vtt', 'srt')"))).drop("kind")
