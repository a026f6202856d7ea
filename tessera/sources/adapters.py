"""Other inputs: URLs, evaluation cases, artifacts, frames, upload checks; and sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SUFFIXES = [".mp4", ".mkv", ".mov", ".webm", ".avi", ".m4v", ".mp3", ".wav", ".m4a"]
MAX_BYTES = 4 * 1024**3


def url_video_id(url: Column) -> Column:
    """``v=``, short-link, shorts or embed id of a URL, else the start of its SHA-1."""
    return F.coalesce(
        F.nullif(F.regexp_extract(url, r"[?&]v=([A-Za-z0-9_-]{6,})", 1), F.lit("")),
        F.nullif(F.regexp_extract(url, r"youtu\.be/([A-Za-z0-9_-]{6,})", 1), F.lit("")),
        F.nullif(F.regexp_extract(url, r"/(?:shorts|embed)/([A-Za-z0-9_-]{6,})", 1), F.lit("")),
        F.substring(F.sha1(url.cast("binary")), 1, 12),
    )


def url_safe(url: Column) -> Column:
    """http(s) to a public host name, without credentials; address literals must be global."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?(\[[^\]]*\]|[^/:?#]*)", 1))
    ipv4 = host.rlike(r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$")
    private = host.rlike(r"^(10\.|127\.|0\.|169\.254\.|192\.168\.|192\.0\.[02]\.|198\.1[89]\.|198\.51\.100\.|203\.0\.113\.|172\.(1[6-9]|2[0-9]|3[01])\.|100\.(6[4-9]|[7-9][0-9]|1[01][0-9]|12[0-7])\.|22[4-9]\.|2[3-5][0-9]\.)")
    inside = (host == "localhost") | host.endswith(".localhost") | host.endswith(".local") | (host == "") | host.startswith("[")
    return url.rlike("(?i)^https?://") & ~url.rlike(r"^[A-Za-z]+://[^/?#]*@") & ~inside & ~(ipv4 & private)


def content_hash_id(content: Column) -> Column:
    return F.concat(F.lit("local_"), F.substring(F.sha1(content.cast("binary")), 1, 12))


def read_media(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.format("binaryFile").load(path)
    return rows.select(content_hash_id(F.col("content")).alias("video_id"), F.col("path").alias("local_path"), F.col("length"))


def read_artifacts(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON documents, one a file, with the declared schema and their file's path."""
    return spark.read.schema(schema).json(path, multiLine=True).withColumn("path", F.col("_metadata.file_path"))


def eval_cases(raw: DataFrame, column: str = "value") -> DataFrame:
    """Cases from JSON lines whose fields go by several names; scalars count as lists of one."""
    v = F.try_parse_json(F.col(column))
    first = lambda kind, *names: F.coalesce(*[F.try_variant_get(v, f"$.{n}", kind) for n in names])
    many = lambda *names: F.coalesce(*[x for n in names for x in (F.try_variant_get(v, f"$.{n}", "array<string>"), F.when(F.try_variant_get(v, f"$.{n}", "string").isNotNull(), F.array(F.try_variant_get(v, f"$.{n}", "string"))))], F.array().cast("array<string>"))
    return raw.select(
        first("string", "case_id", "id").alias("case_id"), first("string", "video_id", "video").alias("video_id"), first("string", "question", "query").alias("question"),
        many("answer", "answers", "expected_answer", "gold_answer").alias("answers"), many("evidence_ids", "gold_evidence_ids", "segment_ids").alias("evidence_ids"),
    ).where("question IS NOT NULL")


def error_class(message: Column) -> Column:
    low = F.lower(message)
    has = lambda *words: F.lit(False) if not words else low.rlike("|".join(words))
    return F.when(has("cookie", "sign in", "login", "bot"), "auth").when(has("timeout", "timed out", "temporarily", "connection"), "network").when(has("404", "unavailable", "private", "removed"), "unavailable").otherwise("unknown")


def retry_class(status: Column, message: Column) -> Column:
    return F.when(status == 429, "cooldown").when(status.isin(500, 502, 503, 504) | F.lower(message).rlike("timeout|timed out"), "retry").otherwise("fail")


def frames_from_sequence(paths: DataFrame, key: str, path: str, fps: float, start_s: float = 0.0) -> DataFrame:
    """Frames of a source in the order of their paths: timestamp start + i / fps, id from whole milliseconds."""
    at = F.row_number().over(Window.partitionBy(key).orderBy(path)) - 1
    rows = paths.withColumn("timestamp", F.lit(start_s) + at / F.lit(fps))
    return rows.withColumn("frame_name", F.format_string("f_%010d", F.floor(F.round(F.col("timestamp") * 1000, 6)).cast("long")))


def upload_checks(rows: DataFrame, name: str, size: str) -> DataFrame:
    """Rows with ok: a known suffix, some bytes, not too many."""
    suffix = F.lower(F.regexp_extract(F.col(name), r"(\.[A-Za-z0-9]+)$", 1))
    return rows.withColumn("ok", suffix.isin(SUFFIXES) & (F.col(size) > 0) & (F.col(size) <= MAX_BYTES))


def upsert(old: DataFrame, new: DataFrame, key: list[str], order: str) -> DataFrame:
    """Rows of both, the newest of each key: ``insert or replace``."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    rank = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("_new"), F.desc(order)))
    return both.withColumn("_rn", rank).where("_rn = 1").drop("_rn", "_new")


def write_partitioned(df: DataFrame, path: str, by: str = "video_id") -> None:
    """Overwrite only the partitions present, files becoming visible when the job commits."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def notes(rows: DataFrame, key: str, order: str, line: Column) -> DataFrame:
    """(key, note): lines of a note in order, one note a key."""
    lines = rows.select(key, F.struct(F.col(order).alias("o"), line.alias("l")).alias("x")).groupBy(key).agg(F.array_sort(F.collect_list("x")).alias("x"))
    return lines.select(key, F.array_join(F.transform("x", lambda x: x["l"]), "\n").alias("note"))


def frame_paths(wanted: DataFrame, files: DataFrame, frame: str) -> DataFrame:
    """wanted with the first path whose file is named like its frame, null without any. files: (path)."""
    named = files.select("path", F.regexp_extract("path", r"([^/]+)\.[^./]*$", 1).alias(frame)).groupBy(frame).agg(F.min("path").alias("path"))
    return wanted.join(named, frame, "left")


def append_once(log: DataFrame, blocks: DataFrame, key: str) -> DataFrame:
    """The blocks that the log does not hold yet, each once."""
    return blocks.dropDuplicates([key]).join(log.select(key), key, "left_anti")
