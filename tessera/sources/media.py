"""What surrounds media: downloaded subtitle tracks, cookies, recognisers' replies, commands, mock sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BROWSERS = ["brave", "chrome", "chromium", "edge", "firefox", "opera", "safari", "vivaldi", "whale"]
COOKIE_HEADER = "# Netscape HTTP Cookie File"
#: What a decoder says when another codec would do (fixed values).
DECODE_SIGNALS = ["av1", "missing sequence header", "failed to get pixel format", "function not implemented", "error while decoding stream"]
_TRACKS = "struct<subtitles:map<string,array<struct<ext:string,filepath:string>>>,automatic_captions:map<string,array<struct<ext:string,filepath:string>>>>"
_REPLY = "struct<segments:array<struct<start:double,`end`:double,text:string>>,text:string>"


def json3_track(info: Column) -> Column:
    """The path of the first downloaded json3 track of a video's info: own subtitles, or automatic ones if it has none."""
    v = F.from_json(info, _TRACKS)
    own = F.when(F.size(v["subtitles"]) > 0, v["subtitles"]).otherwise(v["automatic_captions"])
    found = F.filter(F.flatten(F.map_values(own)), lambda t: (t["ext"] == "json3") & (F.coalesce(t["filepath"], F.lit("")) != ""))
    return F.get(found, F.lit(0))["filepath"]


def cookie_spec(value: Column) -> Column:
    """(browser, profile, known) of ``browser`` or ``browser:profile``."""
    browser = F.lower(F.trim(F.substring_index(value, ":", 1)))
    profile = F.when(F.contains(value, F.lit(":")), F.nullif(F.trim(F.regexp_replace(value, "^[^:]*:", "")), F.lit("")))
    return F.struct(browser.alias("browser"), profile.alias("profile"), browser.isin(BROWSERS).alias("known"))


def is_cookie_file(content: Column) -> Column:
    """Whether a file is in the tab-separated cookie format: by its header, else by its first line that says either way."""
    lines = F.filter(F.transform(F.split(content, r"\r\n|\n|\r"), lambda x: F.btrim(x, F.lit(" \t\x0b\x0c"))), lambda x: x != "")
    headed = F.exists(F.slice(lines, 1, 5), lambda x: x.startswith(COOKIE_HEADER))
    bad = lambda x: x.startswith("YTDLP_") | x.startswith("http://") | x.startswith("https://") | F.contains(x, F.lit("=")) & ~F.contains(x, F.lit("\t"))
    good = lambda x: F.size(F.split(x, "\t")) >= 7
    telling = F.get(F.filter(lines, lambda x: ~x.startswith("#") & (bad(x) | good(x))), F.lit(0))
    return F.coalesce(headed | (telling.isNotNull() & ~bad(telling)), F.lit(False))


def recognised_items(replies: DataFrame, key: str, reply: str) -> DataFrame:
    """(key, item_ord, start_s, end_s, text): the segments of a recogniser's verbose reply, else its whole text at 0; blank ones go."""
    v = F.from_json(F.col(reply), _REPLY)
    parts = F.filter(F.coalesce(v["segments"], F.array().cast("array<struct<start:double,end:double,text:string>>")), lambda x: F.coalesce(x["text"], F.lit("")) != "")
    whole = F.when(F.coalesce(v["text"], F.lit("")) != "", F.array(F.struct(F.lit(0.0).alias("start"), F.lit(0.0).alias("end"), v["text"].alias("text"))))
    rows = replies.select(key, F.posexplode(F.when(F.size(v["segments"]) > 0, parts).otherwise(whole)).alias("item_ord", "x"))
    start = F.coalesce("x.start", F.lit(0.0))
    return rows.select(key, F.col("item_ord").cast("long").alias("item_ord"), start.alias("start_s"), F.coalesce("x.end", start).alias("end_s"), F.col("x.text").alias("text"))


def frame_command(source: Column, pattern: Column, fps: Column, start: Column, end: Column) -> Column:
    """The decoder's arguments that take frames of a stretch of a source."""
    said = lambda *words: F.array(*[F.lit(w) if isinstance(w, str) else w for w in words])
    none = F.array().cast("array<string>")
    return F.concat(
        said("ffmpeg", "-y", "-hwaccel", "none", "-analyzeduration", "100M", "-probesize", "100M"),
        F.when(start.isNotNull(), said("-ss", start.cast("string"))).otherwise(none),
        F.when(start.isNotNull() & end.isNotNull(), said("-t", F.greatest(F.lit(0.0), end - start).cast("string"))).otherwise(none),
        said("-i", source, "-vf", F.concat(F.lit("fps="), fps.cast("string")), "-q:v", "3", pattern),
    )


def needs_other_codec(stderr: Column) -> Column:
    return F.exists(F.array(*[F.lit(s) for s in DECODE_SIGNALS]), lambda s: F.contains(F.lower(stderr), s))


def mock_items(spark: SparkSession, videos: int = 1, n: int = 6) -> DataFrame:
    """(video_id, item_ord, start_s, end_s, text): transcripts for trying things out, an item every 55 seconds."""
    said = F.element_at(F.array(*[F.lit(t) for t in ("First we look at how evidence is kept.", "Next, every claim names the segment it rests on.", "However, pictures are read only where words do not do.")]), (F.col("item_ord") % 3 + 1).cast("int"))
    rows = spark.range(videos).select(F.col("id").alias("video_id"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))).alias("item_ord"))
    return rows.select("video_id", "item_ord", (F.col("item_ord") * 55.0).alias("start_s"), (F.col("item_ord") * 55.0 + 50).alias("end_s"), said.alias("text"))


def mock_frames(segments: DataFrame, key: str = "video_id") -> DataFrame:
    """(key, frame_id, ts_s, selected): a frame at the start of each segment."""
    return segments.select(key, F.format_string("f_%010d", (F.col("start_s") * 1000).cast("long")).alias("frame_id"), F.col("start_s").alias("ts_s"), F.lit(True).alias("selected"))


def search_rows(replies: DataFrame, key: str, reply: str) -> DataFrame:
    """(key, pos, content): rows of a memory service's reply, whatever it calls their list; else its text as one row."""
    v = F.try_parse_json(F.col(reply))
    lists = [F.try_variant_get(v, f"$.{n}", "array<variant>") for n in ("items", "results", "drawers")]
    several = F.coalesce(*[F.when(F.size(x) > 0, x) for x in lists])
    rows = F.transform(several, lambda x: F.coalesce(F.try_variant_get(x, "$.content", "string"), F.try_variant_get(x, "$", "string")))
    texts = F.filter(F.transform(F.try_variant_get(v, "$.content", "array<variant>"), lambda x: F.try_variant_get(x, "$.text", "string")), lambda x: x.isNotNull())
    text = F.coalesce(F.nullif(F.trim(F.array_join(texts, "\n")), F.lit("")), F.nullif(F.try_variant_get(v, "$.result", "string"), F.lit("")))
    found = F.coalesce(rows, F.when(text.isNotNull(), F.array(text)))
    return replies.select(key, F.posexplode(found).alias("pos", "content")).where("content IS NOT NULL")
