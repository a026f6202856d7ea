"""Evidence-shaped views over the driver's tables, and the SQL that makes the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def items(spark, d) -> DataFrame:
    """Transcript items with integer times in ms: (video_id, item_ord, speaker, text, asr_confidence, start_ms, end_ms)."""
    rows = table(spark, d, "conversations").select(
        F.col("conv_id").alias("video_id"), F.col("turn").alias("item_ord"), F.col("role").alias("speaker"), "text",
        F.when(F.col("turn") % 7 != 6, F.col("turn") % 5 / 4).alias("asr_confidence"),
        F.greatest(F.lit(1000), F.length("text") * 60).cast("long").alias("dur_ms"), F.when(F.col("turn") % 3 == 2, 6000).otherwise(500).alias("gap_ms"),
    )
    w = Window.partitionBy("video_id").orderBy("item_ord").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.col("dur_ms") + F.col("gap_ms")).over(w), F.lit(0)).cast("long")
    return rows.withColumn("start_ms", start).withColumn("end_ms", F.col("start_ms") + F.col("dur_ms")).drop("dur_ms", "gap_ms")


def frames(spark, d) -> DataFrame:
    """Frames with 64-bit hashes: (video_id, frame_id, ts_ms, phash, selected)."""
    w = Window.partitionBy(F.col("user_id") % 50).orderBy("ts", "event_id")
    bucket = F.floor(F.col("value") / 100).cast("long").cast("string")
    return table(spark, d, "events").select(
        (F.col("user_id") % 50).alias("video_id"), F.col("event_id").alias("frame_id"), ((F.row_number().over(w) - 1) * 700).cast("long").alias("ts_ms"),
        F.substring(F.sha2(F.concat(F.col("event_type"), F.lit("|"), bucket), 256), 1, 16).alias("phash"), (F.col("event_type") == "view").alias("selected"),
    )


def evidence(spark, d) -> DataFrame:
    """Evidence rows: (video_id, doc_id, evidence_type, start_s, end_s, text)."""
    kind = F.when(F.col("doc_id") % 3 == 0, "speech").when(F.col("doc_id") % 3 == 1, "frame_caption").otherwise("frame")
    return table(spark, d, "documents").select(
        F.col("source").alias("video_id"), "doc_id", kind.alias("evidence_type"), (F.col("doc_id") * 10).cast("double").alias("start_s"),
        (F.col("doc_id") * 10 + 10).cast("double").alias("end_s"), F.col("text"),
    )


def query_texts(spark, d) -> DataFrame:
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def views(spark, d) -> DataFrame:
    return table(spark, d, "embeddings").select("vec_id", F.col("label").cast("long").alias("cluster_id"), (F.col("vec_id") % 7).alias("author"), "embedding")


def memories(spark, d) -> DataFrame:
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    return table(spark, d, "events").groupBy("event_type", "user_id").agg(F.count("*").alias("frequency"), F.max(us).alias("last_us"))


def stages(spark, d) -> DataFrame:
    stage = F.when(F.col("event_type") == "signup", "multimodal").when(F.col("event_type") == "view", "index").when(F.col("event_type") == "click", "summary")
    status = F.when(F.col("event_type") == "error", "failed_retryable").when(F.col("value") < 50, "running").when(F.col("value") < 150, "succeeded")
    return table(spark, d, "events").select(
        F.col("user_id").alias("video_id"), "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("ts_us"),
        stage.when(F.col("event_type") == "purchase", "storyline").otherwise("pipeline").alias("stage"), status.otherwise("degraded").alias("status"),
    )


def ranges(spark, d) -> DataFrame:
    second = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000000).cast("long")
    return table(spark, d, "events").select(F.col("user_id").alias("key"), "event_id", (second - 1800).alias("start_s"), (second + 1800).alias("end_s"))


#: Questions in both of the engine's languages.
QUESTIONS = [
    (1, "01:20 视频里发生了什么？"), (2, "What happens from 00:30 to 01:30 in the video?"), (3, "请问十分钟左右讲了什么"), (4, "A. red\nB. blue\nC: green"),
    (5, "这个视频使用了什么软件？"), (6, "为什么作者说这个模型更好？"), (7, "先安装还是先配置？"), (8, "Compare the two stages of the whole video"),
    (9, "画面里的按钮在哪里"), (10, "上一个视频提到的工具是什么"), (11, "20分钟 30秒 和 5 minutes 的操作建议"), (12, "开头讲了什么"), (13, "What is shown on-screen before 2:05?"),
    (14, "总结一下核心观点"), (15, "怎么点击这个图表？"), (16, "作者的交易建议是什么"), (17, "What did the speaker say about API_BASE_URL v2.5?"), (18, "学a习 证据绑定"),
    (19, "12:30到13:45之间的转折"), (20, "二十五分钟的代码演示"),
]


def questions(spark) -> DataFrame:
    return spark.createDataFrame(QUESTIONS, "question_id long, question string")


def asked(spark, d) -> DataFrame:
    """The questions, and every turn of the conversations as one: (question_id, question)."""
    turns = table(spark, d, "conversations").select((1000 + F.col("conv_id") * 1000 + F.col("turn")).cast("long").alias("question_id"), F.col("text").alias("question"))
    return questions(spark).union(turns.where("question IS NOT NULL"))


def _values(rows, names: str) -> str:
    quoted = ", ".join("(" + ", ".join("'" + x.replace("'", "''") + "'" if isinstance(x, str) else "NULL" if x is None else str(x) for x in row) + ")" for row in rows)
    return f"SELECT * FROM (VALUES {quoted}) AS v({names})"


#: The views in SQL, by name.
SQL = {
    "items": """SELECT video_id, item_ord, speaker, text, CASE WHEN item_ord % 7 <> 6 THEN (item_ord % 5) / 4.0::DOUBLE END AS asr_confidence, CAST(COALESCE(SUM(dur_ms + gap_ms) OVER w, 0) AS BIGINT) AS start_ms,
        CAST(COALESCE(SUM(dur_ms + gap_ms) OVER w, 0) + dur_ms AS BIGINT) AS end_ms
        FROM (SELECT conv_id AS video_id, turn AS item_ord, role AS speaker, text, CAST(greatest(1000, length(text) * 60) AS BIGINT) AS dur_ms,
              CASE WHEN turn % 3 = 2 THEN 6000 ELSE 500 END AS gap_ms FROM conversations) x
        WINDOW w AS (PARTITION BY video_id ORDER BY item_ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""",
    "frames": """SELECT user_id % 50 AS video_id, event_id AS frame_id, CAST(700 * (row_number() OVER (PARTITION BY user_id % 50 ORDER BY ts, event_id) - 1) AS BIGINT) AS ts_ms,
        substr(sha256(concat(event_type, '|', CAST(CAST(floor(value / 100) AS BIGINT) AS VARCHAR))), 1, 16) AS phash, event_type = 'view' AS selected FROM events""",
    "evidence": """SELECT source AS video_id, doc_id, CASE doc_id % 3 WHEN 0 THEN 'speech' WHEN 1 THEN 'frame_caption' ELSE 'frame' END AS evidence_type,
        CAST(doc_id * 10 AS DOUBLE) AS start_s, CAST(doc_id * 10 + 10 AS DOUBLE) AS end_s, text FROM documents""",
    "query_texts": "SELECT item_id AS query_id, text FROM benchmark",
    "views": "SELECT vec_id, CAST(label AS BIGINT) AS cluster_id, vec_id % 7 AS author, CAST(embedding AS DOUBLE[]) AS embedding FROM embeddings",
    "memories": "SELECT event_type, user_id, count(*) AS frequency, max(epoch_us(ts)) AS last_us FROM events GROUP BY 1, 2",
    "stages": """SELECT user_id AS video_id, event_id, epoch_us(ts) AS ts_us,
        CASE event_type WHEN 'signup' THEN 'multimodal' WHEN 'view' THEN 'index' WHEN 'click' THEN 'summary' WHEN 'purchase' THEN 'storyline' ELSE 'pipeline' END AS stage,
        CASE WHEN event_type = 'error' THEN 'failed_retryable' WHEN value < 50 THEN 'running' WHEN value < 150 THEN 'succeeded' ELSE 'degraded' END AS status FROM events""",
    "ranges": """SELECT user_id AS key, event_id, CAST(floor(epoch_us(ts) / 1000000) AS BIGINT) - 1800 AS start_s,
        CAST(floor(epoch_us(ts) / 1000000) AS BIGINT) + 1800 AS end_s FROM events""",
    "questions": f"SELECT CAST(question_id AS BIGINT) AS question_id, question FROM ({_values(QUESTIONS, 'question_id, question')}) q",
}
SQL["asked"] = f"SELECT question_id, question FROM ({SQL['questions']}) q UNION ALL SELECT CAST(1000 + conv_id * 1000 + turn AS BIGINT), text FROM conversations WHERE text IS NOT NULL"


def sql(names: str, body: str, recursive: bool = False) -> str:
    """``body`` with the named views as common table expressions before it."""
    own = ", ".join(f"{n} AS ({SQL[n]})" for n in names.split())
    rest = body.strip()
    return f"WITH {'RECURSIVE ' if recursive else ''}{own}{', ' if rest[:5].upper() != 'SELEC' else ' '}{rest}"
