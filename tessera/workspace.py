"""A folder of tables, one a kind, partitioned by source: what the commands read and write."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.engine import Engine
from tessera.operators import contract, memory, metrics, postings
from tessera.sources import subtitles
from tessera.sources.adapters import notes, write_partitioned
from tessera.sources.locks import Locks, lock_of
from tessera.storage import materialise


class Workspace:
    """Jobs over all sources of a folder at once; a source that is processed again replaces its own rows only."""

    def __init__(self, spark: SparkSession, folder: str, engine: Engine | None = None):
        self.spark, self.folder, self.engine = spark, folder.rstrip("/"), engine or Engine(spark)

    def read(self, kind: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{kind}")

    def write(self, kind: str, rows: DataFrame) -> None:
        write_partitioned(rows, f"{self.folder}/{kind}")

    def ingest(self, path: str) -> None:
        """Subtitle files to transcript items; a source is named like its file."""
        rows = subtitles.parse_subtitles(subtitles.read_files(self.spark, path))
        named = rows.select(F.regexp_extract("path", r"([^/]+?)(?:\.[A-Za-z-]{2,7})?\.[^./]+$", 1).alias("video_id"), F.col("start").alias("start_s"), F.col("end").alias("end_s"), "text")
        order = F.row_number().over(Window.partitionBy("video_id").orderBy("start_s", "end_s", "text")).cast("long")
        self.write("items", named.withColumn("item_ord", order))

    def exists(self, kind: str) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{kind}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def process(self, force: bool = False) -> list:
        """Segments, evidence, storyline and summary of the sources whose items have changed since they were processed; these sources.

        A source's fingerprint is written after all else of it, so a run that dies is made up for by the next one. ``force`` takes all.
        Sources that another run is processing are left to it: each run holds the locks of those it writes.
        """
        items = self.read("items")
        h = F.xxhash64("item_ord", "start_s", "end_s", "text")
        prints = items.groupBy("video_id").agg(F.concat_ws(":", F.count("*"), F.bit_xor(h), F.sum(F.shiftright(h, 16))).alias("fingerprint"))
        if not force and self.exists("processed"):
            done = self.read("processed").select(F.col("video_id").cast(prints.schema["video_id"].dataType).alias("_v"), F.col("fingerprint").alias("_f"))
            prints = prints.join(done, (F.col("video_id") == F.col("_v")) & (F.col("fingerprint") == F.col("_f")), "left_anti")
        prints = materialise(prints.withColumn("_lock", lock_of("video_id")))
        wanted = [r["_lock"] for r in prints.select("_lock").distinct().collect()]
        with Locks(self.spark, self.folder).holding(wanted) as held:
            mine = prints.where(F.col("_lock").isin(sorted(held))).drop("_lock")
            return self._process(items, mine) if held else []

    def _process(self, items: DataFrame, prints: DataFrame) -> list:
        segments = materialise(self.engine.segments(items.join(prints.select("video_id"), "video_id", "left_semi")))
        self.write("segments", segments)
        self.write("evidence", self.engine.evidence(segments))
        self.write("storyline", self.engine.storyline(segments))
        self.write("summary", self.engine.summary(segments))
        self.index()
        self.write("processed", prints)
        return sorted(r["video_id"] for r in prints.select("video_id").collect())

    def rebuild_index(self) -> None:
        """All evidence anew from the segments; captions that were added go."""
        self.write("evidence", self.engine.evidence(self.read("segments")))
        self.index()

    def index(self) -> list[int]:
        """The stored postings brought up to date with the evidence; see operators.postings."""
        return postings.sync(self.read("evidence").select("video_id", "doc_id", "evidence_type", "text"), f"{self.folder}/index")

    def find(self, questions: DataFrame, top_k: int = 8, types: list[str] | None = None) -> DataFrame:
        """(query_id, video_id, doc_id, raw, score, rank) by words, from the stored postings."""
        return postings.search(self.spark, f"{self.folder}/index", questions.select(F.col("question_id").alias("query_id"), F.col("question").alias("text")), top_k, types)

    def summarize(self) -> None:
        self.write("summary", self.engine.summary(self.read("segments")))

    def ask(self, questions: DataFrame, mode: str = "hybrid", frames: DataFrame | None = None) -> DataFrame:
        return self.engine.ask(self.read("evidence"), questions, frames, mode)

    def refine_frames(self, questions: DataFrame, frames: DataFrame) -> DataFrame:
        """Caption evidence that the questions ask for, added to the evidence and the index; what was added or said anew."""
        evidence = self.read("evidence")
        found = self.engine.retrieve(evidence, questions)
        asked = found.select("query_id", "video_id").distinct().join(questions.select(F.col("question_id").alias("query_id"), "question"), "query_id")
        more = materialise(self.engine.refine(asked, evidence, found, frames))
        if not more.isEmpty():
            touched = evidence.join(more.select("video_id").distinct(), "video_id", "left_semi")
            kept = touched.join(more.select("video_id", "doc_id"), ["video_id", "doc_id"], "left_anti")
            self.write("evidence", materialise(kept.unionByName(more.select(kept.columns))))  # read before its sources are written again
            self.index()
        return more

    def export(self) -> DataFrame:
        """(video_id, note): a note a source, a line a node of its storyline."""
        line = F.concat(F.lit("- "), F.format_string("%.0f", "time_start"), F.lit("s: "), "claim")
        return notes(self.read("storyline"), "video_id", "time_start", line)

    def audit(self) -> DataFrame:
        segments = self.read("segments").select("video_id", "segment_id", F.lit("speech").alias("evidence_type"), "text")
        return contract.audit(self.read("storyline").select("video_id", F.array(F.concat(F.lit("seg_"), F.substring("node_id", -4, 4))).alias("segment_ids")), segments)

    def evaluate(self, cases: DataFrame, mode: str = "hybrid", top_k: int = 8) -> DataFrame:
        """(case_id, retrieval_hit_rate, segment_recall, grounding_precision, answer_contains_recall) of eval cases; see sources.adapters.eval_cases."""
        found = self.engine.retrieve(self.read("evidence"), cases.select(F.col("case_id").alias("question_id"), "question"), mode, top_k)
        gold = cases.select(F.col("case_id").alias("query_id"), F.explode("evidence_ids").alias("doc_id"))
        scores = metrics.prf1(cases.select(F.col("case_id").alias("query_id")), found.select("query_id", "doc_id").distinct(), gold, "query_id", "doc_id")
        answers = self.engine.answer(self.read("evidence"), cases.select(F.col("case_id").alias("question_id"), "question"), mode).groupBy("query_id").agg(F.concat_ws("\n", F.collect_list("answer")).alias("answer"))
        rows = scores.join(answers, "query_id", "left").join(cases.select(F.col("case_id").alias("query_id"), "answers"), "query_id")
        recall = metrics.contains_recall(F.coalesce("answer", F.lit("")), F.col("answers"))
        return rows.select(F.col("query_id").alias("case_id"), F.when(F.col("recall") > 0, 1.0).otherwise(0.0).alias("retrieval_hit_rate"), F.col("recall").alias("segment_recall"), F.col("precision").alias("grounding_precision"), recall.alias("answer_contains_recall"))

    def quality_gate(self, cases: DataFrame) -> DataFrame:
        """(metric, mean, n, threshold, ok) over all cases."""
        return metrics.aggregate(self.evaluate(cases), list(metrics.THRESHOLDS))

    def remember(self) -> None:
        """The storyline's supported claims as memories of their sources."""
        rows = self.read("storyline").select(F.concat(F.lit("vka_"), F.substring(F.sha2(F.concat_ws("|", F.col("video_id").cast("string"), "node_id"), 256), 1, 24)).alias("id"), "video_id", F.col("claim").alias("content"))
        self.write("memory", rows.where("trim(content) <> ''").withColumn("active", F.lit(True)).withColumn("synced", F.lit(False)))

    def memory_status(self) -> DataFrame:
        return memory.catalog_stats(self.read("memory"))

    def memory_search(self, questions: DataFrame, top_k: int = 5) -> DataFrame:
        docs = self.read("memory").where("active").select("video_id", F.col("id").alias("doc_id"), F.lit("speech").alias("evidence_type"), F.col("content").alias("text"))
        return self.engine.retrieve(docs, questions, "vector", top_k)
