"""Live inputs by Structured Streaming: stage counts and state, windowed speech, two-stage ingestion."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_stream(spark: SparkSession, path: str, schema, files_per_trigger: int = 4) -> DataFrame:
    """New Parquet files of a folder; the limit on files is the admission control."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def stage_counts(events: DataFrame) -> DataFrame:
    """Running counts by stage and status."""
    return events.groupBy("stage", "status").agg(F.count("*").alias("n"))


def windowed_counts(events: DataFrame, at: str, late: str = "10 minutes", width: str = "5 minutes", by: str = "event_type") -> DataFrame:
    """Counts in tumbling windows; events later than the watermark are left out."""
    return events.withWatermark(at, late).groupBy(F.window(at, width), by).agg(F.count("*").alias("n"))


def live_sessions(events: DataFrame, at: str, key: str, gap: str = "4 seconds", late: str = "1 minute") -> DataFrame:
    """Sessions of a key's events split at silences: the streaming form of the silence split."""
    return events.withWatermark(at, late).groupBy(F.session_window(at, gap), key).agg(F.count("*").alias("n"))


def stage_machine(events: DataFrame) -> DataFrame:
    """(video_id, stage, status, n_events): the state of each stage after every batch, kept by key."""

    def update(key, batches, state):
        import pandas as pd

        last, status, n = state.get if state.exists else (-1, "", 0)
        for pdf in batches:
            n += len(pdf)
            top = pdf.sort_values(["ts_us", "event_id"]).iloc[-1]
            if top["ts_us"] >= last:
                last, status = int(top["ts_us"]), top["status"]
        state.update((last, status, n))
        yield pd.DataFrame({"video_id": [key[0]], "stage": [key[1]], "status": [status], "n_events": [n]})

    return events.groupBy("video_id", "stage").applyInPandasWithState(update, "video_id long, stage string, status string, n_events long", "last long, status string, n long", "update", "NoTimeout")


def run_to_end(df: DataFrame, name: str, mode: str, checkpoint: str) -> DataFrame:
    """Process what there is, into a table of a name: for tests and backfills."""
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)


def two_stage(events: DataFrame, sink: str, checkpoint: str):
    """Ingest batches into a partitioned table, each batch written once under its number."""

    def store(batch, number):
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(sink)

    return events.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
