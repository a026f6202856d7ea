"""Two-stage live analysis: items go into a table as they arrive, a stateful stream segments them and keeps snapshots."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.text import TOPIC_MARKERS, normalize_asr
from tessera.operators.segment import MAX_CHARS

#: What an item is; ``is_last`` marks a source's last one.
ITEM = "video_id {kind}, item_ord long, start_s double, end_s double, text string, is_last boolean"

#: What is told of a source, and rows of it that one row of a stateful step holds: a data frame of each source's rows costs more than its fold.
FOUND = "kind string, segment long, start_s double, end_s double, n_items long, text string, n_segments long, next_ord long, waiting long, status string, error string"
TOLD = 256


def _store(rows: DataFrame, folder: str, number: int) -> None:
    """A batch's rows under its number: a batch that is run again replaces what it wrote."""
    rows.withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(folder)


def _start(stream: DataFrame, each, checkpoint: str, trigger: dict | None, mode: str = "append"):
    return stream.writeStream.foreachBatch(each).outputMode(mode).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def ingest(items: DataFrame, folder: str, checkpoint: str, trigger: dict | None = None):
    """Stage one: a stream of items into ``folder``/items, batch by batch; the running query."""
    return _start(items, lambda rows, number: _store(rows, f"{folder}/items", number), checkpoint, trigger)


class _Source:
    """What is held of a source: its open segment, and items that came before one that is still missing."""

    def __init__(self, held: str | None):
        self.s = json.loads(held) if held else {"next": 0, "segment": -1, "begin": 0.0, "size": 0, "texts": [], "start": 0.0, "end": 0.0, "n": 0, "closed": 0, "status": "running", "error": None, "waiting": {}}

    def take(self, rows, first: int, rule) -> list[tuple]:
        """Closed segments after new items. Items are taken in their order, each once: those taken before are left out, later ones wait."""
        s, out = self.s, []
        s["next"] = max(s["next"], first)
        for ord_, *item in rows:
            if ord_ is not None and ord_ >= s["next"]:
                s["waiting"].setdefault(str(ord_), item)
        while s["status"] == "running" and (item := s["waiting"].pop(str(s["next"]), None)) is not None:
            s["next"] += 1
            start, end, text, marked, last = item
            if start is None or end is None or end < start:
                s["status"], s["error"] = "failed", f"item {s['next'] - 1} has no valid times"
            elif text:
                if s["segment"] < 0 or rule(end - s["begin"], marked, s["size"] + len(text)):
                    out += self.close()
                    s.update(segment=s["segment"] + 1, begin=start, size=len(text), texts=[], start=start, end=end, n=0)
                else:
                    s["size"] += 1 + len(text)
                s["texts"].append(text)
                s.update(start=min(s["start"], start), end=max(s["end"], end), n=s["n"] + 1)
            if last and s["status"] == "running":
                s["status"] = "succeeded"
                out += self.close()
        if s["status"] != "running":
            s["waiting"] = {}
        return out

    def close(self) -> list[tuple]:
        s = self.s
        if not s["n"]:
            return []
        found = (s["segment"], s["start"], s["end"], s["n"], " ".join(s["texts"])[:MAX_CHARS])
        s.update(n=0, texts=[], closed=s["closed"] + 1)
        return [found]


def analyse(items: DataFrame, shortest: float = 60.0, longest: float = 120.0, chars: int = MAX_CHARS, first: int = 0) -> DataFrame:
    """Stage two, as a stream: (video_id, kind, segment, start_s, end_s, n_items, text, n_segments, next_ord, waiting, status, error).

    Segments are those of ``segment_transcript``, put out as they close; a snapshot of each source follows every batch that touched it. A source's
    items may arrive in any order and more than once: they are taken by item_ord, from ``first`` on without gaps. What is held is
    the open segment and the items that wait. An item without valid times fails its source, whose further items are left out.
    """
    lows = [m.lower() for m in TOPIC_MARKERS]
    marked = F.exists(F.array(*[F.lit(m) for m in lows]), lambda m: F.contains(F.lower("text"), m))
    rows = items.withColumn("text", F.coalesce(normalize_asr(F.col("text")), F.lit(""))).withColumn("marked", marked)
    rows = rows.select("video_id", "item_ord", "start_s", "end_s", "text", "marked", F.coalesce("is_last", F.lit(False)).alias("is_last"))
    kind = dict(items.dtypes)["video_id"]

    def rule(lasts, mark, size):
        return lasts >= longest or lasts >= shortest and mark or size > chars

    def update(key, batches, state):
        import pandas as pd

        source = _Source(state.get[0] if state.exists else None)
        new = []
        for pdf in batches:
            new += zip(*(pdf[c].tolist() for c in ("item_ord", "start_s", "end_s", "text", "marked", "is_last")))
        known = lambda x, kind: None if x is None or x != x else kind(x)
        new = [(known(o, int), known(a, float), known(b, float), t, bool(m), bool(e)) for o, a, b, t, m, e in new]
        out = [dict(zip(("kind", "segment", "start_s", "end_s", "n_items", "text"), ("segment", *found))) for found in source.take(new, first, rule)]
        s = source.s
        out.append({"kind": "snapshot", "n_segments": s["closed"], "next_ord": s["next"], "waiting": len(s["waiting"]), "status": s["status"], "error": s["error"]})
        state.update((json.dumps(s),))
        told = [json.dumps(out[i : i + TOLD]) for i in range(0, len(out), TOLD)]
        yield pd.DataFrame({"video_id": [key[0]] * len(told), "told": told})

    told = rows.groupBy("video_id").applyInPandasWithState(update, f"video_id {kind}, told string", "held string", "update", "NoTimeout")
    return told.select("video_id", F.inline(F.from_json("told", f"array<struct<{FOUND}>>")))


def run_analysis(spark: SparkSession, folder: str, checkpoint: str, kind: str = "string", files_per_trigger: int = 8, trigger: dict | None = None, **options):
    """Stage two over the table that stage one writes: segments and snapshots of each batch into ``folder``; the running query."""
    items = spark.readStream.schema(ITEM.format(kind=kind) + ", batch int").option("maxFilesPerTrigger", files_per_trigger).parquet(f"{folder}/items")

    def store(rows, number):
        rows = rows.persist()
        _store(rows.where("kind = 'segment'").select("video_id", "segment", "start_s", "end_s", "n_items", "text"), f"{folder}/segments", number)
        _store(rows.where("kind = 'snapshot'").select("video_id", "n_segments", "next_ord", "waiting", "status", "error"), f"{folder}/snapshots", number)
        rows.unpersist()

    return _start(analyse(items, **options), store, checkpoint, trigger, "update")


def snapshots(spark: SparkSession, folder: str) -> DataFrame:
    """(video_id, n_segments, next_ord, waiting, status, error): the latest of each source."""
    rows = spark.read.parquet(f"{folder}/snapshots")
    return rows.groupBy("video_id").agg(F.max_by(F.struct(*[c for c in rows.columns if c not in ("video_id", "batch")]), "batch").alias("s")).select("video_id", "s.*")


def segments(spark: SparkSession, folder: str) -> DataFrame:
    """(video_id, segment, start_s, end_s, n_items, text) closed so far."""
    return spark.read.parquet(f"{folder}/segments").drop("batch")


def batch_state(found: DataFrame) -> DataFrame:
    """(total, completed, failed, running) over the snapshots."""
    return found.agg(F.count("*").alias("total"), *(F.count_if(F.col("status") == s).alias(n) for s, n in (("succeeded", "completed"), ("failed", "failed"), ("running", "running"))))


def land(items: DataFrame, folder: str, files: int = 6) -> None:
    """Items of a table as files for stage one, so dealt that a source's come in several, with its last one marked."""
    last = F.max("item_ord").over(Window.partitionBy("video_id"))
    items.withColumn("is_last", F.col("item_ord") == last).repartition(files, "item_ord").write.mode("overwrite").parquet(folder)
