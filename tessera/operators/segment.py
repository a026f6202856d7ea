"""Segmentation of transcripts and alignment with frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import TOPIC_MARKERS, entities, keywords, normalize_asr
from tessera.operators.fold import dealt_by_range, fits_one_task, fold_rows
from tessera.operators.intervals import point_join
from tessera.storage import materialise

MAX_CHARS = 1800
MERGE_CHARS = 1000


class _Rule:
    """Where a segment ends: ``state`` is (segment, begin, size, end of the item before)."""

    def __init__(self, shortest: float, longest: float, chars: int, gap: float | None):
        self.shortest, self.longest, self.chars, self.gap = shortest, longest, chars, gap

    def breaks(self, state: tuple, item: tuple) -> bool:
        _, begin, size, before = state
        start, end, n, marked = item
        lasts = end - begin
        return lasts >= self.longest or lasts >= self.shortest and marked or size + n > self.chars or self.gap is not None and start - before > self.gap

    def take(self, state: tuple | None, item: tuple) -> tuple:
        """The state after an item; without one before, the item opens the source's first segment."""
        if state is None or self.breaks(state, item):
            return (0 if state is None else state[0] + 1, item[0], item[2], item[1])
        return (state[0], state[1], state[2] + 1 + item[2], item[1])

    def head(self, items: list[tuple]) -> int:
        """Items within which any state from before must have ended: they alone have too many characters."""
        size = 0
        for i, item in enumerate(items):
            size += item[2] + 1
            if size > self.chars + 1:
                return i + 1
        return len(items)

    def exits(self, items: list[tuple], head: int) -> list[tuple]:
        """For each of the first ``head`` items the state at the last one if a segment 0 opens at it; no opening is followed twice."""
        known: dict[int, tuple] = {}
        for i in range(head):
            path, at = [], i
            while at not in known:
                state, j = self.take(None, items[at]), at + 1
                while j < len(items) and not self.breaks(state, items[j]):
                    state, j = self.take(state, items[j]), j + 1
                if j == len(items):
                    known[at] = state
                else:
                    path.append(at)
                    at = j
            after = known[at]
            for here in reversed(path):
                after = known[here] = (after[0] + 1, *after[1:])
        return [known[i] for i in range(head)]


def _incoming(parts, rule: _Rule) -> dict[int, tuple]:
    """The state with which each partition's first source goes on, by following the sources over partitions in order."""
    out: dict[int, tuple] = {}
    state, key, any_part = None, None, False
    for r in parts:
        on = any_part and r["first"] == key
        if on:
            out[r["_part"]] = state
            for item, after in zip(r["head"], r["exits"]):
                if rule.breaks(state, tuple(item)):
                    state = (state[0] + 1 + after[0], *tuple(after)[1:])
                    break
                state = rule.take(state, tuple(item))
        if not (on and r["alone"]):
            state = tuple(r["state"])
        key, any_part = r["last"], True
    return out


def _fold(items: DataFrame, key: str, order: list[str], shortest: float, longest: float, chars: int, gap: float | None) -> DataFrame:
    """(key, segment, *items' columns): number the segments of each source's ordered items.

    What splits depends on where the segment began. Where no source is long, each is one fold. Otherwise sources are dealt by ranges of (key, order),
    so one of any length spans many tasks. Each task follows its first source from every item at which a segment that came in can have ended, which is
    within the characters of one segment, to the state at its end; ways soon meet. A walk over partitions, a small row each, links these
    states, and each task then numbers its items from the state it gets. Only times, text lengths and marker flags go to Python.
    """
    lows = [m.lower() for m in TOPIC_MARKERS]
    marker = F.exists(F.array(*[F.lit(m) for m in lows]), lambda m: F.contains(F.lower("text"), m))
    slim = items.select(key, *dict.fromkeys([*order, "start_s", "end_s"]), F.length("text").alias("_len"), marker.alias("_marker"))
    rule = _Rule(shortest, longest, chars, gap)
    fields = ", ".join(f"`{c}` {items.schema[c].dataType.simpleString()}" for c in (key, *order)) + ", segment long"
    numbers = (_one_fold if fits_one_task(slim, key) else _linked_folds)(slim, key, order, rule, fields)
    same = [items[c].eqNullSafe(numbers[c]) for c in (key, *order)]
    return items.join(numbers, same).drop(*(numbers[c] for c in (key, *order)))


def _one_fold(slim: DataFrame, key: str, order: list[str], rule: _Rule, fields: str) -> DataFrame:
    """(key, order, segment): each source by a fold of its own."""

    def step(held, *columns):
        *places, starts, ends, sizes, marked = columns  # a place that is also a time comes twice
        out = []
        for item in zip(starts, ends, sizes, marked):
            held[0] = rule.take(held[0], item)
            out.append(held[0][0])
        return (*places, out)

    return fold_rows(slim, key, [(F.col(c), False) for c in order], [*order, "start_s", "end_s", "_len", "_marker"], lambda: [None], step, fields)


def _linked_folds(slim: DataFrame, key: str, order: list[str], rule: _Rule, fields: str) -> DataFrame:
    """(key, order, segment): sources over many tasks, whose states a walk over partitions links."""
    import pyarrow as pa

    dealt = materialise(dealt_by_range(slim, key, order))
    kind = slim.schema[key].dataType.simpleString()
    state_type = pa.struct([("segment", pa.int64()), ("begin", pa.float64()), ("size", pa.int64()), ("before", pa.float64())])
    item_type = pa.struct([("start", pa.float64()), ("end", pa.float64()), ("n", pa.int64()), ("marked", pa.bool_())])
    as_rows = lambda values, t: [dict(zip([f.name for f in t], v)) for v in values]

    def read(batch):
        return batch["_part"][0].as_py(), batch[key].to_pylist(), list(zip(*(batch[c].to_pylist() for c in ("start_s", "end_s", "_len", "_marker"))))

    def look(batches):
        part, keys, rows = None, [], []
        key_type = pa.null()
        for batch in batches:
            if batch.num_rows:
                part, more, items_ = read(batch)
                keys, rows, key_type = keys + more, rows + items_, batch[key].type
        if not keys:
            return
        first = next((i for i, k in enumerate(keys) if k != keys[0]), len(keys))
        last = next((i + 1 for i in range(len(keys) - 1, -1, -1) if keys[i] != keys[-1]), 0)
        own = rows[:first]
        head = rule.head(own)
        state = None
        for item in rows[last:]:
            state = rule.take(state, item)
        columns = [([part], pa.int32()), ([keys[0]], key_type), ([keys[-1]], key_type), ([as_rows(own[:head], item_type)], pa.list_(item_type)), ([as_rows(rule.exits(own, head), state_type)], pa.list_(state_type)), (as_rows([state], state_type), state_type), ([first == len(keys)], pa.bool_())]
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in columns], names=["_part", "first", "last", "head", "exits", "state", "alone"])

    state = "struct<segment:long,begin:double,size:long,before:double>"
    heads = dealt.mapInArrow(look, f"_part int, first {kind}, last {kind}, head array<struct<start:double,end:double,n:long,marked:boolean>>, exits array<{state}>, state {state}, alone boolean")
    held = slim.sparkSession.sparkContext.broadcast(_incoming(heads.orderBy("_part").toLocalIterator(), rule))

    def number(batches):
        state, before = None, None
        begun = False
        for batch in batches:
            if not batch.num_rows:
                continue
            part, keys, rows = read(batch)
            out = []
            for k, item in zip(keys, rows):
                if not begun:
                    state, begun = held.value.get(part), True
                elif k != before:
                    state = None
                state, before = rule.take(state, item), k
                out.append(state[0])
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in (key, *order)), pa.array(out, pa.int64())], names=[key, *order, "segment"])

    return dealt.mapInArrow(number, fields)


def _segments(rows: DataFrame, key: str, order: list[str], cut: int | None) -> DataFrame:
    parts = F.array_sort(F.collect_list(F.struct(*order, F.trim("text").alias("_t"))))
    text = F.array_join(F.transform(parts, lambda x: x["_t"]), " ")
    more = [F.min_by("speaker", F.struct(*order)).alias("speaker")] if "speaker" in rows.columns else []
    more += [F.avg("asr_confidence").alias("asr_confidence")] if "asr_confidence" in rows.columns else []
    out = rows.groupBy(key, "segment").agg(F.min("start_s").alias("start_s"), F.max("end_s").alias("end_s"), F.count("*").alias("n_items"), text.alias("text"), *more)
    if cut:
        words = keywords(out, [key, "segment"], "text")
        out = out.withColumn("entities", entities("text")).join(words, [key, "segment"], "left")
        none = F.array().cast("array<string>")
        out = out.withColumn("keywords", F.coalesce("keywords", none)).withColumn("text", F.substring("text", 1, cut))
    return out.withColumn("segment_id", F.format_string("seg_%04d", "segment"))


def segment_transcript(items: DataFrame, key: str = "video_id", order: str = "item_ord", shortest: float = 60.0, longest: float = 120.0) -> DataFrame:
    """(key, segment, segment_id, start_s, end_s, n_items, text, keywords, entities[, speaker, asr_confidence]): items in their
    own order, their texts mended first, split before an item that makes the segment too long in seconds or characters, or that
    opens a topic once it is long enough. Blank items go. The speaker is the first item's, the confidence the mean of
    those known; keywords and entities are of the whole text, which is then cut to MAX_CHARS."""
    rows = items.withColumn("text", normalize_asr(F.col("text"))).where("text <> ''")
    return _segments(_fold(rows, key, [order], shortest, longest, MAX_CHARS, None), key, [order], MAX_CHARS)


def merge_segments(items: DataFrame, key: str = "video_id", order: str = "item_ord", shortest: float = 60.0, longest: float = 120.0, chars: int = MERGE_CHARS, gap: float = 4.0) -> DataFrame:
    """As segment_transcript without keywords and entities, in time order, and split at silences of more than ``gap`` seconds too."""
    return _segments(_fold(items, key, ["start_s", order], shortest, longest, chars, gap), key, ["start_s", order], None)


def silence_sessions(items: DataFrame, key: str, start: str, end: str, gap) -> DataFrame:
    """(key, session, start, end, n): runs of items no more than ``gap`` apart, by windows alone."""
    w = Window.partitionBy(key).orderBy(start, end)
    new = F.when(F.col(start) - F.lag(end).over(w) > gap, 1).otherwise(0)
    rows = items.withColumn("_new", new).withColumn("session", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(key, "session").agg(F.min(start).alias(start), F.max(end).alias(end), F.count("*").alias("n"))


def align_frames(segments: DataFrame, frames: DataFrame, key: str = "video_id", width: float = 60.0) -> DataFrame:
    """(key, segment, frame_id, ts_s, selected): frames inside each closed segment; a frame on an edge belongs to both sides."""
    return point_join(frames.select(key, "frame_id", "ts_s", "selected"), segments.select(key, "segment", "start_s", "end_s"), "ts_s", ("start_s", "end_s"), [key], width)


def representative_frames(aligned: DataFrame, key: str = "video_id") -> DataFrame:
    """(key, segment, frames): the first three selected frames in time order, else the one nearest the middle."""
    middle = (F.col("start_s") + F.col("end_s")) / 2
    rows = aligned.groupBy(key, "segment").agg(
        F.slice(F.transform(F.array_sort(F.collect_list(F.when(F.col("selected"), F.struct("ts_s", "frame_id")))), lambda x: x["frame_id"]), 1, 3).alias("chosen"),
        F.min_by("frame_id", F.struct(F.abs(F.col("ts_s") - middle), "ts_s", "frame_id")).alias("near"),
    )
    return rows.select(key, "segment", F.when(F.size("chosen") > 0, F.col("chosen")).otherwise(F.array("near")).alias("frames"))


def refined_text(segments: DataFrame, ranges: DataFrame, key: str = "video_id") -> DataFrame:
    """(key, range_id, start_s, end_s, text): the union of segments that a range overlaps; ranges that none overlaps go."""
    from tessera.operators.intervals import interval_join

    met = interval_join(ranges.select(key, "range_id", F.col("start_s").alias("r0"), F.col("end_s").alias("r1")), segments, ("r0", "r1"), ("start_s", "end_s"), [key], 60.0)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start_s", "segment", "text"))), lambda x: x["text"]), " ")
    return met.groupBy(key, "range_id").agg(F.min("start_s").alias("start_s"), F.max("end_s").alias("end_s"), text.alias("text"))


def evidence_types(text: Column, has_frames: Column, caption: Column) -> Column:
    options = F.array(F.when(F.trim(text) != "", "speech"), F.when(has_frames, "frame"), F.when(F.trim(caption) != "", "frame_caption"))
    return F.filter(options, lambda x: x.isNotNull())
