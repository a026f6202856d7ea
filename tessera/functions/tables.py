"""Table functions for SQL: segmentation and top-k over partitions of a table."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn, SkipRestOfInputTableException
from pyspark.sql.types import DoubleType, LongType, StringType, StructType


class SegmentItems:
    """Segments of a source's items: ``ev_segment(TABLE(items), key => 'video_id', ord => 'item_ord')``.

    The table has (start_s, end_s, text) besides the columns named by ``key`` and ``ord``, by which it is partitioned and ordered; texts are taken as they are, blank ones
    left out. A segment is put out when it ends: (key, segment, start_s, end_s, n_items, text). Segments are those of ``segment_transcript``; a task holds
    the open one only.
    """

    @staticmethod
    def analyze(items: AnalyzeArgument, key: AnalyzeArgument, ord: AnalyzeArgument) -> AnalyzeResult:  # noqa: A002
        fields = {f.name: f.dataType for f in items.dataType.fields}
        for name in (key.value, ord.value, "start_s", "end_s", "text"):
            if name not in fields:
                raise ValueError(f"ev_segment needs a column {name}")
        schema = StructType().add(key.value, fields[key.value]).add("segment", LongType()).add("start_s", DoubleType()).add("end_s", DoubleType()).add("n_items", LongType()).add("text", StringType())
        return AnalyzeResult(schema=schema, partitionBy=[PartitioningColumn(key.value)], orderBy=[OrderingColumn(ord.value)])

    def __init__(self):
        self.state = self.open = None

    def eval(self, items, key: str, ord: str):  # noqa: A002
        from tessera.functions.text import TOPIC_MARKERS
        from tessera.operators.segment import MAX_CHARS, _Rule

        text = items["text"]
        if text is None or not text.strip():
            return
        rule = _Rule(60.0, 120.0, MAX_CHARS, None)
        item = (items["start_s"], items["end_s"], len(text), any(m.lower() in text.lower() for m in TOPIC_MARKERS))
        before, self.state = self.state, rule.take(self.state, item)
        if before is None or before[0] != self.state[0]:
            if self.open:
                yield self._row()
            self.open = [items[key], self.state[0], item[0], item[1], 0, []]
        self.open[2], self.open[3] = min(self.open[2], item[0]), max(self.open[3], item[1])
        self.open[4] += 1
        self.open[5].append(text.strip())

    def terminate(self):
        if self.open:
            yield self._row()

    def _row(self):
        from tessera.operators.segment import MAX_CHARS

        *rest, texts = self.open
        return (*rest, " ".join(texts)[:MAX_CHARS])


class TopRows:
    """The first k rows of each partition: ``ev_top(TABLE(t) PARTITION BY a ORDER BY (b DESC, c), k => 5)``, with their (1-based) rank.

    The rest of a partition is skipped once it has k.
    """

    @staticmethod
    def analyze(rows: AnalyzeArgument, k: AnalyzeArgument) -> AnalyzeResult:
        schema = StructType(list(rows.dataType.fields)).add("rank", LongType())
        return AnalyzeResult(schema=schema)

    def __init__(self):
        self.n = 0

    def eval(self, rows, k: int):
        if self.n >= k:
            raise SkipRestOfInputTableException
        self.n += 1
        yield (*rows, self.n)

    def terminate(self):
        return
        yield


def register(spark: SparkSession) -> list[str]:
    """Make the table functions known to the session's SQL."""
    from pyspark.sql.functions import udtf

    for name, made in (("ev_segment", SegmentItems), ("ev_top", TopRows)):
        spark.udtf.register(name, udtf(made))
    return ["ev_segment", "ev_top"]
