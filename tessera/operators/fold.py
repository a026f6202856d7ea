"""Ordered folds over groups of any size."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.storage import materialise


def fold_rows(rows: DataFrame, key: str, order: list[tuple[Column, bool]], columns: list[str], start: Callable, step: Callable, schema: str, finish: Callable | None = None) -> DataFrame:
    """Rows that an ordered fold of each key gives, in ``schema``, whose first column is the key.

    Rows are dealt by key, sorted by (expression, descending) and folded an Arrow batch at a time: ``step(state, *slices of
    the columns)`` changes the open key's state and gives columns of rows to put out, or None; ``finish(state)`` gives
    more of them when the key ends. Only the open key's state is held, whatever the key's size.
    """
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        out: list[list] = [[] for _ in arrow]
        state = open_key = None
        any_row = False

        def put(k, found):
            if found is not None:
                out[0].extend([k] * len(found[0]))
                for column, values in zip(out[1:], found):
                    column.extend(values)

        def flush():
            batch = pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(out, arrow)], schema=arrow)
            for x in out:
                x.clear()
            return batch

        for batch in batches:
            keys = batch.column(0).to_pylist()
            values = [batch.column(i + 1).to_pylist() for i in range(len(columns))]
            at = 0
            while at < len(keys):
                end = at + 1
                while end < len(keys) and keys[end] == keys[at]:
                    end += 1
                if not any_row or keys[at] != open_key:
                    if any_row and finish:
                        put(open_key, finish(state))
                    open_key, state, any_row = keys[at], start(), True
                put(open_key, step(state, *[v[at:end] for v in values]))
                at = end
            if out[0]:
                yield flush()
        if any_row and finish:
            put(open_key, finish(state))
        if out[0]:
            yield flush()

    sides = [f"_o{i}" for i in range(len(order))]
    dealt = rows.select(key, *columns, *[c.alias(s) for (c, _), s in zip(order, sides)]).repartition(key)
    ordered = dealt.sortWithinPartitions(key, *[F.desc(s) if down else F.asc(s) for (_, down), s in zip(order, sides)])
    return ordered.select(key, *columns).mapInArrow(run, schema)


#: Rows of the longest key up to which one task folds each key: fewer jobs than dealing a key over several.
FOLD_ROWS = 200_000


def fits_one_task(rows: DataFrame, key: str) -> bool:
    """Whether no key has more than FOLD_ROWS rows, by a partial count."""
    return (rows.groupBy(key).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0) <= FOLD_ROWS


def dealt_by_range(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Rows with ``_part``, sorted by (key, order) within and over partitions: a key of any size spans many of them."""
    keys = [key, *order, "_tie"]
    tied = rows.withColumn("_tie", F.monotonically_increasing_id())
    return tied.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_part", F.spark_partition_id())


def split_at_resets(rows: DataFrame, key: str, order: list[str], start: str, end: str, gap: float) -> DataFrame:
    """Rows with ``_run``: a number that changes with the key, and where a row starts more than ``gap`` after the one before it ends.

    Where a fold's state is empty after such a gap, its runs can be folded in parallel, however long a key is. Each
    task counts the gaps of its sorted rows; whether its first rows go on with the run before is decided on a table of one row a partition.
    """
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema

    dealt = dealt_by_range(rows, key, order)
    schema = dealt.withColumns({"_no": F.lit(0).cast("long"), "_pos": F.lit(0).cast("long")}).schema
    arrow = to_arrow_schema(schema)

    def run(batches):
        no = pos = 0
        before = None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys, starts, ends = (batch.column(c).to_pylist() for c in (key, start, end))
            out = []
            for k, s, e in zip(keys, starts, ends):
                if before is not None and (k != before[0] or s - before[1] > gap):
                    no += 1
                before = k, e
                out.append(no)
            extra = [pa.array(out, pa.int64()), pa.array(np.arange(pos, pos + len(out)))]
            yield pa.RecordBatch.from_arrays([*(x.cast(f.type) for x, f in zip(batch.columns, arrow)), *extra], schema=arrow)
            pos += len(out)

    counted = materialise(dealt.mapInArrow(run, schema))
    first, last = F.struct(F.col(key).alias("k"), F.col(start).alias("s")), F.struct(F.col(key).alias("k"), F.col(end).alias("e"))
    parts = counted.groupBy("_part").agg(F.min_by(first, "_pos").alias("first"), F.max_by(last, "_pos").alias("last"), F.max("_no").alias("n"))
    w = Window.orderBy("_part")
    goes_on = F.lag("last.k").over(w).eqNullSafe(F.col("first.k")) & (F.col("first.s") - F.lag("last.e").over(w) <= gap)
    parts = parts.withColumn("on", F.coalesce(goes_on, F.lit(False)))
    run_of = lambda part, no: part.cast("long") * (1 << 32) + no
    ends = F.when(~F.col("on") | (F.col("n") > 0), run_of(F.col("_part"), F.col("n")))  # the run that is open at a partition's end, if it began here
    parts = parts.withColumn("open", F.last(ends, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    parts = parts.select("_part", "on", "open")
    joined = counted.join(F.broadcast(parts), "_part")
    number = F.when(F.col("on") & (F.col("_no") == 0), F.col("open")).otherwise(run_of(F.col("_part"), F.col("_no")))
    return joined.withColumn("_run", number).drop("_part", "_no", "_pos", "_tie", "on", "open")
