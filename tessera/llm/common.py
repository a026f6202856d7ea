"""Pieces that the corpus operators share: tables, shared storage, word splitting, prefix sums."""

from __future__ import annotations

import re
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.storage import spread

#: Rows in an Arrow batch: long documents stay a few MB a batch.
BATCH_ROWS = 512

#: Translation of UTF-8 bytes for ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` words: A-Z to a-z, other non-word ASCII to a space.
WORD_TABLE = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prepare(spark: SparkSession) -> None:
    """Keep Arrow batches small whatever the length of the texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a local session may do without: it has a folder of its warehouse."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(found)
    return found


def new_folder(spark: SparkSession, kind: str) -> str:
    return f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}"


def remove_folder(spark: SparkSession, folder: str) -> None:
    """Delete a folder of the shared storage that nothing reads any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def cut(df: DataFrame) -> DataFrame:
    """Materialise into the shared folder and cut the lineage, so that a lost executor costs a read, not a rerun."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def as_bytes(text: str | None) -> bytes:
    return b"" if text is None else text.encode("utf-8", "surrogatepass")


def ascii_words(text: str | None) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after A-Z are lower-cased, as UTF-8 bytes; null has none."""
    return as_bytes(text).translate(WORD_TABLE).split()


def blank_words(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` after A-Z are lower-cased, as UTF-8 bytes; null has none."""
    return as_bytes(text).lower().split()


def word_count(text: Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` in a text; null counts 0. A JVM expression without an object for each word."""
    marks = F.regexp_replace(text, r"[^\x20\x09-\x0D]+", "x")
    return F.coalesce(F.length(F.translate(marks, " \t\n\x0b\x0c\r", "")), F.lit(0)).cast("long")


def crc32_of(column: str) -> Column:
    return F.crc32(F.col(column).cast("string").cast("binary"))


def drawn(column: str, seed: int, share: Column | float) -> Column:
    """Whether a row belongs to a share of all, by a 53-bit hash of a column: the same rows in every run, at any number of rows."""
    h = F.shiftrightunsigned(F.xxhash64(column, F.lit(seed)), 11).cast("double") / F.lit(float(1 << 53))
    return h < (share if isinstance(share, Column) else F.lit(float(share)))


def tidy() -> None:
    """Give freed memory back to the system: idle workers stay, and their executor's other tasks need the room."""
    import ctypes
    import gc

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library


def map_texts(df: DataFrame, schema: str, make, columns: list[str]) -> DataFrame:
    """mapInArrow with ``make() -> fn``: fn gets lists of the columns, gives arrays or lists in the schema's order."""
    from pyspark.sql.types import StructType
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        fn = make()
        for batch in batches:
            if batch.num_rows:
                out = fn(*(batch.column(i).to_pylist() for i in range(batch.num_columns)))
                yield pa.RecordBatch.from_arrays(
                    [x if isinstance(x, pa.Array) else pa.array(x, f.type) for x, f in zip(out, arrow)],
                    schema=arrow,
                )
                del out
        del fn
        tidy()

    return spread(df.select(*columns)).mapInArrow(run, schema)


def text_column(make, returns: str):
    """A column function of texts: ``make() -> fn`` once a task, fn gets a batch's texts, gives a list of values."""
    from collections.abc import Iterator

    import pandas as pd

    def run(batches):
        fn = make()
        for texts in batches:
            yield pd.Series(fn([None if t is None or t != t else t for t in texts]), dtype=bool if returns == "boolean" else object)
        del fn
        tidy()

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, returns)


#: Buckets whose sums are accumulated together, before the sums of these groups are.
FANOUT = 64


def running_before(df: DataFrame, group: list[str], bucket: str, order: list, value: Column, name: str) -> DataFrame:
    """Sum of ``value`` over the rows before each row of its group, in the order of (bucket, order); buckets are numbers.

    Three levels: the sums of every FANOUT buckets together, of the buckets among these, and of the rows inside their
    bucket, so that a group of any size is dealt over as many tasks as it has buckets, and a window over all of a
    group holds a FANOUT-th of its buckets.
    """
    rows = df.withColumn("_v", value)
    sums = rows.groupBy(*group, bucket).agg(F.sum("_v").alias("_s")).withColumn("_g", F.floor(F.col(bucket) / FANOUT))
    before = Window.rowsBetween(Window.unboundedPreceding, -1)
    tops = sums.groupBy(*group, "_g").agg(F.sum("_s").alias("_t"))
    tops = tops.select(*group, "_g", F.coalesce(F.sum("_t").over(before.partitionBy(*group).orderBy("_g")), F.lit(0)).alias("_top"))
    mid = F.coalesce(F.sum("_s").over(before.partitionBy(*group, "_g").orderBy(bucket)), F.lit(0))
    base = sums.withColumn("_mid", mid).join(tops, [*group, "_g"]).select(*group, bucket, (F.col("_top") + F.col("_mid")).alias("_base"))
    near = rows.withColumn("_near", F.coalesce(F.sum("_v").over(before.partitionBy(*group, bucket).orderBy(*order)), F.lit(0)))
    return near.join(base, [*group, bucket]).withColumn(name, F.col("_base") + F.col("_near")).drop("_v", "_near", "_base")


def numbered(df: DataFrame, group: list[str], order: list[str], name: str) -> DataFrame:
    """Number of each row in its group, from 0, by ``order``; equal rows are numbered in some order. The result is written.

    Rows are dealt by ranges of (group, order) and a number of their own, so that a group, or a row that repeats, of any
    size is dealt over many tasks. Each task counts through its sorted rows; the rows that a partition's first group has in
    earlier ones are added from a table of one row a partition, whose size the number of partitions bounds.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    keys = [*group, *order, "_tie"]
    rows = cut(df.withColumn("_tie", F.monotonically_increasing_id()))
    dealt = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_part", F.spark_partition_id())
    schema = dealt.withColumns({"_near": F.lit(0).cast("long"), "_pos": F.lit(0).cast("long"), "_opens": F.lit(True)}).schema
    arrow = to_arrow_schema(schema)

    def run(batches):
        pos, start, opened, before = 0, 0, True, None
        for batch in batches:
            if not batch.num_rows:
                continue
            n, own = batch.num_rows, [batch.column(c) for c in group]
            if before is None:
                before = [c.slice(0, 1) for c in own]
            new = np.zeros(n, bool)
            for c, b in zip(own, before):
                new |= _differs(pa.concat_arrays([b, c.slice(0, n - 1)]), c)
            before = [c.slice(n - 1, 1) for c in own]
            at = pos + np.arange(n)
            starts = np.maximum.accumulate(np.where(new, at, start))
            opens = opened & ~np.maximum.accumulate(new)
            extra = [pa.array(at - starts), pa.array(at), pa.array(opens)]
            yield pa.RecordBatch.from_arrays([*(x.cast(f.type) for x, f in zip(batch.columns, arrow)), *extra], schema=arrow)
            pos, start, opened = pos + n, int(starts[-1]), bool(opens[-1])

    found = cut(dealt.mapInArrow(run, schema))
    last = F.max_by(F.struct(*group), "_pos").alias("last")
    parts = found.groupBy("_part").agg(F.min_by(F.struct(*group), "_pos").alias("first"), last, (F.max_by("_near", "_pos") + 1).alias("n"))
    so_far = F.sum("n").over(Window.partitionBy("last").orderBy("_part"))
    parts = parts.withColumn("so_far", so_far)
    by_part = Window.orderBy("_part")
    goes_on = F.lag("last").over(by_part).eqNullSafe(F.col("first"))
    parts = parts.select("_part", F.when(goes_on, F.lag("so_far").over(by_part)).otherwise(F.lit(0)).alias("_base"))
    base = F.when(F.col("_opens"), F.col("_base")).otherwise(F.lit(0))
    return found.join(F.broadcast(parts), "_part").withColumn(name, F.col("_near") + base).drop("_tie", "_part", "_near", "_pos", "_opens", "_base")


def _differs(a: pa.Array, b: pa.Array) -> np.ndarray:
    """Where values differ; null differs from all but null."""
    differ = pc.fill_null(pc.not_equal(a, b), False).to_numpy(zero_copy_only=False)
    return differ | (pc.is_null(a).to_numpy(zero_copy_only=False) != pc.is_null(b).to_numpy(zero_copy_only=False))
