"""Intermediate results that several steps read, and folders for them."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Bytes, as the plan estimates them, up to which an input in few partitions is dealt over the cores.
SPREAD_BYTES = 1 << 30


def shared_folder(spark: SparkSession) -> str | None:
    """The folder that spark.checkpoint.dir names, which driver and executors share; only a local session may do without one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return found


def new_folder(spark: SparkSession, kind: str) -> str:
    """A folder of its own in the shared one, in a local session without one in the warehouse."""
    base = shared_folder(spark) or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"
    return f"{base}/{kind}-{uuid.uuid4().hex}"


def materialise(df: DataFrame) -> DataFrame:
    """Compute once what is read more than once, in the shared folder, so that a lost executor costs a read; a local session without
    one keeps it in Spark's own storage."""
    context = df.sparkSession.sparkContext
    folder = shared_folder(df.sparkSession)
    if folder and context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return df.checkpoint(eager=True) if context.getCheckpointDir() else df.persist()


def spread(df: DataFrame) -> DataFrame:
    """A small input dealt over all cores before a step that costs more than a shuffle of it.

    Only files of at most SPREAD_BYTES that come in fewer partitions than there are cores are dealt; larger inputs, and what
    has been shuffled already, stay as they are, on any number of cores.
    """
    execution = df._jdf.queryExecution()
    plan = execution.executedPlan()
    if plan.nodeName().startswith("AdaptiveSparkPlan") or int(execution.optimizedPlan().stats().sizeInBytes()) > SPREAD_BYTES:
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if plan.execute().getNumPartitions() < cores else df


#: Rows and bytes that Python takes apart at once, whatever a batch holds.
SLICE_ROWS, SLICE_BYTES = 256, 1 << 22


def slices(batches, rows: int = SLICE_ROWS, size: int = SLICE_BYTES):
    """Arrow batches in slices of few rows and bytes (one row at least), so that the Python objects of a step do not grow with its batches."""
    for batch in batches:
        step = max(1, min(rows, size * max(1, batch.num_rows) // max(1, batch.nbytes)))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)
