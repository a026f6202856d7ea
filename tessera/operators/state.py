"""Stage logs, resume decisions, task progress and histories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def stage_state(events: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """(key, status, n_events, n_failures): the latest status of each stage; a partial aggregate, no sort."""
    return events.groupBy(*key).agg(F.max_by("status", F.struct(*order)).alias("status"), F.count("*").alias("n_events"), F.count_if(F.col("status") == "failed_retryable").alias("n_failures"))


def stage_timings(events: DataFrame, key: list[str], order: list[str], at: str) -> DataFrame:
    """(key, event, seconds) from each event to the next of its stage."""
    w = Window.partitionBy(*key).orderBy(*order)
    return events.withColumn("seconds", (F.lead(at).over(w) - F.col(at)) / 1e6).where("seconds IS NOT NULL")


def resume(stages: DataFrame, fingerprints: DataFrame, key: list[str]) -> DataFrame:
    """(key, action): skip what succeeded on the same fingerprint, else run."""
    rows = stages.join(fingerprints, key, "left")
    same = F.coalesce(F.col("status").isin("succeeded", "degraded") & (F.col("fingerprint") == F.col("current")), F.lit(False))
    return rows.select(*key, F.when(same, "skip").otherwise("run").alias("action"))


def request_timeout(duration_s: Column) -> Column:
    return F.when(duration_s <= 1200, 180).when(duration_s <= 2400, 240).otherwise(360)


def progress(events: DataFrame, key: str, order: list[str], value: str, most: int = 200) -> DataFrame:
    """(key, n, last): a task's latest progress entries in order."""
    w = Window.partitionBy(key).orderBy(*[F.desc(c) for c in order])
    rows = events.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= most)
    return rows.groupBy(key).agg(F.count("*").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, value))), lambda x: x[value]), ",").alias("last"))


def history(turns: DataFrame, key: str, order: str, most: int = 6) -> DataFrame:
    """A conversation's last turns, in order."""
    w = Window.partitionBy(key).orderBy(F.desc(order))
    return turns.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= most).drop("_rn")


def latest_completed(states: DataFrame, key: str, at: str) -> DataFrame:
    return states.where("status = 'succeeded'").groupBy(key).agg(F.max(at).alias(at))


#: Restarts of a stage, seconds of a rate limit's cooldown, and tasks that may wait or run at once.
RESTARTS, COOLDOWN_S, PENDING = 2, 30.0, 16


def restarts(failures: DataFrame, key: list[str], order: list[str], rate_limited: Column, limit: int = RESTARTS, cooldown: float = COOLDOWN_S) -> DataFrame:
    """Failures of a stage in order with (attempt, wait_s, exhausted): how long its next attempt waits, longer at each and at
    least the cooldown after a rate limit; none after ``limit`` restarts."""
    at = F.row_number().over(Window.partitionBy(*key).orderBy(*order)).cast("long")
    rows = failures.withColumn("attempt", at).where(F.col("attempt") <= limit + 1)
    wait = F.when(rate_limited, F.greatest(F.lit(float(cooldown)), 1.5 * F.col("attempt"))).otherwise(F.least(F.lit(5.0), 1.5 * F.col("attempt")))
    return rows.withColumn("exhausted", F.col("attempt") > limit).withColumn("wait_s", F.when(~F.col("exhausted"), wait))


def run_with_restarts(job, record, limit: int = RESTARTS, cooldown: float = COOLDOWN_S, is_rate_limit=lambda e: "429" in str(e), sleep=None):
    """The job's result; failed attempts are recorded and tried again, ``limit`` times at most."""
    import time

    sleep = sleep or time.sleep
    for attempt in range(1, max(0, limit) + 2):
        try:
            return job()
        except Exception as e:  # noqa: BLE001  whatever failed is recorded
            record(attempt, e)
            if attempt > limit:
                raise RuntimeError(f"gave up after {limit} restarts: {str(e).splitlines()[0] if str(e) else type(e).__name__}") from e
            sleep(max(cooldown, 1.5 * attempt) if is_rate_limit(e) else min(5.0, 1.5 * attempt))


def admitted(tasks: DataFrame, key: str, limit: int = PENDING) -> DataFrame:
    """(key, task_id, admitted): tasks are taken while fewer than ``limit`` admitted ones have not finished.

    tasks: (key, task_id, submitted, finished). A refused task takes no place, so a key's tasks are folded in order of submission.
    """
    import heapq

    from tessera.operators.fold import fold_rows

    def step(open_, ids, submitted, finished):
        out = []
        for start, end in zip(submitted, finished):
            while open_ and open_[0] <= start:
                heapq.heappop(open_)
            ok = len(open_) < limit
            if ok:
                heapq.heappush(open_, end)
            out.append(ok)
        return ids, out

    kinds = dict(tasks.dtypes)
    return fold_rows(tasks, key, [(F.col("submitted"), False), (F.col("task_id"), False)], ["task_id", "submitted", "finished"], list, step, f"{key} {kinds[key]}, task_id {kinds['task_id']}, admitted boolean")


def lock_holders(claims: DataFrame, key: str, owner: str, order: list[str]) -> DataFrame:
    """(key, owner): who holds each source's lock: the first of its claims that has not been released."""
    return claims.where(~F.col("released")).groupBy(key).agg(F.min_by(owner, F.struct(*order)).alias(owner))
