"""Evaluation metrics over cases: set, rank, token and temporal scores, and their aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.storage import materialise

from tessera.functions.text import metric_tokens

#: Acceptance thresholds (fixed values).
THRESHOLDS = {"retrieval_hit_rate": 0.70, "segment_recall": 0.60, "grounding_precision": 0.80, "answer_contains_recall": 0.60}


def f1(precision: Column, recall: Column) -> Column:
    return F.when(precision + recall > 0, 2 * precision * recall / (precision + recall)).otherwise(0.0)


def prf1(cases: DataFrame, predicted: DataFrame, gold: DataFrame, key: str, item: str) -> DataFrame:
    """(key, precision, recall, f1) of each case's sets; both empty is 1, one empty is 0."""
    flags = predicted.select(key, item).distinct().withColumn("_p", F.lit(1)).join(gold.select(key, item).distinct().withColumn("_g", F.lit(1)), [key, item], "full")
    sums = flags.groupBy(key).agg(F.sum("_p").alias("p"), F.sum("_g").alias("g"), F.count(F.when(F.col("_p").isNotNull() & F.col("_g").isNotNull(), 1)).alias("o"))
    rows = cases.select(key).join(sums, key, "left").select(key, *[F.coalesce(c, F.lit(0)).alias(c) for c in ("p", "g", "o")])
    score = lambda n: F.when((F.col("p") == 0) & (F.col("g") == 0), 1.0).when((F.col("p") == 0) | (F.col("g") == 0), 0.0).otherwise(F.col("o") / F.col(n))
    rows = rows.withColumn("precision", score("p")).withColumn("recall", score("g"))
    return rows.select(key, "precision", "recall", f1(F.col("precision"), F.col("recall")).alias("f1"))


def reciprocal_rank(cases: DataFrame, ranked: DataFrame, gold: DataFrame, key: str, item: str) -> DataFrame:
    best = ranked.join(gold.select(key, item).distinct(), [key, item], "left_semi").groupBy(key).agg(F.min("rank").alias("r"))
    return cases.select(key).join(best, key, "left").select(key, F.coalesce(1 / F.col("r"), F.lit(0.0)).alias("reciprocal_rank"))


def temporal_iou(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Overlap over the hull of two ranges."""
    hull = F.greatest(a1, b1) - F.least(a0, b0)
    return F.when(hull > 0, F.greatest(F.lit(0.0), F.least(a1, b1) - F.greatest(a0, b0)) / hull).otherwise(0.0)


def mean_best_iou(predicted: DataFrame, gold: DataFrame, key: str) -> DataFrame:
    """(key, iou): over a case's gold ranges, the mean of the best overlap with a predicted one."""
    p = predicted.select(key, F.col("start_s").alias("p0"), F.col("end_s").alias("p1"))
    g = gold.select(key, "gold_id", F.col("start_s").alias("g0"), F.col("end_s").alias("g1"))
    best = g.join(p, key, "left").groupBy(key, "gold_id").agg(F.coalesce(F.max(temporal_iou(F.col("g0"), F.col("g1"), F.col("p0"), F.col("p1"))), F.lit(0.0)).alias("x"))
    return best.groupBy(key).agg(F.avg("x").alias("iou"))


def token_f1(pairs: DataFrame, key: str, a: str, b: str) -> DataFrame:
    """(key, f1) of the multisets of two texts' tokens."""
    def counts(text, n):
        return pairs.select(key, F.explode(metric_tokens(text)).alias("t")).groupBy(key, "t").agg(F.count("*").alias(n))

    both = counts(a, "x").join(counts(b, "y"), [key, "t"], "full").groupBy(key).agg(F.sum("x").alias("nx"), F.sum("y").alias("ny"), F.sum(F.least(F.coalesce("x", F.lit(0)), F.coalesce("y", F.lit(0)))).alias("o"))
    rows = pairs.select(key).join(both, key, "left")
    score = F.when(F.col("nx").isNull() & F.col("ny").isNull(), 1.0).when(F.col("nx").isNull() | F.col("ny").isNull(), 0.0).otherwise(f1(F.col("o") / F.col("nx"), F.col("o") / F.col("ny")))
    return rows.select(key, score.alias("f1"))


def contains_recall(text: Column, required: Column) -> Column:
    found = F.filter(required, lambda r: F.contains(F.lower(text), F.lower(r)))
    return F.when(F.size(required) > 0, F.size(found) / F.size(required)).otherwise(1.0)


def aggregate(scores: DataFrame, metrics: list[str], thresholds: dict[str, float] | None = None) -> DataFrame:
    """(metric, mean, n, threshold, ok): means over the cases that have the metric."""
    long = scores.select(F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("v")) for m in metrics])).alias("x")).select("x.metric", "x.v")
    limits = F.create_map(*[F.lit(x) for p in (thresholds or THRESHOLDS).items() for x in p])
    rows = long.groupBy("metric").agg(F.avg("v").alias("mean"), F.count("v").alias("n")).withColumn("threshold", limits[F.col("metric")])
    return rows.withColumn("ok", F.coalesce(F.col("mean") >= F.col("threshold"), F.col("threshold").isNull()))


def report(rows: DataFrame, by: list[str], correct: str, latency: str) -> DataFrame:
    return rows.groupBy(*by).agg(F.count("*").alias("n"), F.avg(F.col(correct).cast("double")).alias("accuracy"), F.avg(latency).alias("mean_latency"), F.percentile(latency, 0.5).alias("median_latency"))


def case_sample(cases: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """n cases by the lowest hashes of seed and id: the same ones whenever the ids are the same."""
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")), 256)
    return cases.withColumn("_h", h).orderBy("_h", key).limit(n).drop("_h")


def seeded_sample(cases: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """(key, place): what ``random.Random(seed).sample(sorted(keys), n)`` draws, in its order; all keys if there are no more than n.

    The generator draws places, n of them at most; keys are sorted over ranges, and a table of one count a partition says in which partition a
    place lies. Null keys are left out, keys that repeat count as often as they do.
    """
    import random

    import numpy as np
    import pyarrow as pa

    from tessera.operators.fold import dealt_by_range

    spark = cases.sparkSession
    dealt = materialise(dealt_by_range(cases.select(F.lit(0).alias("_all"), key).where(F.col(key).isNotNull()), "_all", [key]).select("_part", key))
    counts = {r["_part"]: r["count"] for r in dealt.groupBy("_part").count().collect()}
    total, bases = 0, {}
    for part in sorted(counts):
        bases[part] = total
        total += counts[part]
    drawn = random.Random(seed).sample(range(total), min(n, total))
    kind = cases.schema[key].dataType.simpleString()

    def place(batches):
        at: dict[int, int] = {}
        for batch in batches:
            if batch.num_rows:
                part = batch.column(0)[0].as_py()
                first = bases[part] + at.get(part, 0)
                at[part] = at.get(part, 0) + batch.num_rows
                yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(first + np.arange(batch.num_rows))], names=[key, "at"])

    numbers = dealt.mapInArrow(place, f"`{key}` {kind}, at long")
    wanted = spark.createDataFrame([(at, i) for i, at in enumerate(drawn)], "at long, place long")
    return numbers.join(F.broadcast(wanted), "at").select(key, "place")


def smoke(rows: DataFrame) -> DataFrame:
    """(total, passed): cases that the model itself routed as expected. rows: (source, expected, route)."""
    return rows.agg(F.count("*").alias("total"), F.count_if((F.col("source") == "llm") & (F.col("route") == F.col("expected"))).alias("passed"))
