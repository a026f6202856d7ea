"""Interval operators: binned interval joins, nearest matches, range merging, coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def bins(low: Column, high: Column, width) -> Column:
    return F.sequence(F.floor(low / width).cast("long"), F.floor(high / width).cast("long"))


def interval_join(left: DataFrame, right: DataFrame, l: tuple[str, str], r: tuple[str, str], on: list[str], width, slack=0) -> DataFrame:
    """Pairs of one key whose closed intervals meet, ``slack`` apart at most.

    Both sides are dealt to bins of ``width``, an equi-join meets them, and a pair is kept in the one bin where the later
    of the two starts, so none comes twice. Skewed bins are split by AQE; a width near the median length is best.
    """
    a = left.withColumn("_l0", F.col(l[0]) - slack).withColumn("_l1", F.col(l[1]) + slack).withColumn("_bin", F.explode(bins(F.col("_l0"), F.col("_l1"), width)))
    b = right.withColumn("_r0", F.col(r[0])).withColumn("_r1", F.col(r[1])).withColumn("_bin", F.explode(bins(F.col("_r0"), F.col("_r1"), width)))
    met = a.join(b, [*on, "_bin"]).where("_l0 <= _r1 AND _r0 <= _l1")
    first = F.floor(F.greatest(F.col("_l0"), F.col("_r0")) / width)
    return met.where(F.col("_bin") == first).drop("_bin", "_l0", "_l1", "_r0", "_r1")


def point_join(points: DataFrame, intervals: DataFrame, at: str, r: tuple[str, str], on: list[str], width, slack=0) -> DataFrame:
    """Pairs of one key with the point inside the closed interval, ``slack`` from it at most; a point has one bin."""
    a = points.withColumn("_bin", F.floor(F.col(at) / width).cast("long"))
    b = intervals.withColumn("_bin", F.explode(bins(F.col(r[0]) - slack, F.col(r[1]) + slack, width)))
    return a.join(b, [*on, "_bin"]).where((F.col(at) >= F.col(r[0]) - slack) & (F.col(at) <= F.col(r[1]) + slack)).drop("_bin")


def nearest_interval(points: DataFrame, intervals: DataFrame, at: str, r: tuple[str, str], on: list[str], item: str) -> DataFrame:
    """Each point with the first interval that holds it, else the one whose edge is nearest; ties to the earlier.

    One pass in time order: the latest start and end before a point and the next after it are the only candidates
    outside, and containing intervals come from the binned join, so no point meets every interval of its key.
    """
    inside = point_join(points, intervals.select(*on, item, *r), at, r, on, 60.0)
    held = inside.groupBy(*on, at).agg(F.min_by(item, F.struct(r[0], item)).alias("_in"))
    edges = intervals.select(*on, F.explode(F.array(F.struct(F.col(r[0]).alias("e"), F.col(r[0]).alias("s"), F.col(item).alias("i")), F.struct(F.col(r[1]).alias("e"), F.col(r[0]).alias("s"), F.col(item).alias("i")))).alias("x")).select(*on, F.col("x.e").alias("_t"), F.struct("x.e", "x.s", "x.i").alias("_edge"), F.lit(None).cast("boolean").alias("_p"))
    dots = points.select(*on, F.col(at).cast("double").alias("_t")).distinct().select(*on, "_t", F.lit(None).cast("struct<e:double,s:double,i:" + dict(intervals.dtypes)[item] + ">").alias("_edge"), F.lit(True).alias("_p"))
    both = edges.select(*on, F.col("_t").cast("double").alias("_t"), F.struct(F.col("_edge.e").cast("double").alias("e"), F.col("_edge.s").cast("double").alias("s"), F.col("_edge.i").alias("i")).alias("_edge"), "_p").unionByName(dots)
    w = Window.partitionBy(*on)
    back = F.last("_edge", True).over(w.orderBy(F.col("_t"), F.col("_p").asc_nulls_first(), F.col("_edge.s").desc(), F.col("_edge.i").desc()).rowsBetween(Window.unboundedPreceding, 0))
    ahead = F.first("_edge", True).over(w.orderBy(F.col("_t"), F.col("_p").desc_nulls_last(), F.col("_edge.s"), F.col("_edge.i")).rowsBetween(0, Window.unboundedFollowing))
    near = both.withColumn("_b", back).withColumn("_a", ahead).where("_p")
    pick = F.when(F.col("_b").isNull(), F.col("_a.i")).when(F.col("_a").isNull(), F.col("_b.i")).when(F.struct(F.col("_t") - F.col("_b.e"), "_b.s", "_b.i") <= F.struct(F.col("_a.e") - F.col("_t"), "_a.s", "_a.i"), F.col("_b.i")).otherwise(F.col("_a.i"))
    found = near.select(*on, F.col("_t").alias(at), pick.alias("_near"))
    return points.join(found, [*on, at]).join(held, [*on, at], "left").withColumn(item, F.coalesce("_in", "_near")).drop("_in", "_near")


def merge_ranges(ranges: DataFrame, key: str, start: str, end: str, tolerance=2, reason: str | None = None, priority: str | None = None) -> DataFrame:
    """(key, start, end, n[, reasons, priority]): unions of a key's ranges that meet within the tolerance."""
    w = Window.partitionBy(key).orderBy(start, end)
    before = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    islands = ranges.withColumn("_new", F.when(F.col(start) > before + tolerance, 1).otherwise(0))
    islands = islands.withColumn("_island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    more = [F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(start, end, reason))), lambda x: x[reason]), ";").alias("reasons")] if reason else []
    more += [F.min(priority).alias("priority")] if priority else []
    return islands.groupBy(key, "_island").agg(F.min(start).alias(start), F.max(end).alias(end), F.count("*").alias("n"), *more).drop("_island")


def sanitize_ranges(ranges: DataFrame, key: str, duration: str, limit: int) -> DataFrame:
    """Ranges inside [0, duration], a second long at least, the first by priority."""
    clamp = lambda x: F.when(F.coalesce(F.col(duration), F.lit(0.0)) > 0, F.least(F.col(duration), x)).otherwise(x)
    rank = F.row_number().over(Window.partitionBy(key).orderBy("priority", "start_s", "end_s"))
    first = ranges.withColumn("_rn", rank).where(F.col("_rn") <= limit)
    rows = first.withColumn("start_s", F.greatest(F.lit(0.0), F.col("start_s"))).withColumn("end_s", clamp(F.greatest("start_s", "end_s")))
    return rows.withColumn("end_s", F.when(F.col("end_s") <= F.col("start_s"), clamp(F.col("start_s") + 1)).otherwise(F.col("end_s"))).drop("_rn")


def coverage_ranges(videos: DataFrame, key: str, duration: str, most: int = 3) -> DataFrame:
    """(key, part, start_s, end_s, reason): equal stretches of each source."""
    count = min(3, most)
    labels = F.array(*[F.lit(x) for x in ("early", "middle", "late")])
    parts = videos.where(F.col(duration) > 0).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(count - 1))))
    wide = F.col(duration) / count
    end = F.when(F.col("part") == count - 1, F.col(duration)).otherwise((F.col("part") + 1) * wide)
    return parts.select(key, F.col("part").cast("long").alias("part"), (F.col("part") * wide).alias("start_s"), end.alias("end_s"), F.concat(F.lit("coverage_fallback:"), F.element_at(labels, F.col("part") + 1)).alias("reason"))


def coverage_bins(observations: DataFrame, extents: DataFrame, key: str, at: str) -> DataFrame:
    """(key, covered): how many thirds of a source's extent, edges included on both sides, hold an observation."""
    rows = observations.join(extents, key).where("hi > lo")
    third = (F.col("hi") - F.col("lo")) / 3
    inside = [F.max(((F.col(at) >= F.col("lo") + i * third) & (F.col(at) <= (F.col("hi") if i == 2 else F.col("lo") + (i + 1) * third))).cast("long")) for i in range(3)]
    return extents.select(key).join(rows.groupBy(key).agg((inside[0] + inside[1] + inside[2]).alias("covered")), key, "left").withColumn("covered", F.coalesce("covered", F.lit(0)).cast("long"))
