"""Connected components of a link table by minimum labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import cut


def connected_components(links: DataFrame) -> DataFrame:
    """(u, v) links -> (node, component), component the smallest node reachable.

    Every round hooks each node, and the root it points to, to the smallest label next to it, then replaces each
    label by its label's label; chains halve in length with every round. Minima are partial aggregates, so a hub
    sends one row for each task; the joins are on keys that AQE can split. A round ends in a checkpoint.
    Links from a node to itself and repeated links are harmless; no links give no rows.
    """
    pairs = links.select("u", "v").where("u <> v")
    both = cut(pairs.union(pairs.select("v", "u")).distinct())
    parent = cut(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.least("u", "m").alias("p")))
    total = None
    while True:
        near = both.join(parent, F.col("v") == F.col("node")).groupBy("u").agg(F.min("p").alias("m"))
        met = parent.join(near, F.col("node") == F.col("u"))
        moves = met.select(F.explode(F.array(F.struct("node", F.least("p", "m").alias("p")), F.struct(F.col("p").alias("node"), F.least("p", "m").alias("p")))).alias("x")).select("x.node", "x.p")
        hooked = moves.groupBy("node").agg(F.min("p").alias("p"))
        jump = hooked.select(F.col("node").alias("q"), F.col("p").alias("pp"))
        parent = cut(hooked.join(jump, F.col("p") == F.col("q")).select("node", F.col("pp").alias("p")))
        now = parent.agg(F.sum(F.col("p").cast("decimal(38,0)"))).first()[0]
        if now == total:
            return parent.select("node", F.col("p").alias("component"))
        total = now
