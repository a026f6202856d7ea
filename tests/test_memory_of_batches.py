"""A scored batch is taken apart by bytes too: long texts come few at a time."""

import numpy as np
from pyspark.sql import functions as F

from tessera.operators import retrieve


def test_long_texts_are_scored_few_at_a_time(spark, tmp_path):
    rows = spark.range(40).coalesce(1).select(F.lit("v").alias("video_id"), F.col("id").alias("doc_id"), F.repeat(F.lit("word "), 200_000).alias("text"))
    seen = str(tmp_path / "seen")

    def make():
        def score(batch):
            with open(seen, "a") as f:
                f.write(f"{batch.num_rows}\n")
            return np.ones((batch.num_rows, 1))

        return score

    assert retrieve._scored(rows, ["text"], [(1, "word")], make, 40).count() == 40
    sizes = [int(x) for x in open(seen).read().split()]
    assert sum(sizes) == 40 and max(sizes) <= 8
