"""Table functions in SQL against the operators of the same meaning."""

import pytest
from pyspark.sql import functions as F

from tessera.functions import tables
from tessera.functions.text import normalize_asr
from tessera.operators import segment as S
from tessera.sources import fixtures as X


@pytest.fixture(scope="module")
def items(spark, sf_dir):
    tables.register(spark)
    rows = X.items(spark, sf_dir).withColumn("start_s", F.col("start_ms") / 1000).withColumn("end_s", F.col("end_ms") / 1000)
    rows.withColumn("text", normalize_asr(F.col("text"))).createOrReplaceTempView("tf_items")
    return rows


def rows_of(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def test_segments(spark, items):
    got = spark.sql("SELECT * FROM ev_segment(TABLE(SELECT video_id, item_ord, start_s, end_s, text FROM tf_items), key => 'video_id', ord => 'item_ord')")
    columns = ("video_id", "segment", "start_s", "end_s", "n_items", "text")
    assert rows_of(got, *columns) == rows_of(S.segment_transcript(items), *columns)


def test_segments_of_odd_tables(spark, items):
    none = spark.sql("SELECT * FROM ev_segment(TABLE(SELECT * FROM tf_items WHERE false), key => 'video_id', ord => 'item_ord')")
    assert none.count() == 0 and none.columns == ["video_id", "segment", "start_s", "end_s", "n_items", "text"]
    blank = spark.sql("SELECT * FROM ev_segment(TABLE(SELECT 'a' AS k, 1L AS o, 0D AS start_s, 1D AS end_s, CAST(NULL AS STRING) AS text UNION ALL SELECT 'a', 2L, 1D, 2D, ' word '), key => 'k', ord => 'o')")
    assert [tuple(r) for r in blank.collect()] == [("a", 0, 1.0, 2.0, 1, "word")]
    with pytest.raises(Exception, match="needs a column start_s"):
        spark.sql("SELECT * FROM ev_segment(TABLE(SELECT 1 AS k, 2 AS o, 'x' AS text), key => 'k', ord => 'o')").collect()


def test_top_rows(spark, items):
    got = spark.sql("SELECT * FROM ev_top(TABLE(SELECT video_id, item_ord, length(text) AS n FROM tf_items) PARTITION BY video_id ORDER BY (n DESC, item_ord), k => 3)")
    want = spark.sql("SELECT * FROM (SELECT video_id, item_ord, length(text) AS n, row_number() OVER (PARTITION BY video_id ORDER BY length(text) DESC, item_ord) AS rank FROM tf_items) WHERE rank <= 3")
    columns = ("video_id", "item_ord", "n", "rank")
    assert rows_of(got, *columns) == rows_of(want, *columns)
    assert spark.sql("SELECT * FROM ev_top(TABLE(SELECT * FROM tf_items) PARTITION BY video_id ORDER BY item_ord, k => 0)").count() == 0
