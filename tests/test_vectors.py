"""Vector cells: the rows of the exhaustive search, bounds that hold, and parts that are not read."""

import numpy as np
import pytest

from tessera.operators import retrieve as R
from tessera.operators import vectors as V

SCHEMA = "vec_id long, embedding array<double>"


def rows_of(df):
    return sorted((tuple(r) for r in df.select("query_id", "vec_id", "score", "rank").collect()), key=repr)


@pytest.fixture(scope="module")
def clustered(spark, tmp_path_factory):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(20, 16))
    data = [(i, (centres[i % 20] + 0.05 * rng.normal(size=16)).tolist()) for i in range(2000)]
    data += [(5000, [0.0] * 16), (5001, data[7][1]), (5002, data[7][1]), (5003, None), (5004, [0.0] * 16)]
    rows, folder = spark.createDataFrame(data, SCHEMA), str(tmp_path_factory.mktemp("cells"))
    V.build(rows, folder)
    return rows, folder


def test_exact_and_pruned(spark, clustered):
    rows, folder = clustered
    queries = rows.where("vec_id % 50 = 0 OR vec_id IN (7, 5001)").withColumnRenamed("vec_id", "query_id")
    for k in (1, 5, 150):
        seen = {}
        assert rows_of(V.search(spark, folder, queries, k, seen)) == rows_of(R.dense_top_k(rows, queries, k))
        assert k == 150 or seen["scored"] < 0.2 * seen["pairs"], seen
    assert seen["pairs"] == 2004 * queries.where("embedding IS NOT NULL").count()


def test_bounds_hold(spark, clustered):
    rows, folder = clustered
    plan = V.Plan(spark, folder)
    asked = V.units([r["embedding"] for r in rows.where("vec_id < 40 OR vec_id = 5000").collect()])
    bounds = plan.bounds(asked)
    assert plan.n.sum() == 2004
    for r in spark.read.parquet(f"{folder}/vectors").collect():
        assert (asked @ np.array(r["unit"]) <= bounds[:, plan.parts.index((r["cell"], r["band"]))] + 1e-9).all()


def test_edges(spark, tmp_path):
    empty = spark.createDataFrame([], SCHEMA)
    queries = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None)], "query_id long, embedding array<double>")
    one = spark.createDataFrame([(1, [0.0, 2.0]), (2, [0.0, 0.0])], SCHEMA)
    V.build(one, str(tmp_path / "one"))
    assert rows_of(V.search(spark, str(tmp_path / "one"), queries, 3)) == rows_of(R.dense_top_k(one, queries, 3)) == [(1, 1, 0.0, 1), (1, 2, 0.0, 2), (2, 1, 0.0, 1), (2, 2, 0.0, 2)]
    assert V.search(spark, str(tmp_path / "one"), queries.where("false"), 3).count() == 0 and R.dense_top_k(one, queries.where("false"), 3).count() == 0
    assert R.dense_top_k(empty, queries, 3).count() == 0


def test_driver_vectors(spark, tmp_path, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    V.build(rows, str(tmp_path))
    queries = rows.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id")
    seen = {}
    assert rows_of(V.search(spark, str(tmp_path), queries, 5, seen)) == rows_of(R.dense_top_k(rows, queries, 5)) and 0 < seen["scored"] <= seen["pairs"]
