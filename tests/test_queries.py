"""Every registered query against its SQL."""

import oracle
import pytest

from tessera.plans.catalog import ORACLES, QUERIES


@pytest.fixture(scope="module")
def con(sf_dir):
    return oracle.connect(sf_dir)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, con, name):
    df = QUERIES[name](spark, sf_dir)
    if name in ORACLES:
        assert not (found := oracle.differences(df, con, ORACLES[name])), found
    else:
        assert df.columns and df.count() >= 0


def test_no_query_is_a_nested_loop(spark, sf_dir):
    for name in ("h_interval_join", "c_align_frames", "d_text_at_timestamp", "g_time_band", "h_gap_review", "k_pairwise", "g_bm25"):
        plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).limit(1).count() == 1
    assert set(entry.oracle_sql()) <= set(entry.queries())
