"""Every query with an SQL twin returns the twin's rows; the others run."""

import pytest
from twin import compare, duck

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="session")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(SQL))
def test_twin(spark, con, name):
    assert compare(spark, con, SF, QUERIES[name], SQL[name]) is None


@pytest.mark.parametrize("name", ["pooled_forecasts", "pooled_forecasts_full", "capped_source_weights", "source_elo", "stance_timeline", "stance_quantiles",
                                  "weighted_median_stance", "article_reduction"])
def test_large_input_steps_give_the_same_rows(spark, con, big_input, name):
    assert compare(spark, con, SF, QUERIES[name], SQL[name]) is None


def test_no_twin_without_query():
    assert set(SQL) <= set(QUERIES)


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", ["source_leaderboard", "guarded_claims", "market_report", "pooled_forecasts", "competitive_brier"])
def test_plan_has_no_cartesian_product_and_no_python(spark, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan and "Python" not in plan


def test_filter_and_columns_reach_the_scan(spark):
    plan = QUERIES["eligible_pools"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "l_extendedprice" not in plan
