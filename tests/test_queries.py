import pytest

import entity_cases
from caseloom.plans import cases, queries

PLANS = queries.QUERIES | cases.QUERIES
PLANS_SQL = queries.ORACLE_SQL | cases.ORACLE_SQL


@pytest.mark.parametrize("name", sorted(PLANS_SQL))
def test_query_equals_sql(name, same_rows):
    same_rows(PLANS[name], PLANS_SQL[name])


@pytest.mark.parametrize("name", sorted(entity_cases.ORACLE_SQL))
def test_entity_case_equals_sql(name, same_rows):
    same_rows(entity_cases.QUERIES[name], entity_cases.ORACLE_SQL[name])


def test_entry_runs(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_pairs_are_kept_or_regenerated_in_one_pass(spark):
    """One read and one grouping: the pairs were made distinct four times and joined with themselves in the memory of a task."""
    df = PLANS["q_keep_or_regenerate"](spark, "/root/testdata/sf0.001")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Join" not in plan
