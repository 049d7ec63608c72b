"""Registered queries against their SQL on the smallest data, and the shape of the registry."""

import pytest
from oracle_compare import compare, connect

from __spark_entry__ import entry, oracle_sql, queries

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


def test_every_oracle_has_a_query():
    assert set(oracle_sql()) <= set(queries())


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_matches_sql(spark, con, name):
    assert compare(spark, con, queries()[name], oracle_sql()[name], FOLDER) is None


def test_entry(spark):
    df = entry(spark)
    assert df.columns == ["value_name", "percent_value", "count_value", "count_percent"] and df.count() > 10


@pytest.mark.parametrize("name", ["propensity_matched_cohort", "odds_ratio_table", "cox_summary"])
def test_model_queries_run(spark, name):
    assert queries()[name](spark, "/root/testdata/sf0.01").count() > 0
