"""Every named query against its SQL, and the shape of its plan."""

import re

import pytest

import __spark_entry__ as driver
from tests.check import compare, connect

SF = "/root/testdata/sf0.001"
QUERIES, ORACLE = driver.QUERIES, driver.ORACLE


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)


def test_entry(spark):
    assert driver.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    assert compare(df, con, ORACLE[name]) == ""
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not re.search("CartesianProduct|BroadcastNestedLoopJoin", plan)
    assert not re.search("PythonUDF|BatchEvalPython|ArrowEvalPython|MapInPandas", plan)
    # no broadcast that was asked for by hand
    logical = df._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=broadcast" not in logical and "ResolvedHint" not in logical


@pytest.mark.parametrize("name", ["words_by_person", "sent_score", "vocab_distinct_length"])
def test_filter_and_columns_reach_the_scan(spark, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "In(source" in plan
    assert all("n_chars" not in scan for scan in re.findall(r"FileScan parquet \[([^\]]*)\]", plan))


def test_top_words_are_limited_before_the_shuffle(spark):
    plan = QUERIES["distinctive_words"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan
