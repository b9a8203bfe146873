"""Every registered query against DuckDB on the smallest tables."""

import datetime
import os

import duckdb
import pytest

from quillon.queries import HEADLINE, ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for f in os.listdir(SF):
        connection.execute(f"create view {f.split('.')[0]} as select * from '{SF}/{f}'")
    return connection


def plain(value):
    if hasattr(value, "to_pydatetime"):
        value = value.to_pydatetime()
    if isinstance(value, float):
        return round(value, 6)
    return value.isoformat() if isinstance(value, datetime.datetime) else value


def rows(names, values):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(repr([plain(row[i]) for i in order]) for row in values)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, duck, name):
    df = QUERIES[name](spark, SF)
    result = duck.execute(ORACLE_SQL[name])
    names = [d[0] for d in result.description]
    assert sorted(df.columns) == sorted(names)
    assert rows(df.columns, df.collect()) == rows(names, result.fetchall())


def test_headline_queries_exist():
    assert set(HEADLINE) <= set(QUERIES)


def test_plans_push_filters_and_prune_columns(spark):
    plan = QUERIES["scan_project"](spark, SF)._jdf.queryExecution().toString()
    assert "PushedFilters" in plan and "GreaterThanOrEqual(l_quantity,10.0)" in plan
    assert "l_comment" not in plan and "l_tax" not in plan.split("ReadSchema")[-1]
    assert "Python" not in plan


def test_top_k_does_not_sort_all(spark):
    assert "TakeOrderedAndProject" in QUERIES["order_limit"](spark, SF)._jdf.queryExecution().toString()
