"""Every registered query that has an SQL twin, against it."""

import importlib.util
import os

import duckdb
import pytest

import __spark_entry__ as entry
from postpulse.plans.oracles import ORACLES
from postpulse.plans.queries import QUERIES

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
DATA = "/root/testdata/sf0.001"

spec = importlib.util.spec_from_file_location("check", os.path.join(ROOT, "tools", "check.py"))
check = importlib.util.module_from_spec(spec)
spec.loader.exec_module(check)


@pytest.fixture(scope="module")
def engine():
    con = duckdb.connect()
    for name in check.TABLES:
        con.sql(f"create view {name} as select * from '{DATA}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, engine, name):
    ours = QUERIES[name](spark, DATA).toPandas()
    theirs = engine.sql(ORACLES[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert check.normal(ours) == check.normal(theirs)


def test_queries_without_sql_are_the_learned_ones():
    assert set(QUERIES) - set(ORACLES) == {"svm_predict", "gbt_predict"}
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())


def test_entry(spark):
    assert entry.entry(spark).count() == 2
