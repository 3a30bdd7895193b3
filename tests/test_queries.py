"""Every registered query against its check SQL, and the plan shapes that must not appear."""

import duckdb
import pytest

import __spark_entry__ as entry
from tidewatch.plans import catalog
from tools.check_queries import TABLES, compare

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def connection():
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    return con


@pytest.mark.parametrize("key", list(catalog.queries()))
def test_matches_check_sql(spark, connection, key):
    message, _, good = compare(spark, connection, key, SF)
    assert good, message


def test_every_query_has_check_sql():
    assert set(catalog.queries()) == set(catalog.oracles())


def test_flagship_runs(spark):
    result = entry.entry(spark)
    assert result.columns == ["hour", "level", "resource_type", "n"] and result.count() > 0


@pytest.mark.parametrize("key", [k for k in catalog.queries() if "stream" not in k])
def test_no_cross_join(spark, key):
    plan = catalog.queries()[key](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
