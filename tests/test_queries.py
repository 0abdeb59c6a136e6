"""Every query beside its SQL in DuckDB, on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

from keyweave.plans.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents labels conversations".split()
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(values):
    return tuple(repr(round(v, 6)) if isinstance(v, float) else repr(v) for v in values)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(plain(r[c] for c in columns) for r in df.collect())
    want = duck.sql(SQL[name])
    assert sorted(want.columns) == columns
    at = [want.columns.index(c) for c in columns]
    assert got == sorted(plain(r[k] for k in at) for r in want.fetchall())


def test_filters_reach_the_scan(spark):
    plan = QUERIES["lanes_and"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(o_orderstatus)" in plan and "EqualTo(o_orderstatus,F)" in plan
    schema = plan.split("ReadSchema:")[1]
    assert "o_orderdate" not in schema


def test_sorted_page_is_a_top_k(spark):
    plan = QUERIES["topk_prefix"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
