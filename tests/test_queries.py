"""Every driver query of the engine against its SQL in DuckDB."""

import os

import duckdb
import pytest

from lexigrid.plans import queries

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


def in_order(rows):
    return sorted(rows, key=lambda r: tuple((v is None, str(v)) for v in r))


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_equals_sql(spark, duck, name):
    df = queries.QUERIES[name](spark, SF)
    result = duck.sql(queries.SQL[name])
    assert sorted(df.columns) == sorted(result.columns)
    at = [result.columns.index(c) for c in df.columns]
    want = [tuple(r[i] for i in at) for r in result.fetchall()]
    assert in_order([tuple(r) for r in df.collect()]) == in_order(want)


def test_entry(spark):
    import __spark_entry__ as driver

    assert driver.entry(spark).count() > 0
    assert set(queries.QUERIES) <= set(driver.queries())
    assert set(driver.oracle_sql()) <= set(driver.queries())


def test_scans_read_only_what_they_use(spark):
    plan = queries.q08_availability_tokens(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<user_id:bigint,event_type:string>" in plan.replace("\n", "")


def test_point_filters_reach_the_scan(spark):
    df = spark.read.parquet(f"{SF}/part.parquet").where("p_partkey = 5").select("p_name")
    assert "EqualTo(p_partkey,5)" in df._jdf.queryExecution().executedPlan().toString()
