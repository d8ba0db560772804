"""Queries with SQL against it, on odd rows and on the test tables."""

import os

import duckdb
import pytest

from lexigrid.llm import queries

from .helpers import SCHEMA, odd_documents
from .test_rules import SECRETS

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def same(df, con, sql):
    result = con.sql(sql)
    assert sorted(df.columns) == sorted(result.columns)
    at = [result.columns.index(c) for c in df.columns]
    key = lambda r: tuple((v is None, str(v)) for v in r)
    assert sorted((tuple(r) for r in df.collect()), key=key) == sorted((tuple(r[i] for i in at) for r in result.fetchall()), key=key)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_on_test_tables(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    same(queries.queries()[name](spark, SF), con, queries.oracle_sql()[name])


@pytest.mark.parametrize("name", ["op1_mixing", "op2_secret_scan"])
def test_on_odd_rows(spark, tmp_path, name):
    data = odd_documents() + [(900 + i, t, "en", "s2", 0) for i, t in enumerate(SECRETS)]
    spark.createDataFrame(data, SCHEMA).coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    same(queries.queries()[name](spark, str(tmp_path)), con, queries.oracle_sql()[name])


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.queries()) == list(range(1, 11))
