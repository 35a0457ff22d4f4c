"""The operators' queries against their SQL, on the smallest tables."""

import os

import duckdb
import pytest

from lexmill.llm import queries

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF_DIR}/documents.parquet'")
    want = connection.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in want.description]
    found = queries.QUERIES[name](spark, SF_DIR)
    assert sorted(found.columns) == sorted(names)
    assert sorted(map(tuple, found.select(*names).collect())) == sorted(want.fetchall())


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLE_SQL)))
def test_other_queries_return_every_document(spark, name):
    found = queries.QUERIES[name](spark, SF_DIR).select("doc_id").distinct().count()
    assert found == spark.read.parquet(f"{SF_DIR}/documents.parquet").count()
