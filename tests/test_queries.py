"""Every registered query against its SQL counterpart in DuckDB, on the smallest tables."""

import math
import os

import duckdb
import pytest

from lexmill.plans import registry

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'")
    return connection


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else float(f"{value:.6g}")
    return list(value) if isinstance(value, (list, tuple)) else value


def rows(names, values):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(v[i]) for i in order) for v in values), key=repr)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    found = registry.QUERIES[name](spark, SF_DIR)
    want = duck.execute(registry.ORACLE_SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(found.columns) == sorted(names)
    assert rows(found.columns, found.collect()) == rows(names, want.fetchall())


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_query_without_sql_runs(spark, name):
    assert registry.QUERIES[name](spark, SF_DIR).count() > 0


def test_stream_equals_batch(spark, tmp_path):
    """Two arrivals of raw pages, one of them twice, leave what one batch job makes."""
    from lexmill.sources.tables import table
    from lexmill.streaming.ingest import page_chunks, stream_ingest
    from lexmill.streaming.store import read_store

    pages = table(spark, SF_DIR, "pages")
    inbox, out, checkpoint = (f"{tmp_path}/{n}" for n in ("in", "out", "progress"))
    for part in ("page_id % 2 = 0", "page_id % 2 = 1", "page_id % 4 = 0"):
        pages.where(part).write.mode("append").parquet(inbox)
        stream_ingest(spark, inbox, out, checkpoint, "page_id long, url string, html string")
    columns = ["source", "page_id", "art_pos", "label", "body", "chunk_id"]
    batch = page_chunks(pages).select(*columns).collect()
    assert sorted(map(tuple, read_store(spark, out).select(*columns).collect()), key=repr) == sorted(map(tuple, batch), key=repr)


def test_partition_count_does_not_matter(spark):
    from lexmill.operators.segment import parse_articles, text_lines
    from lexmill.plans.fixtures import regulations

    lines = text_lines(regulations(spark, SF_DIR), "doc_id", "text")
    found = [sorted(map(tuple, parse_articles(lines.repartition(n)).collect()), key=repr) for n in (1, 7)]
    assert found[0] == found[1]
