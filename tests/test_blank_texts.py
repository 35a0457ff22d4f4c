"""Queries on tables whose texts are blank or missing, against their SQL."""

import duckdb

from lexmill.plans import registry


def test_squash_ws(spark, tmp_path):
    texts = ["", " ", "\n\t", "　\x85", " a \n b ", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = sorted(duck.execute(registry.ORACLE_SQL["t5_squash_ws"]).fetchall())
    found = registry.QUERIES["t5_squash_ws"](spark, str(tmp_path))
    assert sorted(map(tuple, found.select("doc_id", "text_md5").collect())) == want and want[5][1] is None
