"""Queries of counts, totals and listings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import merge, report
from ..sources.tables import table
from .catalog import plan
from .intake import C4_SQL, admitted


@plan("a1_distribution", "SELECT coalesce(source, '?') AS value, count(*) AS n FROM documents GROUP BY 1")
def a1(spark, sf_dir):
    return report.distribution(table(spark, sf_dir, "documents"), "source")


SECTIONS = ["Brand#31", "Brand#22", "no such brand", "Brand#13"]
A2_SQL = f"""WITH s AS (SELECT p_brand AS value, grouping(p_brand) AS g, count(*) AS n, count_if(p_size > 10) AS n_yes, count_if(p_size <= 10) AS n_no FROM part GROUP BY ROLLUP (p_brand))
SELECT CASE WHEN g = 1 THEN 'total' ELSE value END AS value, n, n_yes, n_no, row_number() OVER (ORDER BY g, coalesce(nullif(coalesce(list_position({SECTIONS!r}, value), 0), 0), 5), value) AS place FROM s"""


@plan("a2_totals_by_section", A2_SQL)
def a2(spark, sf_dir):
    found = report.totals_by_section(table(spark, sf_dir, "part"), "p_brand", SECTIONS, F.col("p_size") > 10)
    return found.withColumn("place", F.col("place").cast("long"))


@plan("a4_skip_reasons", f"SELECT coalesce({C4_SQL}, 'admitted') AS reason, count(*) AS n FROM documents GROUP BY 1")
def a4(spark, sf_dir):
    return report.skip_reasons(admitted(spark, sf_dir))


@plan("a5_files_per_archive", "SELECT source, count(*) AS n, count_if(length(text) < 1000) AS n_short, count_if(lang = 'fr') AS n_attached, count_if(length(text) < 1000 AND lang = 'fr') AS n_both FROM documents GROUP BY 1")
def a5(spark, sf_dir):
    return report.files_per_archive(table(spark, sf_dir, "documents"), "source", F.length("text") < 1000, F.col("lang") == "fr")


@plan("a6_sequence_number", "SELECT doc_id, row_number() OVER (ORDER BY lang, doc_id) AS seq FROM documents")
def a6(spark, sf_dir):
    return merge.sequence_number(table(spark, sf_dir, "documents").select("doc_id", "lang"), ["lang", "doc_id"]).select("doc_id", "seq")


@plan("a7_catalog_sort", "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderpriority DESC, coalesce(CASE WHEN o_orderstatus <> 'P' THEN strftime(o_orderdate, '%Y-%m-%d') END, 'None') DESC, o_orderkey) AS seq FROM orders")
def a7(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").withColumn("d", F.when(F.col("o_orderstatus") != "P", F.date_format("o_orderdate", "yyyy-MM-dd")))
    return merge.sequence_number(rows, [F.col("o_orderpriority").desc(), F.coalesce("d", F.lit("None")).desc(), F.col("o_orderkey")]).select("o_orderkey", "seq")


@plan("a8_top_n_listing", "SELECT source, min(doc_id) AS doc_id FROM documents GROUP BY 1 ORDER BY 2 LIMIT 15")
def a8(spark, sf_dir):
    return report.top_n_listing(table(spark, sf_dir, "documents"), "source", ["doc_id"], 15).select("source", "doc_id")


@plan("a9_bytes_per_key", "SELECT source, sum(octet_length(encode(text))) AS n_bytes, sum(length(text)) AS n_chars FROM documents GROUP BY 1")
def a9(spark, sf_dir):
    return report.bytes_per_key(table(spark, sf_dir, "documents"), "source", "text")
