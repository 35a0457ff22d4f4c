"""Queries of segmentation, on regulations made from orders and lineitem."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import article_number, repair_numbers
from ..operators import classify, graph, report, segment
from ..operators.retrieve import cite_context
from ..sources.tables import scratch, table, write_chunks, written
from .catalog import plan
from .fixtures import ARTICLES_SQL, NUMBERED_SQL, SQL_NUMERALS, clauses, cn, numbered, regulations


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment.parse_articles(segment.text_lines(regulations(spark, sf_dir), "doc_id", "text"))


@plan("g4_parse_articles", f"WITH {ARTICLES_SQL} SELECT doc_id, label, chapter, section, body FROM articles")
def parse_articles(spark, sf_dir):
    return articles(spark, sf_dir).select("doc_id", "label", "chapter", "section", "body")


@plan("g1_article_number", f"WITH {NUMBERED_SQL} SELECT l_orderkey AS doc_id, i AS art_no, count(*) AS n FROM m GROUP BY 1, 2")
def g1(spark, sf_dir):
    no = article_number(F.regexp_extract("label", "第(.+)条", 1))
    return articles(spark, sf_dir).groupBy("doc_id", no.cast("long").alias("art_no")).agg(F.count("*").alias("n"))


@plan("g2_presplit_paras", f"WITH {NUMBERED_SQL} SELECT l_orderkey AS doc_id, i - 1 AS part, '第' || {SQL_NUMERALS}[i] || '条 part ' || l_partkey || CASE WHEN l_partkey % 5 = 0 THEN '引用第' || {SQL_NUMERALS}[i + 5] || '条' ELSE '' END AS para FROM m")
def g2(spark, sf_dir):
    """All articles of an order in one paragraph, with citations of later articles inside."""
    rows = numbered(spark, sf_dir)
    text = F.concat(F.lit("第"), cn(F.col("i")), F.lit("条 part "), F.col("l_partkey").cast("string"), F.when(F.col("l_partkey") % 5 == 0, F.concat(F.lit("引用第"), cn(F.col("i") + 5), F.lit("条"))).otherwise(""))
    paras = rows.groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", text.alias("x")))), lambda s: s["x"]), "").alias("para"))
    found = segment.presplit_paras(paras.withColumn("pos", F.lit(0)), "doc_id", "pos", "para")
    single = F.row_number().over(Window.partitionBy("doc_id").orderBy("part")) - 1
    return found.select("doc_id", single.cast("long").alias("part"), "para")


@plan(
    "g3_classify_lines",
    f"WITH {NUMBERED_SQL} SELECT 'article' AS kind, count(*) AS n FROM m UNION ALL SELECT 'continuation', count(*) FROM m"
    " UNION ALL SELECT 'chapter', count(*) FROM (SELECT DISTINCT l_orderkey, c FROM m) UNION ALL SELECT 'section', count(*) FROM (SELECT DISTINCT l_orderkey, c, s FROM m)",
)
def g3(spark, sf_dir):
    lines = segment.text_lines(regulations(spark, sf_dir), "doc_id", "text")
    return segment.classify_lines(lines).groupBy("kind").agg(F.count("*").alias("n"))


@plan(
    "g5_parse_clauses",
    f"WITH {NUMBERED_SQL} SELECT l_orderkey AS doc_id, c || '.' || i AS label, c || ' flag ' || l_returnflag AS chapter, 'part ' || l_partkey || chr(10) || 'weight ' || l_suppkey || ' and more' AS body FROM m",
)
def g5(spark, sf_dir):
    lines = segment.text_lines(clauses(spark, sf_dir), "doc_id", "text")
    return segment.parse_articles(lines, mode="clause").select("doc_id", "label", "chapter", "body")


@plan("g6_assemble_numbers", f"WITH {NUMBERED_SQL} SELECT l_orderkey AS doc_id, c || '.' || i AS number, 'part ' || l_partkey AS title FROM m UNION ALL SELECT DISTINCT l_orderkey, CAST(c AS VARCHAR), 'flag ' || l_returnflag FROM m")
def g6(spark, sf_dir):
    lines = segment.text_lines(clauses(spark, sf_dir, fragmented=True), "doc_id", "text")
    return segment.assemble_numbers(lines).where("number IS NOT NULL").select("doc_id", "number", "title")


@plan(
    "g7_group_units",
    f"WITH {NUMBERED_SQL} SELECT l_orderkey AS doc_id, c || '.' || i AS unit, c || '.' || i || ' part ' || l_partkey || chr(10) || 'weight ' || l_suppkey || ' and more' AS body FROM m",
)
def g7(spark, sf_dir):
    lines = segment.text_lines(clauses(spark, sf_dir, fragmented=True), "doc_id", "text")
    return segment.group_units(segment.assemble_numbers(lines)).where("unit LIKE '%.%'").select("doc_id", "unit", "body")


@plan(
    "g8_guarded_clauses",
    f"WITH {NUMBERED_SQL} SELECT l_orderkey AS doc_id, c AS chapter, count(*) AS n_clauses FROM m GROUP BY 1, 2",
)
def g8(spark, sf_dir):
    """Clauses in chapters, with table numbers planted that must not count."""
    docs = clauses(spark, sf_dir).withColumn("text", F.concat(F.lit("70.1 dB\n9 m/s\n"), F.regexp_replace("text", "\nweight", "\n88.3 kg\n77 long heading that is no chapter\nweight")))
    found = segment.guarded_clauses(segment.text_lines(docs, "doc_id", "text"))
    return found.where("kind = 'clause'").groupBy("doc_id", F.col("chapter").cast("long").alias("chapter")).agg(F.count("*").alias("n_clauses"))


@plan(
    "g9_split_or_fulltext",
    f"WITH {ARTICLES_SQL} SELECT doc_id, count(*) AS n_rows, count(*) AS n_labels FROM articles GROUP BY 1 UNION ALL SELECT -1 - doc_id, 1, 0 FROM documents WHERE NOT regexp_matches(text, '第[一二三四五六七八九十百千零〇两0-9]+条')",
)
def g9(spark, sf_dir):
    plain = table(spark, sf_dir, "documents").select((-1 - F.col("doc_id")).alias("doc_id"), "text")
    out = segment.split_or_fulltext(regulations(spark, sf_dir).unionByName(plain), "doc_id", "text")
    return out.groupBy("doc_id").agg(F.count("*").alias("n_rows"), F.count("label").alias("n_labels"))


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), F.concat(F.lit("law"), F.col("o_orderkey").cast("string")).alias("name"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("source"))
    return segment.build_chunks(articles(spark, sf_dir), docs, "doc_id", "name")


@plan("g10_build_chunks", f"WITH {ARTICLES_SQL} SELECT doc_id, 'law' || doc_id || '::' || label AS chunk_id, o_orderstatus AS status, length(body) AS n_chars FROM articles JOIN orders ON doc_id = o_orderkey")
def g10(spark, sf_dir):
    return chunks(spark, sf_dir).select("doc_id", "chunk_id", "status", F.length("body").cast("long").alias("n_chars"))


@plan("g11_min_length_gate", "SELECT doc_id, length(replace(text, chr(10), '')) >= 1500 AS kept, CASE WHEN length(replace(text, chr(10), '')) < 1500 THEN 'too short: ' || length(replace(text, chr(10), '')) END AS reason FROM documents")
def g11(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumn("label", F.lit(None).cast("string"))
    return segment.min_length_gate(docs, "text", "label", min_full=1500).select("doc_id", "kept", "reason")


@plan(
    "g12_parent_child_chunks",
    "SELECT doc_id AS parent, k AS child, k * 150 AS start, md5(substring(text, CAST(k * 150 + 1 AS BIGINT), 200)) AS text_md5 FROM (SELECT doc_id, text, unnest(range(0, greatest(0, (length(text) - 51) // 150) + 1)) AS k FROM documents)",
)
def g12(spark, sf_dir):
    out = segment.parent_child_chunks(table(spark, sf_dir, "documents"), "doc_id", "text")
    return out.select("parent", F.col("child").cast("long").alias("child"), F.col("start").cast("long").alias("start"), F.md5("text").alias("text_md5"))


@plan("q4_article_count_verdict", f"WITH {NUMBERED_SQL} SELECT l_orderkey AS doc_id, count(*) + count_if(l_partkey % 7 = 0) AS n_articles, CASE WHEN count(*) + count_if(l_partkey % 7 = 0) >= 3 THEN 'OK' ELSE 'SUSPECT' END AS verdict FROM m GROUP BY 1")
def q4(spark, sf_dir):
    return classify.article_count_verdict(regulations(spark, sf_dir), "text", "supplier").select("doc_id", F.col("n_articles").cast("long").alias("n_articles"), "verdict")


@plan("a3_chunks_per_doc", f"WITH {ARTICLES_SQL} SELECT o_orderkey AS doc_id, count(label) AS n_articles, count(label) > 0 AS has_article FROM orders LEFT JOIN articles ON doc_id = o_orderkey GROUP BY 1")
def a3(spark, sf_dir):
    return report.chunks_per_doc(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id")), articles(spark, sf_dir), "doc_id")


@plan("a10_chunk_profile", f"WITH {ARTICLES_SQL} SELECT count(*) AS total, count(*) AS with_number, 0 AS without_number FROM articles")
def a10(spark, sf_dir):
    return report.chunk_profile(articles(spark, sf_dir))


@plan("s4_write_chunks", f"WITH {ARTICLES_SQL} SELECT o_orderpriority AS source, count(*) AS n FROM articles JOIN orders ON doc_id = o_orderkey GROUP BY 1")
def s4(spark, sf_dir):
    """Written by source, one source written again, read back."""
    path, rows = scratch(spark, "chunks"), chunks(spark, sf_dir)
    write_chunks(rows, path)
    write_chunks(rows.where("source = '1-URGENT'"), path)
    return spark.read.parquet(path).groupBy(F.col("source").cast("string").alias("source")).agg(F.count("*").alias("n"))


LAWS = "law"


def laws(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), F.concat(F.lit(LAWS), F.col("o_orderkey").cast("string")).alias("name"))


@plan("k1_citation_edges", f"WITH {ARTICLES_SQL} SELECT DISTINCT 'law' || a.doc_id || '::' || a.label AS src, a.l_suppkey AS dst_law, '第一条' AS dst_article FROM articles a JOIN orders ON l_suppkey = o_orderkey WHERE l_partkey % 7 = 0")
def k1(spark, sf_dir):
    return graph.citation_edges(chunks(spark, sf_dir), laws(spark, sf_dir), "chunk_id", "doc_id", "body")


#: Laws with a country prefix, or with brackets that do not match, and how a chunk names one; for both engines.
CORE = "concat('law', o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN '无人机条例' WHEN 1 THEN '管理办法' ELSE '实施细则' END)"
NAMED_LAWS = f"""o_orderkey AS law, {CORE} AS core, CASE WHEN o_orderkey % 2 = 0 THEN concat('law', o_orderkey, '号令') END AS short,
  CASE o_orderkey % 3 WHEN 0 THEN concat('中华人民共和国law', o_orderkey, ' 无人机条例') WHEN 1 THEN concat({CORE}, '（试行)') ELSE concat({CORE}, '(2020年修正）') END AS name"""
CITING = """concat(l_orderkey, '-', i) AS src, l_orderkey AS own, CASE l_partkey % 6 WHEN 0 THEN concat('依照《', name, '》第一条') WHEN 1 THEN concat('见《', core, '》第二条、第三条。')
  WHEN 2 THEN concat('《', core, '（修订）》第四条') WHEN 3 THEN concat('违反', core, '第五条的') WHEN 4 THEN concat('按law', l_suppkey, '号令第六条') ELSE concat('《', core, '实施办法》第七条，本法第八条') END AS body"""


@plan(
    "k1_citations_by_name",
    f"""WITH {NUMBERED_SQL}, laws AS (SELECT {NAMED_LAWS} FROM orders), c AS (SELECT concat(l_orderkey, '-', i) AS src, l_orderkey AS own, law, short, l_partkey % 6 AS v FROM m JOIN laws ON law = l_suppkey)
SELECT src, CASE WHEN v = 5 OR v = 4 AND short IS NULL THEN own ELSE law END AS dst_law, unnest(CASE v WHEN 0 THEN ['第一条'] WHEN 1 THEN ['第二条', '第三条'] WHEN 2 THEN ['第四条'] WHEN 3 THEN ['第五条'] WHEN 4 THEN ['第六条'] ELSE ['第八条'] END) AS dst_article FROM c""",
)
def k1_names(spark, sf_dir):
    """Citations by full name, by key with and without a suffix, unquoted, by short name, and of an unregistered law whose
    name begins like a registered one's."""
    named = spark.sql(f"SELECT {NAMED_LAWS} FROM {{orders}}", orders=table(spark, sf_dir, "orders"))
    citing = numbered(spark, sf_dir).join(named, F.col("law") == F.col("l_suppkey"))
    citing = spark.sql(f"SELECT {CITING} FROM {{rows}}", rows=citing)
    return graph.citation_edges(citing, named.withColumnRenamed("law", "own"), "src", "own", "body", short="short")


@plan("k7_supersedes_edges", f"WITH {ARTICLES_SQL} SELECT DISTINCT a.doc_id AS new, a.l_suppkey AS old FROM articles a JOIN orders ON l_suppkey = o_orderkey WHERE l_partkey % 11 = 0")
def k7(spark, sf_dir):
    return graph.supersedes_edges(chunks(spark, sf_dir), laws(spark, sf_dir), "doc_id", "body")


@plan(
    "r7_cite_context",
    f"""WITH {ARTICLES_SQL}, c AS (SELECT doc_id, i, 'law' || doc_id || '::' || label AS chunk_id, '《law' || doc_id || '》' || label AS citation, o_orderstatus AS status, body, l_suppkey, l_partkey % 7 = 0 AS cites FROM articles JOIN orders ON doc_id = o_orderkey),
e AS (SELECT DISTINCT a.doc_id AS query, b.chunk_id, b.citation, b.status, b.body, a.chunk_id AS via FROM c a JOIN c b ON b.doc_id = a.l_suppkey AND b.i = 1 WHERE a.i <= 2 AND a.cites AND NOT (b.doc_id = a.doc_id))
SELECT doc_id AS query, chunk_id, citation, status, md5(body) AS text_md5, true AS primary, CAST(NULL AS VARCHAR) AS path FROM c WHERE i <= 2
UNION ALL SELECT query, chunk_id, any_value(citation), any_value(status), md5(any_value(body)), false, min(via) || '>' || chunk_id FROM e GROUP BY query, chunk_id""",
)
def r7(spark, sf_dir):
    """The first two articles of each law as hits, and the articles that they cite as what the graph adds."""
    rows = written(chunks(spark, sf_dir).select("doc_id", "chunk_id", "name", "label", "status", "body"), "chunks")
    hits = rows.where("label IN ('第一条', '第二条')").select(F.col("doc_id").alias("query"), "chunk_id")
    cited = graph.citation_edges(rows.join(hits, "chunk_id", "left_semi"), laws(spark, sf_dir), "chunk_id", "doc_id", "body")
    edges = cited.select("src", F.concat(F.lit(LAWS), F.col("dst_law").cast("string"), F.lit("::"), "dst_article").alias("dst"), F.lit("cites").alias("kind"), F.lit(1.0).alias("weight"))
    edges = written(edges, "cited")
    reached = graph.expand_hops(edges.select(F.col("src").alias("seed")), edges, 1, 0.5).where("hop > 0")
    reached = reached.join(hits.withColumnRenamed("chunk_id", "seed"), "seed").select("query", F.col("node").alias("chunk_id"), "path")
    found = cite_context(hits, rows, "chunk_id", "name", "label", "status", "body", reached)
    return found.select("query", "chunk_id", "citation", "status", F.md5("text").alias("text_md5"), "primary", F.array_join("path", ">").alias("path"))


@plan("t15_repair_numbers", f"WITH {NUMBERED_SQL} SELECT l_orderkey AS doc_id, sum(length('weight ' || l_suppkey || ' and more') + length(c || '.' || i || ' part ' || l_partkey) + 2) + (SELECT sum(length(q.c || ' flag ' || q.l_returnflag) + 1) FROM (SELECT DISTINCT l_orderkey, c, l_returnflag FROM m) q WHERE q.l_orderkey = m.l_orderkey) - 1 AS n_chars FROM m GROUP BY 1")
def t15(spark, sf_dir):
    return clauses(spark, sf_dir, fragmented=True).select("doc_id", F.length(repair_numbers("text")).cast("long").alias("n_chars"))
