"""Queries of deduplication, set operations and merges."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import name_key
from ..operators import merge
from ..sources.tables import table
from .catalog import plan


def attempts(spark, sf_dir):
    """fetch attempts from lineitem: target, rank, and whether and why an attempt fails."""
    from .fixtures import numbered

    rows = numbered(spark, sf_dir).select(F.col("l_orderkey").alias("target"), F.col("i").alias("rank"), (F.col("l_quantity") > 40).alias("ok"), F.concat(F.lit("size "), F.col("l_partkey").cast("string")).alias("reason"))
    return merge.first_valid_candidate(rows, "target", "rank", "ok", "reason")


from .fixtures import NUMBERED_SQL  # noqa: E402

A_SQL = f"WITH {NUMBERED_SQL}, a AS (SELECT l_orderkey AS target, i AS rank, l_quantity > 40 AS ok, 'size ' || l_partkey AS reason FROM m)"


@plan("q7_first_valid_candidate", f"{A_SQL} SELECT target, min(rank) FILTER (WHERE ok) AS rank, CASE WHEN NOT bool_or(ok) THEN string_agg(reason, '; ' ORDER BY rank) END AS reasons FROM a GROUP BY 1")
def q7(spark, sf_dir):
    accepted, failed = attempts(spark, sf_dir)
    none = F.lit(None)
    return accepted.select("target", "rank", none.cast("string").alias("reasons")).unionByName(failed.select("target", none.cast("int").alias("rank"), "reasons"))


@plan("q8_retry_merge", "SELECT 'accepted' AS side, o_orderkey FROM orders WHERE o_orderstatus = 'F' OR o_orderkey % 3 = 0 UNION ALL SELECT 'failed', o_orderkey FROM orders WHERE o_orderstatus <> 'F' AND o_orderkey % 3 <> 0")
def q8(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    accepted, failed = merge.retry_merge(orders.where("o_orderstatus = 'F'"), orders.where("o_orderstatus <> 'F'"), orders.where("o_orderkey % 3 = 0"), "o_orderkey")
    return accepted.select(F.lit("accepted").alias("side"), "o_orderkey").unionByName(failed.select(F.lit("failed").alias("side"), "o_orderkey"))


@plan("q9_worklist", "SELECT doc_id FROM documents WHERE (length(text) < 1000 OR lang = 'fr') AND source <> 'src5' AND doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)")
def q9(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    targets = docs.select("doc_id", (F.length("text") < 1000).alias("short"), (F.col("lang") == "fr").alias("has_attachment"), F.when(F.col("source") == "src5", "timeout").alias("error"), F.col("source").alias("url"))
    return merge.worklist(targets, table(spark, sf_dir, "labels").withColumn("done", F.col("quality") == 1), "doc_id", "both").select("doc_id")


@plan("d1_name_key", "SELECT p_partkey, p_name || p_brand AS k1, p_name || 'x' || p_brand AS k2, replace(p_name, ' ', '') || 'a·b' AS k3 FROM part")
def d1(spark, sf_dir):
    raw = lambda *c: F.concat(*c)
    rows = table(spark, sf_dir, "part").select(
        "p_partkey",
        name_key(raw("p_name", F.lit("（试行)"), "p_brand", F.lit("(2024）")), "brackets").alias("k1"),
        name_key(raw("p_name", F.lit("（x-"), F.lit("x"), "p_brand"), "span").alias("k2"),
        name_key(raw(F.lit("《"), "p_name", F.lit("》a·b")), "quotes").alias("k3"),
    )
    return rows


D2_SQL = """SELECT doc_id, r = 1 AS kept, CASE WHEN r = 1 THEN remark ELSE concat('[跨源重复,已在更高优先源] ', coalesce(remark, '')) END AS remark
FROM (SELECT doc_id, row_number() OVER (PARTITION BY text ORDER BY source, doc_id) AS r, CASE WHEN doc_id % 3 > 0 THEN lang END AS remark FROM documents)"""


@plan("d2_priority_dedup", D2_SQL)
def d2(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", F.sha2("text", 256).alias("key"), F.when(F.col("doc_id") % 3 > 0, F.col("lang")).alias("remark"))
    kept, excluded = merge.priority_dedup(docs, "key", ["source", "doc_id"], "remark")
    return kept.select("doc_id", F.lit(True).alias("kept"), "remark").unionByName(excluded.select("doc_id", F.lit(False).alias("kept"), "remark"))


@plan("d3_anti_existing", "SELECT min(doc_id) AS doc_id FROM documents WHERE source >= 'src5' GROUP BY text HAVING text NOT IN (SELECT text FROM documents WHERE source < 'src5' AND source <> 'src1')")
def d3(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", F.sha2("text", 256).alias("key"))
    return merge.anti_existing(docs.where("source >= 'src5'"), docs.where("source < 'src5'"), "key", ["doc_id"], F.col("source") == "src1").select("doc_id")


@plan("d4_prefix_match_dedup", "SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM supplier s WHERE starts_with('Entity#' || c_custkey, 'Entity#' || s_suppkey || '7') OR starts_with('Entity#' || s_suppkey || '7', 'Entity#' || c_custkey))")
def d4(spark, sf_dir):
    new = table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit("Entity#"), F.col("c_custkey").cast("string")).alias("key"))
    old = table(spark, sf_dir, "supplier").select(F.concat(F.lit("Entity#"), F.col("s_suppkey").cast("string"), F.lit("7")).alias("key"))
    return merge.prefix_match_dedup(new, old, "key").select("c_custkey")


@plan("d5_containment_flag", "SELECT p_partkey, EXISTS (SELECT 1 FROM supplier s WHERE p.k = s.k OR (contains(p.k, s.k) AND length(s.k) >= 5) OR (contains(s.k, p.k) AND length(p.k) >= 5)) AS contained FROM (SELECT p_partkey, 'item ' || p_partkey || ' of' AS k FROM part) p, (SELECT 1) WHERE true".replace("supplier s", "(SELECT 'em ' || s_suppkey || ' ' AS k FROM supplier) s"))
def d5(spark, sf_dir):
    titles = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("item "), F.col("p_partkey").cast("string"), F.lit(" of")).alias("k"))
    names = table(spark, sf_dir, "supplier").select(F.concat(F.lit("em "), F.col("s_suppkey").cast("string"), F.lit(" ")).alias("k"))
    return merge.containment_flag(titles, names, "k").select("p_partkey", "contained")


@plan("d6_upsert_by_source", "SELECT doc_id, CASE WHEN source IN ('src1', 'src2') THEN 2 ELSE 1 END AS version FROM documents WHERE source NOT IN ('src1', 'src2') OR doc_id % 3 = 0")
def d6(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    store, new = docs.withColumn("version", F.lit(1)), docs.where("source IN ('src1', 'src2') AND doc_id % 3 = 0").withColumn("version", F.lit(2))
    return merge.upsert_by_source(merge.upsert_by_source(store, new), new).select("doc_id", "version")


@plan("d7_coverage_check", "SELECT doc_id, 'not registered' AS side FROM documents WHERE doc_id % 5 > 0 AND doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT doc_id, 'no file' FROM labels WHERE doc_id % 5 = 0")
def d7(spark, sf_dir):
    return merge.coverage_check(table(spark, sf_dir, "documents").where("doc_id % 5 > 0"), table(spark, sf_dir, "labels"), "doc_id")


WORDS = ["License", "@", "www", "que"]


@plan("d8_first_hit_catalog", "SELECT doc_id, CASE WHEN contains(text, 'License') THEN 'License' WHEN contains(text, '@') THEN '@' WHEN contains(text, 'www') THEN 'www' ELSE 'que' END AS found_by FROM documents WHERE contains(text, 'License') OR contains(text, '@') OR contains(text, 'www') OR contains(text, 'que')")
def d8(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    words = F.filter(F.array(*(F.struct(F.lit(i).alias("k"), F.lit(w).alias("found_by")) for i, w in enumerate(WORDS))), lambda w: F.contains(F.col("text"), w["found_by"]))
    hits = docs.select("doc_id", F.inline(words))
    return merge.first_hit_catalog(hits, "doc_id", ["k"]).select("doc_id", "found_by")


@plan("d9_union_sources", "SELECT 'customer' AS source, c_name AS title, c_acctbal > 0 AS keep FROM customer UNION ALL SELECT 'supplier', s_name, s_acctbal > 0 FROM supplier UNION ALL SELECT 'part', p_name, p_size > 10 FROM part")
def d9(spark, sf_dir):
    c, s, p = (table(spark, sf_dir, t) for t in ("customer", "supplier", "part"))
    source = lambda n: F.lit(n)
    return merge.union_sources(
        [
            (c, {"source": source("customer"), "title": F.col("c_name"), "keep": F.col("c_acctbal") > 0}),
            (s, {"source": source("supplier"), "title": F.col("s_name"), "keep": F.col("s_acctbal") > 0}),
            (p, {"source": source("part"), "title": F.col("p_name"), "keep": F.col("p_size") > 10}),
        ]
    )


@plan("d10_attach_file_path", "SELECT o_orderkey, p AS file_path, p IS NOT NULL AS keep, CASE WHEN p IS NULL THEN 'PDF文件未找到' END AS reason FROM orders LEFT JOIN (SELECT l_orderkey, 'f' || min(l_partkey) AS p FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey")
def d10(spark, sf_dir):
    files = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.concat(F.lit("f"), F.col("l_partkey").cast("string")).alias("path"), F.col("l_partkey").alias("k"))
    return merge.attach_file_path(table(spark, sf_dir, "orders").select("o_orderkey"), files, "o_orderkey", "path", "k", "PDF文件未找到")


@plan("d11_distinct_by_key", "SELECT l_orderkey, min(l_partkey) AS l_partkey FROM lineitem GROUP BY 1")
def d11(spark, sf_dir):
    return merge.distinct_by_key(table(spark, sf_dir, "lineitem"), "l_orderkey", ["l_partkey"]).select("l_orderkey", "l_partkey")


@plan("d12_merge_keep_excluded", "SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS seq FROM (SELECT doc_id, row_number() OVER (PARTITION BY text ORDER BY source, doc_id) AS k, length(text) < 300 AS short FROM documents) WHERE k > 1 OR short")
def d12(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", F.sha2("text", 256).alias("key"), (F.length("text") < 300).alias("short"))
    kept, excluded = merge.priority_dedup(docs, "key", ["source", "doc_id"])
    return merge.merge_keep_excluded(excluded, kept.where("short"), order=["doc_id"]).select("doc_id", "seq")
