"""The registered queries of the operators, and their SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, fim, fingerprints, jaccard, licenses, lm, merkle, packing, ppm, rules, sharding, substring, suffixes
from .runtime import table

VOCABULARY = "byte_bpe_50k.tiktoken"
SHARDS = 8
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    digest = [F.col("doc_id"), F.col("n_words"), F.col("n_removed"), F.sha2("kept", 256).alias("kept_sha256")]
    return substring.drop_repeated_passages(table(spark, sf_dir, "documents"), columns=digest)


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files: a folder for each source, language and hundred of ids. Documents that end with a line on a
    licence are the licence files of their folder, of their language's or of their source's, by doc_id."""
    docs = table(spark, sf_dir, "documents")
    is_licence = F.coalesce(F.substring_index("text", "\n", -1).rlike(r"(?i)\blicen[cs]ed? "), F.lit(False))
    hundred = F.expr("doc_id div 100").cast("string")
    rank = F.when(is_licence, F.coalesce(F.col("doc_id") % 3, F.lit(2))).otherwise(2)
    own = F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))
    name = F.when(is_licence, F.concat(F.lit("LICENSE."), own)).otherwise(F.concat(own, F.lit(".txt")))
    path = F.concat_ws("/", "source", F.when(rank > 0, F.col("lang")), F.when(rank > 1, hundred), name)
    return licenses.scan(docs.select("doc_id", path.alias("path"), "text"), carry=["doc_id"])


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), packing.words())


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    wanted = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return rules.judged(docs.select("doc_id", "text"), labels).select(
        "doc_id", *(F.col(f"_counts.{c}") for c in wanted), F.col("_base_failed").alias("base_failed"), F.col("_kept").alias("kept"), F.col("_rule").alias("rule")
    )


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.drop_repeated_bytes(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")
    )


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.log_scores(table(spark, sf_dir, "documents"))


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_pairs(table(spark, sf_dir, "documents"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce("text", F.lit(""))).cast("long").alias("text_crc32"),
        F.xxhash64("text").alias("tie"),
    )
    return sharding.shard_by_bytes(docs, SHARDS).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    tampered = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 5 == 0
    return merkle.verified_manifest(docs, tampered, F.translate("text", UPPER, UPPER.lower()))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fim.fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text"))
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return found.select(
        "doc_id", "_fim.n", "_fim.form", "_fim.prefix_chars", "_fim.middle_chars",
        digest(F.col("_fim.output")).alias("output_sha256"), digest(fim.restored(F.col("_fim.output"), F.col("_fim.form"))).alias("restored_sha256"),
    )


def op13_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm.identified(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_license_scan": op2_license_scan,
    "op3_ngram_jaccard": op3_ngram_jaccard,
    "op4_byte_bpe": op4_byte_bpe,
    "op5_best_fit_packing": op5_best_fit_packing,
    "op6_quality_rules": op6_quality_rules,
    "op7_suffix_dedup": op7_suffix_dedup,
    "op8_sharding": op8_sharding,
    "op9_lm_scoring": op9_lm_scoring,
    "op10_fingerprints": op10_fingerprints,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_fill_in_middle": op12_fill_in_middle,
    "op13_language_id": op13_language_id,
}

WORDS_SQL = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
CRC_SQL = "SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS crc"
#: Rows of documents as fields: - for null, else byte count, colon, value.
FIELD = lambda c: f"coalesce(octet_length(encode(CAST({c} AS VARCHAR))) || ':' || CAST({c} AS VARCHAR), '-')"
LEAF = lambda text: f"sha256({' || '.join(map(FIELD, ['doc_id', 'source', 'lang', 'n_chars', text]))})"
#: All levels of the trees over (tree, i, n, h): i is the place in the level, n the level's nodes.
LEVELS = lambda name, base: f"""{name}(tree, lvl, i, n, h) AS (SELECT tree, 0, i, n, h FROM {base} UNION ALL
  SELECT tree, lvl + 1, i // 16, (n + 15) // 16, sha256(string_agg(h, '' ORDER BY i)) FROM {name} WHERE n > 1 GROUP BY tree, lvl, i // 16, n)"""  # noqa: E731
#: The way up of each leaf of base: siblings before and after, with # for the node between them.
UPS = lambda base, levels: f"""SELECT b.tree, b.i, list(x ORDER BY lvl) AS ups FROM (SELECT b.tree, b.i, t.lvl,
  coalesce(string_agg(t.h, '' ORDER BY t.i) FILTER (t.i < b.i >> (4 * t.lvl)), '') || '#' || coalesce(string_agg(t.h, '' ORDER BY t.i) FILTER (t.i > b.i >> (4 * t.lvl)), '') AS x
  FROM {base} b JOIN {levels} t ON t.tree = b.tree AND t.n > 1 AND t.i >> 4 = b.i >> (4 * (t.lvl + 1)) GROUP BY 1, 2, 3) b GROUP BY 1, 2"""  # noqa: E731

ORACLE_SQL = {
    "op1_substring_dedup": f"""
WITH d AS (SELECT doc_id, {WORDS_SQL} AS w FROM documents),
s AS (SELECT doc_id, w, unnest(range(0, greatest(len(w) - 49, 0))) AS i FROM d),
k AS (SELECT doc_id, i, array_to_string(w[i + 1 : i + 50], ' ') AS win FROM s),
g AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY win) < doc_id AS dup FROM k),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM g WHERE dup),
words AS (SELECT doc_id, unnest(w) AS x, unnest(range(0, len(w))) AS p FROM d),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS t FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY 1),
n AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n.n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN kept USING (doc_id)""",
    "op3_ngram_jaccard": f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i + 1 : i + 5], ' ') AS g FROM (SELECT doc_id, w, unnest(range(0, CASE WHEN len(w) = 0 THEN 0 ELSE greatest(len(w) - 4, 1) END)) AS i FROM d)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * o >= 80 * (x.n + y.n - o)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(doc_id, c) AS (SELECT doc_id, doc_id FROM d UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.doc_id WHERE r.c < e.b)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, min(r.c) AS component_id FROM d LEFT JOIN n USING (doc_id) JOIN r USING (doc_id) GROUP BY 1, 2""",
    "op8_sharding": """
WITH t AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS crc),
d AS (SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 1 AS size, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: CAST('0x' || x AS BIGINT)) AS b FROM documents),
s AS (SELECT *, sum(size) OVER (ORDER BY doc_id NULLS FIRST) AS upto, row_number() OVER (ORDER BY doc_id NULLS FIRST) AS i, sum(size) OVER () AS total FROM d),
p AS (SELECT *, CAST(least(7, ((2 * upto - size) * 8) // (2 * total)) AS INTEGER) AS shard FROM s)
SELECT doc_id, size, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), b), lambda c, x: xor(c >> 8, crc[(xor(c, x) & 255) + 1])), 4294967295) AS text_crc32,
  'bytes' AS law, shard, i - min(i) OVER (PARTITION BY shard) AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM p, t""",
    "op7_suffix_dedup": """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
k AS (SELECT doc_id, i, substring(h, 2 * i + 1, 100) AS win FROM (SELECT doc_id, h, unnest(range(0, greatest(length(h) // 2 - 49, 0))) AS i FROM d)),
g AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY win) < doc_id AS dup FROM k),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM g WHERE dup),
spans AS (SELECT doc_id, count(*) AS n, count_if(q IS NULL OR q < p - 1) AS spans FROM (SELECT doc_id, p, lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS q FROM gone) GROUP BY 1),
kept AS (SELECT doc_id, string_agg(x, '' ORDER BY p) AS t FROM (SELECT doc_id, p, substring(h, 2 * p + 1, 2) AS x FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2)) AS p FROM d JOIN spans USING (doc_id))) ANTI JOIN gone USING (doc_id, p) GROUP BY 1)
SELECT d.doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, coalesce(n, 0) AS n_removed, coalesce(spans, 0) AS n_spans,
  sha256(unhex(CASE WHEN n IS NULL THEN h ELSE coalesce(t, '') END)) AS kept_sha256
FROM d LEFT JOIN spans USING (doc_id) LEFT JOIN kept USING (doc_id)""",
    "op11_merkle_manifest": f"""
WITH RECURSIVE crc AS ({CRC_SQL}),
a AS (SELECT doc_id, coalesce('+' || source, '') AS tree, {LEAF('text')} AS h, {LEAF(f"translate(text, '{UPPER}', '{UPPER.lower()}')")} AS other,
  list_transform(regexp_extract_all(hex(encode(coalesce(CAST(doc_id AS VARCHAR), ''))), '..'), lambda x: CAST('0x' || x AS BIGINT)) AS b FROM documents),
l AS (SELECT doc_id, tree, h, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, h) - 1 AS i, count(*) OVER (PARTITION BY tree) AS n,
  CASE WHEN xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), b), lambda c, x: xor(c >> 8, crc[(xor(c, x) & 255) + 1])), 4294967295) % 5 = 0 THEN other ELSE h END AS told FROM a, crc),
{LEVELS('t', 'l')},
s AS (SELECT '' AS tree, tree AS own, h, row_number() OVER (ORDER BY tree) - 1 AS i, count(*) OVER () AS n FROM t WHERE n = 1),
{LEVELS('u', 's')},
p AS ({UPS('l', 't')}), q AS ({UPS('s', 'u')}),
w AS (SELECT l.doc_id, l.h AS leaf, s.h AS subroot, (SELECT h FROM u WHERE n = 1) AS root, l.told, list_concat(coalesce(p.ups, []), coalesce(q.ups, [])) AS ups
  FROM l JOIN s ON s.own = l.tree LEFT JOIN p ON p.tree = l.tree AND p.i = l.i LEFT JOIN q ON q.i = s.i),
f AS (SELECT doc_id, leaf, subroot, root, sha256(replace(array_to_string(ups, ''), '#', '')) AS proof_sha256,
  list_reduce(list_prepend(told, ups), lambda acc, x: sha256(replace(x, '#', acc))) AS folded_root FROM w)
SELECT *, folded_root = root AS verified FROM f""",
    "op12_fill_in_middle": r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS w,
  sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
r AS (SELECT doc_id, text, w, len(w) AS n, list_transform([1, 9, 17, 25], lambda k: CAST('0x' || substring(h, k, 8) AS BIGINT)) AS h FROM d),
c AS (SELECT *, least(h[1] % (n + 1), h[2] % (n + 1)) AS a, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS b,
  CASE WHEN text = '' OR regexp_matches(text, '<[PSM]>') OR h[3] % 100 >= 50 THEN 'plain' WHEN h[4] % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM r),
x AS (SELECT *, array_to_string(w[1 : a], '') AS p, array_to_string(w[a + 1 : b], '') AS m, array_to_string(w[b + 1 : n], '') AS s FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(text) AS restored_sha256 FROM x""",
}
