"""Regulation texts made by Spark from the given tables, so that segmenting them must give the tables' rows back.

Each maker has the expected rows as SQL over the same tables, with no parsing on that side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import SPACE
from ..sources.tables import table

ORDER = ["l_returnflag", "l_linestatus", "l_shipdate", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber"]


def numeral(n: int) -> str:
    """Chinese numeral of 1 to 99."""
    digits = "一二三四五六七八九"
    tens, ones = divmod(n, 10)
    return ("" if tens == 0 else "十" if tens == 1 else digits[tens - 1] + "十") + (digits[ones - 1] if ones else "")


NUMERALS = [numeral(n) for n in range(1, 61)]
SQL_NUMERALS = "[" + ", ".join(f"'{x}'" for x in NUMERALS) + "]"

#: Rows of lineitem with their number in the order (i), chapter (c) and section (s) numbers; for both engines.
NUMBERED_SQL = f"""
n AS (SELECT l.*, row_number() OVER (PARTITION BY l_orderkey ORDER BY {", ".join(ORDER)}) AS i FROM lineitem l),
m AS (SELECT n.*, dense_rank() OVER (PARTITION BY l_orderkey ORDER BY l_returnflag) AS c,
             dense_rank() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY l_linestatus) AS s FROM n)"""


def numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = Window.partitionBy("l_orderkey")
    rows = table(spark, sf_dir, "lineitem").withColumn("i", F.row_number().over(by.orderBy(*ORDER)))
    rows = rows.withColumn("c", F.dense_rank().over(by.orderBy("l_returnflag")))
    return rows.withColumn("s", F.dense_rank().over(Window.partitionBy("l_orderkey", "l_returnflag").orderBy("l_linestatus")))


def cn(n) -> F.Column:
    return F.element_at(F.array(*(F.lit(x) for x in NUMERALS)), n)


def _document(rows: DataFrame, lines) -> DataFrame:
    return rows.groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", lines.alias("x")))), lambda s: s["x"]), "\n").alias("text"))


def regulations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """one regulation per order: chapters by return flag, sections by line status, an article per line of two lines,
    some with a citation of article one of the next law and some that supersede another one."""
    rows = numbered(spark, sf_dir)
    by = Window.partitionBy("l_orderkey").orderBy("i")
    new_chapter = F.coalesce(F.lag("c").over(by) != F.col("c"), F.lit(True))
    new_section = new_chapter | (F.lag("s").over(by) != F.col("s"))
    rows = rows.withColumn("_c", new_chapter).withColumn("_s", new_section)
    number = F.col("l_partkey").cast("string")
    body = F.concat(F.lit(" part "), number, F.lit(" ，"), F.when(F.col("l_partkey") % 7 == 0, F.concat(F.lit("依照《law"), F.col("l_suppkey").cast("string"), F.lit("》第一条，"))).otherwise(""))
    body = F.concat(body, F.when(F.col("l_partkey") % 11 == 0, F.concat(F.lit("《law"), F.col("l_suppkey").cast("string"), F.lit("》同时废止"))).otherwise(""))
    lines = F.concat_ws(
        "\n",
        F.when(F.col("_c"), F.concat(F.lit("第"), cn(F.col("c").cast("int")), F.lit("章 "), F.col("l_returnflag"))),
        F.when(F.col("_s"), F.concat(F.lit("第"), cn(F.col("s").cast("int")), F.lit("节 "), F.col("l_linestatus"))),
        F.concat(F.lit("第"), cn(F.col("i")), F.lit("条"), body),
        F.concat(F.lit("supplier "), F.col("l_suppkey").cast("string")),
    )
    return _document(rows, lines)


#: F1's articles: doc_id, label, chapter, section, body.
ARTICLES_SQL = f"""
{NUMBERED_SQL},
articles AS (
  SELECT l_orderkey AS doc_id, '第' || {SQL_NUMERALS}[i] || '条' AS label, l_suppkey, l_partkey, i,
         '第' || {SQL_NUMERALS}[c] || '章 ' || l_returnflag AS chapter, '第' || {SQL_NUMERALS}[s] || '节 ' || l_linestatus AS section,
         'part ' || l_partkey || ' ，' || CASE WHEN l_partkey % 7 = 0 THEN '依照《law' || l_suppkey || '》第一条，' ELSE '' END
         || CASE WHEN l_partkey % 11 = 0 THEN '《law' || l_suppkey || '》同时废止' ELSE '' END || chr(10) || 'supplier ' || l_suppkey AS body
  FROM m)"""


def clauses(spark: SparkSession, sf_dir: str, fragmented: bool = False) -> DataFrame:
    """chapter ``n flag``, clauses ``n.i heading`` with a text line; fragmented: numbers broken as ``n.`` / ``i heading``."""
    rows = numbered(spark, sf_dir)
    by = Window.partitionBy("l_orderkey").orderBy("i")
    number = lambda c: F.col(c).cast("string")
    head = F.when(F.coalesce(F.lag("c").over(by) != F.col("c"), F.lit(True)), F.concat(number("c"), F.lit(" flag "), F.col("l_returnflag")))
    joint = F.lit(".\n" if fragmented else ".")
    clause = F.concat(number("c"), joint, number("i"), F.lit(" part "), number("l_partkey"))
    rows = rows.withColumn("_x", F.concat_ws("\n", head, clause, F.concat(F.lit("weight "), number("l_suppkey"), F.lit(" and more"))))
    return _document(rows, F.col("_x"))


#: Labels of the header block, and the kind of value that follows each. Fixed values.
LABELS = {
    "record_id": ("【法宝引证码】", "id"),
    "issuer": ("制定机关：", "text"),
    "number": ("发文字号：", "text"),
    "published": ("公布日期：", "date"),
    "effective": ("施行日期：", "date"),
    "status": ("时效性：", "text"),
    "level": ("效力位阶：", "text"),
    "category": ("法规类别：", "text"),
    "url": ("原文链接：", "address"),
}
#: What a value of each kind is made of.
KINDS = {"text": "[^\n]+", "date": "[0-9./-]+", "id": "[A-Za-z0-9.]+", "address": "https?://[^ \t\n]+"}
FIELDS = {name: f"{label}[ \t\n]*({KINDS[kind]})" for name, (label, kind) in LABELS.items()}


def headed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """a title, a file name, and a text of body, labelled block and footer for each order."""
    rows = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    key, date = F.col("o_orderkey").cast("string"), F.date_format("o_orderdate", "yyyy.M.d")
    name = F.concat(F.lit("第"), key, F.lit("号"), F.when(F.col("o_orderkey") % 3 == 0, "条例").when(F.col("o_orderkey") % 3 == 1, "管理办法").otherwise("通知"))
    block = F.concat(
        F.lit("制定机关："), F.col("c_name"), F.lit("\n发文字号："), key, F.lit("\n公布日期："), date, F.lit("\n时效性："), F.col("o_orderstatus"), F.lit("\n效力位阶："), F.col("o_orderpriority"),
        F.lit("\n法规类别："), F.col("c_mktsegment"), F.lit("\n【法宝引证码】CLI."), key,
    )
    return rows.select(
        F.col("o_orderkey").alias("doc_id"), "o_orderpriority", "o_orderstatus", "o_orderdate", "c_name", "c_mktsegment",
        F.concat(F.lit("华东地区：《"), name, F.lit("》")).alias("title"), name.alias("name"),
        F.concat(F.lit("/archive/"), name, F.lit("(FBMCLI."), key, F.lit(").pdf")).alias("file"),
        F.concat(name, F.lit("\n 正文 "), F.col("c_mktsegment"), F.lit("\n"), block, F.lit("\n"), F.lit("第一条 "), F.col("c_name"), F.lit("\n第一条 "), F.col("c_name"), F.lit("\n\n1/3\n末行\n"), F.lit("法宝快讯 more")).alias("text"),
    )


HEADED_SQL = """
h AS (SELECT o_orderkey AS doc_id, '第' || o_orderkey || '号' || CASE o_orderkey % 3 WHEN 0 THEN '条例' WHEN 1 THEN '管理办法' ELSE '通知' END AS name,
             strftime(o_orderdate, '%Y-%m-%d') AS published, o_orderpriority, o_orderstatus, o_orderdate, c_name, c_mktsegment
      FROM orders JOIN customer ON o_custkey = c_custkey)"""


#: Letters that pages have as named references.
REFERENCES = {"&": "&amp;", "<": "&lt;", ">": "&gt;", "é": "&eacute;", "ü": "&uuml;", "ß": "&szlig;", "ñ": "&ntilde;", "ç": "&#231;", "è": "&#xE8;"}


def referenced(text):
    for letter, name in REFERENCES.items():
        text = F.replace(text, F.lit(letter), F.lit(name))
    return text


def marked_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    """a page for each document, its lines as paragraphs of an article, unclosed ones in every second page and the
    first of them in an article of its own, among scripts, comments, a menu and a footer that are no paragraphs; signs
    of tags in quoted attributes, letters as references."""
    paragraph = lambda x: F.concat(F.lit('<p class="x" title="1 > 0 </article>">'), referenced(x), F.when(F.col("doc_id") % 2 == 0, "</p>").otherwise(""))
    body = F.array_join(F.transform(F.split("text", "\n"), lambda x, i: F.when(i == 0, F.concat(F.lit("<article id=inner>"), paragraph(x), F.lit("</article>"))).otherwise(paragraph(x))), "")
    page = F.concat(
        F.lit('<!DOCTYPE html><html><head><title>t</title><style>p{a:b}</style><script>if(a<b){x="<p>no</p>";}</script></head><body data-a=\'>\'><NAV>menu</NAV><!-- <p>no</p> --><article>'), body,
        F.lit("</article><noscript><p>no</p></noscript><footer>&copy; &#72;&#x65;re</footer></body></html>"),
    )
    return table(spark, sf_dir, "documents").select("doc_id", page.alias("html"))


def portal_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """a portal's page for each document: its listed title twice, a date, its lines, of every third one the later
    ones as articles, and notices of the portal; the container is named by its class."""
    lines = F.transform(F.split("text", "\n"), lambda x, i: F.concat(F.when((F.col("doc_id") % 3 == 0) & (i == 1), "第二条 ").otherwise(""), referenced(x)))
    title = F.concat(F.lit("华东地区：《规定"), F.col("doc_id").cast("string"), F.lit("》"))
    page = F.concat(
        F.lit("<body><div><span>2024-5-6</span> <span> 2024-05-06 </span><span>2024-05-07</span></div><div class='wide view'><div><h1>"), title, F.lit("</h1></div><div>分享</div>"),
        F.lit("<p>"), F.array_join(lines, "<br>"), F.lit("<p>"), title, F.lit("</p><div>下载：x</div></div><p>footer</body>"),
    )
    return table(spark, sf_dir, "documents").select("doc_id", page.alias("html"))


PAGE_LINES = 12


def printed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """a document's lines on pages of PAGE_LINES (doc_id, page, pos, line), with a head, a page number under it, and at
    the foot one or two lines; contents, Roman numbers, captions and the title in between."""
    number = F.col("page").cast("string")
    lines = F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")
    chunk = F.slice("lines", F.col("page") * PAGE_LINES + 1, PAGE_LINES)
    page = F.concat(
        F.array(F.concat(F.lit("Standard "), F.col("doc_id").cast("string"), F.lit(" page "), number), F.concat(F.lit("- "), number, F.lit(" -"))),
        F.when(F.col("page") % 3 == 0, F.array(F.lit("4.1 Scope ........ 2"), F.lit(" The title "), F.lit("Figure 3 x"))).otherwise(F.array().cast("array<string>")),
        chunk, F.when(F.col("page") % 2 == 0, F.array(F.lit("Ⅻ"))).otherwise(F.array(F.lit(" "))),
        F.array(F.lit("12345"), F.lit("77")), F.array(F.concat(F.lit("ISSN 2020 "), number), F.concat(number, F.lit(" of all"))),
    )
    rows = table(spark, sf_dir, "documents").select("doc_id", lines.alias("lines"))
    rows = rows.select("doc_id", "lines", F.explode(F.sequence(F.lit(0), F.floor(F.greatest(F.size("lines") - 1, F.lit(0)) / PAGE_LINES).cast("int"))).alias("page"))
    return rows.select("doc_id", "page", F.posexplode(page).alias("pos", "line"))


_LINES = f"list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(regexp_replace(x, '[{SPACE}]+', ' ', 'g'), '^ +| +$', '', 'g')), lambda x: x <> '')"
#: F5's lines: ps are an article's paragraphs, ls what the page's paragraphs are.
MARKED_SQL = f"""
p AS (SELECT doc_id, {_LINES} AS ps FROM documents),
l AS (SELECT doc_id, ps, CASE WHEN coalesce(list_sum(list_transform(ps, lambda x: length(x))), 0) > 200 THEN ps ELSE list_concat(list_concat(['menu'], ps), ['© Here']) END AS ls FROM p)"""
