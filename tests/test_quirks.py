"""Hand-written cases for behaviour that a naive version gets wrong."""

import pytest
from pyspark.sql import functions as F

from lexmill.functions import text as X
from lexmill.operators import classify, merge, segment


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(
    ("numeral", "number"),
    [("一", 1), ("十", 10), ("二十五", 25), ("一百二十八", 128), ("四百五十二", 452), ("一千零三", 1003), ("两百", 200), ("", None), ("甲", None), ("十x", None), (None, None)],
)
def test_numerals(spark, numeral, number):
    assert value(spark, X.article_number(F.lit(numeral))) == number


def test_white_space_is_unicode(spark):
    assert value(spark, X.strip(F.lit("　a b "))) == "a b"
    assert value(spark, X.squash_ws(F.lit(" 　\n"))) is None


@pytest.mark.parametrize(("raw", "date"), [("2024.1.5", "2024-01-05"), ("2024-11-5起", "2024-11-05"), (" 2025-07 ", "2025-07"), ("", ""), (None, None)])
def test_dates(spark, raw, date):
    assert value(spark, X.norm_date(F.lit(raw).cast("string"))) == date


def test_names(spark):
    assert value(spark, X.safe_name(F.lit(' a/b:c?"'))) == "a_b_c__"
    assert value(spark, X.safe_name(F.lit("  "))) == "file"
    assert value(spark, X.name_key(F.lit("《中华人民共和国 民法典》（2020）"), "full")) == "民法典"
    assert value(spark, X.repair_numbers(F.lit("5.\n2.\n2 and 0.\n25kg"))) == "5.2.2 and 0.25kg"


def lines(spark, *texts):
    return spark.createDataFrame([(1, i, t) for i, t in enumerate(texts)], "doc_id int, pos int, line string")


def test_articles(spark):
    rows = lines(spark, "前言", "第一章 总则", "第一节 甲", "第 一 条　正文", "续行", "第二章 乙", "掉落", "第二条 再", "第九十二点", "第 92.1 条 数字", "第三条")
    found = [(r["chapter"], r["section"], r["label"], r["body"]) for r in segment.parse_articles(rows).orderBy("art_pos").collect()]
    assert found[0] == ("第一章 总则", "第一节 甲", "第一条", "正文\n续行")
    by_label = {r[2]: r for r in found}
    assert by_label["第二条"] == ("第二章 乙", None, "第二条", "再\n第九十二点")
    assert by_label["第92.1条"][3] == "数字" and "第三条" not in by_label


def test_citations_stay_inside(spark):
    rows = spark.createDataFrame([(1, 0, "第四条 甲引用第二条的第五条 乙"), (1, 1, "第七条 见第九条"), (1, 2, "无")], "doc_id int, pos int, para string")
    found = [r["para"] for r in segment.presplit_paras(rows, "doc_id", "pos", "para").orderBy("pos", "part").collect()]
    assert found == ["第四条 甲引用第二条的", "第五条 乙", "第七条 见第九条", "无"]


def test_fragments_and_text(spark):
    rows = lines(spark, "5.", "2.", "2.", "1 标题", "70.", "1 dB", "3 术语", "文字", "4.", "文")
    found = [(r["number"], r["title"]) for r in segment.assemble_numbers(rows).orderBy("pos").collect()]
    assert found == [("5.2.2.1", "标题"), (None, "70."), ("1", "dB"), ("3", "术语"), (None, "文字"), (None, "4."), (None, "文")]


def test_guarded_clauses(spark):
    rows = lines(spark, "1 范围", "70.1 dB", "1.1 甲", "3 跳", "2 术语", "1.2 旧", "2.1 新", "3 句子。", "3 完")
    found = [(r["pos"], r["kind"]) for r in segment.guarded_clauses(rows, stop_chapter=3).orderBy("pos").collect()]
    assert found == [(0, "chapter"), (1, "text"), (2, "clause"), (3, "text"), (4, "chapter"), (5, "clause"), (6, "clause"), (7, "text")]


def test_empty_key_never_repeats(spark):
    rows = spark.createDataFrame([(1, ""), (2, ""), (3, None), (4, "a"), (5, "a")], "id int, key string")
    kept, excluded = merge.priority_dedup(rows, "key", ["id"])
    assert {r["id"] for r in kept.collect()} == {1, 2, 3, 4} and [r["id"] for r in excluded.collect()] == [5]


def test_adjacent_lines(spark):
    text = "效力位阶：x\n甲\n甲\n\n甲\n1/3\n乙 引用本篇 z"
    body = classify.clean_body(spark.createDataFrame([(text,)], "t string"), "t", ["专题分类：", "效力位阶："], ["法宝快讯", "引用本篇"], lambda x: x.rlike(r"^\s*[0-9]+/[0-9]+\s*$")).first()["body"]
    assert body == "甲\n\n甲\n乙"


def test_empty_string_counts_as_missing(spark):
    rows = spark.createDataFrame([("", "b"), (None, "c"), ("a", "d")], "x string, y string")
    assert [r["z"] for r in classify.coalesce_meta(rows, {"z": [F.col("x"), F.col("y")]}).collect()] == ["b", "c", "a"]


def paragraphs(spark, html, mode="auto", containers=("article", "main")):
    from lexmill.sources.html import page_paragraphs

    return value(spark, page_paragraphs(F.lit(html).cast("string"), mode, containers))


LONG = "word " * 60


@pytest.mark.parametrize(
    ("html", "mode", "found"),
    [
        ("<body><p>one<p>two<br>lines</p>loose<div>block</div><p> </p><p>three <b>bold</b></body>", "p", ["one", "two lines", "three bold"]),
        ("<p>a<div>no</div>b<P CLASS='x'>c</P>", "p", ["a", "c"]),
        ("<body><script>x='<p>no</p>'</script><style><p>no</style><noscript><p>no</p></noscript><!-- <p>no --><p>&lt;b&gt; &amp;amp; &#20013;&#x6587; &copy;</p>", "p", ["<b> &amp; 中文 ©"]),
        (f"<body><nav>menu</nav><article><p>{LONG}<p>x</article><p>after</p></body>", "auto", [LONG.strip(), "x"]),
        ("<body><nav>menu</nav><article><p>short</article><p>after</body>", "auto", ["menu", "short", "after"]),
        (f"<body><main>{LONG}<span>more</span></main></body>", "auto", [LONG.strip(), "more"]),
        (f"<body><article>{LONG}<br>end\nline", "lines", [LONG.strip(), "end", "line"]),
        (f'<article title="a > b">{LONG}<article>inner<p>in</article>rest &eacute;&notin;&amp;lt; &copy 2</article>after', "lines", [LONG.strip(), "inner", "in", "rest é∉&lt; © 2"]),
        ("<p title='x > y'>a<p a=\"b>c</p>d\">e</p><p x=it's>f<p a=\"open>g</p>", "p", ["a", "e", "f", "g"]),
        ("<script>if(a<b){x='</p>'}</script><p>a<!-- > <p>b --><b>c</b> < d<p>e", "p", ["a c < d", "e"]),
        ("<p>unclosed <b>tag", "p", ["unclosed tag"]), ("", "auto", []), (None, "p", []), ("no tags at all", "auto", ["no tags at all"]),
    ],
)
def test_pages(spark, html, mode, found):
    assert paragraphs(spark, html, mode) == found


@pytest.mark.parametrize(
    ("selector", "found"),
    [("#zoom", ["id"]), (".view", ["class", "nested"]), ("div.view", ["class", "nested"]), ("p.view", ["all"]), (".vie", ["all"]), ("section", ["all"]), ("#ZOOM", ["all"])],
)
def test_containers_by_selector(spark, selector, found):
    html = "<body><div id=zoom>id</div><div class='wide view'>class<div>nested</div></div>last</body>"
    assert paragraphs(spark, html, "auto", [selector]) == ["id", "class", "nested", "last"]  # none has enough text
    long = html.replace("id<", f"id{LONG}<").replace("nested", f"nested{LONG}")
    whole = [x.replace("id", f"id{LONG}".strip()).replace("nested", f"nested{LONG}".strip()) for x in (["id", "class", "nested", "last"] if found == ["all"] else found)]
    assert paragraphs(spark, long, "auto", [selector]) == whole


def test_tags_are_read_in_linear_time():
    import time

    from lexmill.sources.html import Page

    for html in ("<p a='" * 20_000, "<" * 100_000, "<!--" * 50_000, "<script>" * 3000, '<p a="b" c=\'' * 20_000, "<article>" * 20_000):
        began = time.time()
        page = Page(html)
        page.lines(*page.container(["article"], 0))
        assert time.time() - began < 5


def test_article_body(spark):
    from lexmill.sources.html import article_body

    pages = [
        (1, "<i>2024-01-02</i><article>Title<p>Share this<p>第一条 a<p>《Title》<p>all rights reserved"), (2, "<article><h1>华东地区：《Title》</h1><p>text<p>《Title》 again</p><p>《half</article><p>out<i> 2023-10-01\n</i><i>2020-01-01"),
        (3, None), (4, "<article>on 2024-01-02</article>"),
    ]
    found = article_body(spark.createDataFrame(pages, "id int, html string"), "id", "html", "(?i)^share", "(?i)all rights reserved")
    got = [(r["id"], r["date"], r["para"]) for r in found.orderBy("id", "pos").collect()]
    assert got == [(1, "2024-01-02", "第一条 a"), (1, "2024-01-02", "《Title》"), (2, "2023-10-01", "text"), (2, "2023-10-01", "《half"), (4, None, "on 2024-01-02")]


def test_bytes_in_other_encodings(spark):
    from lexmill.sources.html import decode_pages

    rows = [(1, "中文".encode()), (2, "中文".encode("gb18030")), (3, b"\xff\xfe\xff"), (4, None), (5, b"")]
    found = decode_pages(spark.createDataFrame(rows, "id int, raw binary"), "raw").orderBy("id").collect()
    assert [(r["text"], r["encoding"]) for r in found] == [("中文", "utf-8"), ("中文", "gb18030"), ("���", "lossy"), (None, None), ("", "utf-8")]


def test_texts_without_lines_of_labels(spark):
    rows = [(1, None), (2, "无"), (3, "通知如下：第一条 甲。第二条 乙。"), (4, "第一条 甲\n续"), (5, "")]
    found = segment.split_or_fulltext(spark.createDataFrame(rows, "doc_id int, text string"), "doc_id", "text").orderBy("doc_id", "art_pos").collect()
    assert [(r["doc_id"], r["label"], r["body"]) for r in found] == [(1, None, None), (2, None, "无"), (3, "第一条", "第一条 甲。"), (3, "第二条", "第二条 乙。"), (4, "第一条", "甲\n续"), (5, None, "")]


def test_rows_in_force(spark):
    rows = [(1, "现行有效(2026版)", "2000-01-01"), (2, "已废止/被取代", "2000-01-01"), (3, "已修改", "2000-01-01"), (4, "现行有效", "2030-01-01"), (5, None, None)]
    frame = spark.createDataFrame(rows, "id int, s string, d string").withColumn("d", F.col("d").cast("timestamp"))
    assert sorted(r["id"] for r in classify.current_only(frame, "s", "d", "2024-01-01").collect()) == [1, 5]
    assert [r["validity"] for r in classify.validity(frame, "s", "d", "2024-01-01").orderBy("id").collect()] == ["现行有效", "已废止", "已修改", "未生效", "现行有效"]


def test_title_cut_and_paragraphs(spark):
    from lexmill.plans.intake import ANCHORS, FOOTERS, noise_line, paragraph_start, sentence_end

    text = "效力位阶：x\n人工智能\n某某市人工智能产业条例\n第一条 为了\n促进发展。\n（一）甲\n下载日期：1\n乙\n*注：本文格式 z"
    rows = spark.createDataFrame([(1, text, "某某市人工智能产业条例《x》"), (2, text, None), (3, text, "没有这个"), (4, None, "x")], "id int, t string, title string")
    found = classify.clean_body(rows, "t", ANCHORS, FOOTERS, noise_line, "title", paragraph_start, sentence_end).orderBy("id").collect()
    rest = "某某市人工智能产业条例\n第一条 为了促进发展。\n（一）甲乙"
    assert [r["body"] for r in found] == [rest, "人工智能" + rest, "人工智能" + rest, None]


def test_prefixes_and_containment_against_all_pairs(spark):
    import random

    rng = random.Random(3)
    names = lambda n: [None, ""] + ["中华人民共和国" + "".join(rng.choice("甲乙丙") for _ in range(rng.randint(0, 7))) for _ in range(n)] + ["".join(rng.choice("甲乙") for _ in range(rng.randint(1, 7))) for _ in range(n)]
    new, old = names(60), names(30)
    left, right = (spark.createDataFrame([(x,) for x in xs], "k string") for xs in (new, old))
    long = lambda x: len(x) >= 5
    match = lambda a, b: a is not None and b and (long(b) and a.startswith(b) or long(a) and b.startswith(a))
    kept = [a for a in new if not any(match(a, b) for b in old)]
    assert sorted(r["k"] or "" for r in merge.prefix_match_dedup(left, right, "k").collect()) == sorted(a or "" for a in kept)
    holds = lambda a, b: a is not None and b and (a == b or b in a and long(b) or a in b and long(a))
    found = {(r["k"], r["contained"]) for r in merge.containment_flag(left, right, "k").collect()}
    assert found == {(a, any(map(bool, (holds(a, b) for b in old)))) for a in new}


def test_long_runs_of_labels(spark):
    labels = "".join(f"第{n}条 x" for n in ["一", "三", "二", "九", "三", "四"])
    rows = spark.createDataFrame([(1, 0, labels)], "doc_id int, pos int, para string")
    assert [r["para"] for r in segment.presplit_paras(rows, "doc_id", "pos", "para").orderBy("part").collect()] == ["第一条 x第三条 x", "第二条 x第九条 x", "第三条 x", "第四条 x"]


@pytest.mark.parametrize(
    ("line", "starts"),
    [("第一条 x", True), ("　x", True), (" 第12章", True), ("（三）x", True), ("(12)x", True), ("四、x", True), ("5.x", True), ("5．x", True), ("第x条", False), ("第 一条", False), ("（甲）", False), ("一x", False), ("12x", False), ("第一", False), ("x第一条", False), ("", False)],
)
def test_first_characters_of_paragraphs(spark, line, starts):
    from lexmill.plans.intake import paragraph_start

    assert value(spark, paragraph_start(F.lit(line))) == starts


@pytest.mark.parametrize(("html", "text"), [("<p>one two</p><p>three</p>", "one two three"), ("a<script >x</p></script\n>b<style>y</style> ", "a b"), ("　a\n\n<br>b", "a b"), ("", ""), (None, None)])
def test_visible_text(spark, html, text):
    assert value(spark, X.visible_text(F.lit(html).cast("string"))) == text


def test_notes_of_excluded_rows(spark):
    rows = spark.createDataFrame([(1, "a", "x"), (2, "a", None), (3, "a", "y"), (4, "", "z")], "id int, key string, note string")
    kept, excluded = merge.priority_dedup(rows, "key", ["id"], "note", "[again] ")
    assert {(r["id"], r["note"]) for r in kept.collect()} == {(1, "x"), (4, "z")}
    assert {(r["id"], r["note"]) for r in excluded.collect()} == {(2, "[again] "), (3, "[again] y")}


def test_sections_in_order(spark):
    from lexmill.operators import report

    rows = spark.createDataFrame([("b", True), ("a", None), ("a", False), (None, True), ("c", True)], "s string, stored boolean")
    found = [tuple(r) for r in report.totals_by_section(rows, "s", ["c", "none", "b"], F.col("stored")).collect()]
    assert found == [("c", 1, 1, 0, 1), ("b", 1, 1, 0, 2), ("a", 2, 0, 2, 3), (None, 1, 1, 0, 4), ("total", 5, 3, 2, 5)]
    assert report.totals_by_section(rows.where("false"), "s").count() == 0
