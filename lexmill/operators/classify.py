"""Gates and classification by ordered rules. A rule that comes first wins, as in a CASE expression."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import SPACE, has_any, strip
from ..sources.tables import written

#: A condition on a line.
LineTest = Callable[[Column], Column]
#: Numerals that an attachment may be counted by.
HAN_DIGITS = "一二三四五六七八九十"
#: White space that may stand before a line's first sign.
BLANKS = " \t\r\n\x0b\x0c\xa0\u2002\u2003\u2009\u3000"


def payload_gate(df: DataFrame, status: str, n_bytes: str, starts_ok: Column, min_bytes: int = 3072) -> DataFrame:
    """Add ok and reason; the first failing test gives the reason."""
    reason = (
        F.when(F.col(status) != 200, F.concat(F.lit("status "), F.col(status).cast("string")))
        .when(F.col(n_bytes) <= min_bytes, F.concat(F.lit("size "), F.col(n_bytes).cast("string")))
        .when(~starts_ok, F.lit("wrong type"))
    )
    return df.withColumn("reason", reason).withColumn("ok", reason.isNull())


def keyword_gate(df: DataFrame, text: str, keywords: Sequence[str], min_chars: int = 200) -> DataFrame:
    ok = (F.length(text) >= min_chars) & has_any(text, keywords)
    return df.withColumn("ok", F.coalesce(ok, F.lit(False)))


def article_count_verdict(df: DataFrame, text: str, keyword: str, min_articles: int = 3, numerals: str = "一二三四五六七八九十百千零〇两") -> DataFrame:
    """Add n_articles and verdict: OK with the keyword and enough article labels, else SUSPECT."""
    n = F.regexp_count(text, F.lit(f"第[{numerals}]+条"))
    return df.withColumn("n_articles", n).withColumn("verdict", F.when(F.col(text).contains(keyword) & (n >= min_articles), "OK").otherwise("SUSPECT"))


@dataclass(frozen=True)
class LevelRules:
    """Names of legal levels and title words that decide on admission."""

    strong: Sequence[str]
    soft: Sequence[str]
    drop: Sequence[str]
    work: str
    title_words: Sequence[str]
    noise_words: Sequence[str]


def decide_keep(df: DataFrame, level: str, name: str, has_article: str, rules: LevelRules) -> DataFrame:
    """Add keep and reason: noise titles out, strong levels in, dropped levels out, work documents with an article in,
    soft levels with an article or a structured title in, unknown levels with both in."""
    lvl, title, article = F.coalesce(strip(level), F.lit("")), F.coalesce(name, F.lit("")), F.col(has_article)
    structured = has_any(title, rules.title_words)
    yes, no = (lambda r: F.struct(F.lit(True).alias("keep"), r.alias("reason"))), (lambda r: F.struct(F.lit(False).alias("keep"), r.alias("reason")))
    verdict = (
        F.when(has_any(title, rules.noise_words), no(F.lit("noise title")))
        .when(lvl.isin(*rules.strong), yes(F.lit("strong level")))
        .when(lvl.isin(*rules.drop), no(F.concat(F.lit("dropped level: "), lvl)))
        .when((lvl == rules.work) & article, yes(F.lit("work document with article")))
        .when(lvl == rules.work, no(F.lit("work document")))
        .when(lvl.isin(*rules.soft) & (article | structured), yes(F.lit("structured soft level")))
        .when(lvl.isin(*rules.soft), no(F.lit("unstructured soft level")))
        .when(article & structured, yes(F.lit("structured, level unknown")))
        .otherwise(no(F.concat(F.lit("level unknown: "), F.when(lvl == "", "none").otherwise(lvl))))
    )
    return df.withColumn("_v", verdict).select(*df.columns, "_v.keep", "_v.reason")


#: Levels that words of a law's name tell, in order, and the level of all others. Fixed values.
TITLE_LEVELS = [
    ("地方性法规", ["条例"]),
    ("地方政府规章/规范性文件", ["办法", "规定", "规则", "细则"]),
    ("规范性文件", ["公告", "通知", "方案", "预案", "意见", "通告", "函"]),
]
OTHER_LEVEL = "地方规范性文件"


def parse_title(df: DataFrame, title: str, levels: Sequence[tuple[str, Sequence[str]]] = TITLE_LEVELS, other: str = OTHER_LEVEL) -> DataFrame:
    """Add region, law_name and law_level from ``region：《name》``: the region is what stands before the first colon, if
    it has 2 to 12 characters; the name is the first quoted one, else what follows the region."""
    parts = F.split(F.col(title), "[：:]", 2)
    before = F.get(parts, F.lit(0))
    has_region = (F.size(parts) == 2) & F.length(before).between(2, 12)
    rest = F.btrim(F.when(has_region, F.get(parts, F.lit(1))).otherwise(F.col(title)), F.lit("《》 "))
    quoted = F.regexp_substr(F.col(title), F.lit("《[^》]+》"))
    out = df.withColumn("region", F.when(has_region, before).otherwise(F.when(F.col(title).isNotNull(), "")))
    out = out.withColumn("law_name", F.coalesce(F.btrim(quoted, F.lit("《》")), rest))
    level = F.lit(other)
    for name, words in reversed(levels):
        level = F.when(has_any("law_name", words), name).otherwise(level)
    return out.withColumn("law_level", level)


def title_rules(df: DataFrame, title: str, rules: Mapping[str, str]) -> DataFrame:
    """A boolean column for each named pattern."""
    return df.withColumns({name: F.col(title).rlike(pattern) for name, pattern in rules.items()})


def strict_admission(df: DataFrame, tests: Sequence[tuple[str, Column]]) -> DataFrame:
    """Add skip_reason: the first test that holds, null for admitted rows; each row counts under one reason."""
    reason = F.lit(None).cast("string")
    for name, test in reversed(tests):
        reason = F.when(test, name).otherwise(reason)
    return df.withColumn("skip_reason", reason)


def triage_status(df: DataFrame, noise: DataFrame, known: DataFrame, key: str, draft: Column) -> DataFrame:
    """Add status: noise ids, known duplicates, drafts, and the rest, in this order."""
    out = df.join(noise.select(key).distinct().withColumn("_noise", F.lit(True)), key, "left").join(known.select(key).distinct().withColumn("_known", F.lit(True)), key, "left")
    status = F.when(F.col("_noise"), "建议剔除").when(F.col("_known"), "已入库(重复)").when(draft, "待定").otherwise("待chunk")
    return out.withColumn("status", status).drop("_noise", "_known")


def doc_type(df: DataFrame, record_id: str, archive: str) -> DataFrame:
    """Add doc_type: a case by its id's prefix or its archive's name, else a regulation."""
    case = F.coalesce(F.col(record_id).rlike(r"^CLI\.C\."), F.lit(False)) | F.coalesce(F.col(archive).contains("案例"), F.lit(False))
    return df.withColumn("doc_type", F.when(case, "案例").otherwise("法规"))


def content_origin(df: DataFrame, body_len: str, att_bytes: str, online_len: str, has_attachment: str) -> DataFrame:
    """Add origin: own body from 200 characters, attachments from 2048 bytes, online text from 300, else a shell."""
    size = lambda c: F.coalesce(F.col(c), F.lit(0))
    origin = (
        F.when(size(body_len) >= 200, "body").when(size(att_bytes) >= 2048, "attachment").when(size(online_len) >= 300, "online")
        .when(F.col(has_attachment), "shell with attachment").otherwise("shell")
    )
    return df.withColumn("origin", origin)


def stub_probe(df: DataFrame, text: str, marker: str, article: str, flags: Mapping[str, str], most: int = 3000) -> DataFrame:
    stub = F.col(text).contains(marker) & ~F.col(text).rlike(article) & (F.length(text) < most)
    return df.withColumn("stub", stub).withColumns({n: F.col(text).contains(m) for n, m in flags.items()})


def decode_status(df: DataFrame, code: str, codes: DataFrame) -> DataFrame:
    """Add status_text from (code, text) rows; an unknown code passes through."""
    names = F.broadcast(codes.select(F.col("code").alias("_code"), F.col("text").alias("_text")))  # a rule table
    return df.join(names, F.col(code) == F.col("_code"), "left").withColumn("status_text", F.coalesce("_text", code)).drop("_code", "_text")


IN_FORCE = "现行有效"


def current_only(df: DataFrame, status: str, effective: str, as_of: str) -> DataFrame:
    """Rows in force on the day, with their validity. Other states (已废止, 已修改, 未生效) go; ``validity`` tells them."""
    return validity(df, status, effective, as_of).where(F.col("validity") == IN_FORCE)


def validity(df: DataFrame, status: str, effective: str, as_of: str) -> DataFrame:
    """Add validity from a free-form status and the day of effect; a null status counts as in force."""
    s = F.coalesce(F.col(status), F.lit(""))
    state = (
        F.when(s.contains("废止"), "已废止").when(s.contains("修改") | s.contains("取代"), "已修改")
        .when(s.contains("未生效") | (F.col(effective) > F.lit(as_of).cast("timestamp")), "未生效").otherwise(IN_FORCE)
    )
    return df.withColumn("validity", state)


def lookup_by_keyword(df: DataFrame, name: str, rules: Sequence[tuple[str, str]], value: str, default: str) -> DataFrame:
    """Add the value of the first (keyword, value) rule whose keyword the name contains, else the default, which null
    names get too. One expression in the row: no join, and no key is needed."""
    found = F.lit(default)
    for keyword, result in reversed(rules):
        found = F.when(F.col(name).contains(keyword), result).otherwise(found)
    return df.withColumn(value, found)


def coalesce_meta(df: DataFrame, fields: Mapping[str, Sequence[Column]]) -> DataFrame:
    """Per field the first value that is neither null nor empty."""
    return df.withColumns({name: F.coalesce(*(F.nullif(c.cast("string"), F.lit("")) for c in values)) for name, values in fields.items()})


def clean_body(
    df: DataFrame, text: str, anchors: Sequence[str], footers: Sequence[str], noise: LineTest, title: str | None = None, starts: LineTest | None = None, ends: LineTest | None = None
) -> DataFrame:
    """Add body: the text after the line of the first anchor present, up to the earliest footer, without noise lines and
    without a non-blank line that equals the one kept before it; blank lines break a run.

    Where the first eight characters of the title, quoted names aside, come within 60 characters, what stands before
    them goes. With ``starts`` and ``ends`` the lines of a paragraph are joined, as ``dewrapped`` does.
    """
    after = F.col(text)
    for anchor in reversed(anchors):
        found = F.regexp_extract(text, f"(?s){anchor}[^\\n]*\\n(.*)$", 1)
        after = F.when(F.col(text).rlike(f"{anchor}[^\\n]*\\n"), found).otherwise(after)
    out = df.withColumn("_after", after)
    marks = [F.nullif(F.locate(f, F.col("_after")), F.lit(0)) for f in footers]
    cut = F.least(F.length("_after") + 1, *marks)  # nulls do not count
    lines = F.filter(F.split(F.substring(F.col("_after"), F.lit(1), cut - 1), "\n"), lambda x: ~noise(x))
    out = out.withColumn("_lines", lines)
    same = lambda x, i: (strip(x) != "") & (i > 0) & F.coalesce(strip(x) == strip(F.get("_lines", i - 1)), F.lit(False))
    out = out.withColumn("body", strip(F.array_join(F.filter("_lines", lambda x, i: ~same(x, i)), "\n")))
    if title is not None:
        probe = F.substring(F.regexp_replace(F.col(title), "《[^》]*》", ""), 1, 8)
        at = F.coalesce(F.when(probe != "", F.position(probe, F.col("body"))), F.lit(0))
        out = out.withColumn("body", F.when(at.between(2, 61), F.substring(F.col("body"), at, F.length("body"))).otherwise(F.col("body")))
    if starts is not None:
        out = out.withColumn("body", dewrapped(F.col("body"), starts, ends))
    return out.drop("_after", "_lines")


def head_number(line: Column, numerals: str) -> tuple[Column, Column]:
    """Whether a line begins with numerals, and the character after them."""
    rest = F.ltrim(line, F.lit(numerals))
    return F.length(rest) < F.length(line), F.substring(rest, 1, 1)


def starts_paragraph(line: Column, numerals: str, digits: str, units: str, points: str) -> Column:
    """Whether a line opens a paragraph, by its first characters: it is indented by a wide space, or begins with a label
    (第, a number, a unit), a number in brackets, a number and 、, or digits and a point."""
    text = F.ltrim(line, F.lit(BLANKS))
    rest = F.substring(text, F.lit(2), F.length(text))
    labelled, unit = head_number(rest, numerals + digits)
    counted, mark = head_number(text, numerals)
    numbered, point = head_number(text, digits)
    return (
        line.startswith("\u3000")
        | (text.startswith("第") & labelled & unit.isin(*units))
        | (F.substring(text, 1, 1).isin("（", "(") & labelled & unit.isin("）", ")"))
        | (counted & (mark == "、"))
        | (numbered & point.isin(*points))
    )


def ends_sentence(line: Column, marks: str) -> Column:
    return F.substring(line, -1, 1).isin(*marks)


def dewrapped(text: Column, starts: LineTest, ends: LineTest) -> Column:
    """The text with the lines of each paragraph joined: a line joins the one before unless it starts a paragraph or that
    one ends a sentence; blank lines go. Only raw neighbours matter, so each line decides for itself, in its row.
    ``starts`` is asked of lines as they stand, ``ends`` of trimmed ones."""
    lines = F.filter(F.transform(F.split(text, "\r\n|\r|\n"), lambda x: F.struct(x.alias("line"), strip(x).alias("text"))), lambda s: s["text"] != "")
    marked = F.transform(lines, lambda s: F.struct(s["text"].alias("text"), starts(s["line"]).alias("starts"), ends(s["text"]).alias("ends")))

    def joined(rows: Column) -> Column:
        opens = lambda s, i: (i > 0) & (s["starts"] | F.get(rows, i - 1)["ends"])
        return F.array_join(F.transform(rows, lambda s, i: F.concat(F.when(opens(s, i), "\n").otherwise(""), s["text"])), "")

    # bound to a variable, so that lines are tested once
    return F.get(F.transform(F.array(marked), joined), F.lit(0))


def dewrap(df: DataFrame, doc: str, text: str, starts: LineTest, ends: LineTest) -> DataFrame:
    """(doc, pos, line): the paragraphs of each text."""
    rows = df.select(doc, F.posexplode(F.split(dewrapped(F.col(text), starts, ends), "\n")).alias("pos", "line"))
    return rows.where("line <> ''")


#: Lines that are no text wherever they stand: page numbers with dashes or none, Roman ones, and entries of contents.
PAGE_NUMBER = r"^[-—–\s]*[0-9]{1,4}[-—–\s]*$"
ROMAN_NUMBER = r"^(?:[ⅠⅡⅢⅣⅤⅥⅦⅧⅨⅩⅪⅫ]+|[IVX]+|[ivx]+)$"
CONTENTS_ENTRY = r"…|[.·]{4,}\s*[0-9]+$"
BARE_NUMBER = "^[0-9]+$"


def masked(line: Column) -> Column:
    """A line as heads and feet of pages are compared: numbers, Arabic or Roman, as one sign, and spaces left out."""
    return F.regexp_replace(F.regexp_replace(line, r"[0-9]+|\b[ivxIVX]+\b|[ⅠⅡⅢⅣⅤⅥⅦⅧⅨⅩⅪⅫ]+", "#"), f"[{SPACE}]+", "")


def running_lines(df: DataFrame, doc: str, page: str, pos: str, line: str, edge: int = 2, share: float = 0.5, least_pages: int = 3) -> DataFrame:
    """All rows with ``running``: whether a line is a page's running head or foot.

    It is if its masked text stands among the first, or last, ``edge`` non-blank lines on at least ``least_pages`` pages and
    more than ``share`` of the document's pages, at the same end. Blank lines are not. A document's pages are counted by
    what they say, so that a task holds no document whole.
    """
    blank = F.coalesce(strip(F.col(line)), F.lit("")) == ""
    of_page = Window.partitionBy(doc, page)
    rows = df.withColumn("_blank", blank).withColumn("_up", F.count_if(~F.col("_blank")).over(of_page.orderBy(pos))).withColumn("_all", F.count_if(~F.col("_blank")).over(of_page))
    head, foot = F.col("_up") <= edge, F.col("_up") > F.col("_all") - edge
    ends = F.when(~F.col("_blank"), F.filter(F.array(F.when(head, "head"), F.when(foot, "foot")), lambda x: x.isNotNull()))
    rows = written(rows.withColumn("_key", masked(F.col(line))).withColumn("_ends", ends).drop("_blank", "_up", "_all"), "lines")
    pages = rows.select(doc, page).distinct().groupBy(doc).agg(F.count("*").alias("_pages"))
    seen = rows.select(doc, page, "_key", F.explode("_ends").alias("_end")).distinct().groupBy(doc, "_end", "_key").agg(F.count("*").alias("_on"))
    same = lambda a, b: F.col(a).eqNullSafe(F.col(b))
    pages = pages.withColumnRenamed(doc, "_doc")
    seen = seen.join(pages, same(doc, "_doc")).where((F.col("_on") >= least_pages) & (F.col("_on") > share * F.col("_pages")))
    found = seen.groupBy("_doc", F.col("_key").alias("_mask")).agg(F.collect_set("_end").alias("_at"))
    rows = rows.join(found, same(doc, "_doc") & (F.col("_key") == F.col("_mask")), "left")
    return rows.withColumn("running", F.coalesce(F.arrays_overlap("_ends", "_at"), F.lit(False))).drop("_key", "_ends", "_doc", "_mask", "_at")


def page_text(df: DataFrame, doc: str, page: str, pos: str, line: str, captions: str | None = None, title: str | None = None, edge: int = 2, trailing: int = 2) -> DataFrame:
    """The rows that are text: without running heads and feet, bare numbers at a page's end, page numbers, Roman numbers,
    entries of contents, blank lines, and lines that are the title or match ``captions``.

    After heads and feet are gone, up to ``trailing`` bare numbers at the end of a page go too, of whatever length.
    """
    rows = running_lines(df, doc, page, pos, line, edge).where("NOT running").drop("running")
    rows = rows.where(strip(F.col(line)) != "")
    up = Window.partitionBy(doc, page).orderBy(F.desc(pos))
    number = strip(F.col(line)).rlike(BARE_NUMBER)
    rows = rows.withColumn("_from_end", F.row_number().over(up)).withColumn("_other", F.count_if(~number).over(up))
    rows = rows.where(~((F.col("_other") == 0) & (F.col("_from_end") <= trailing))).drop("_from_end", "_other")
    patterns = [PAGE_NUMBER, ROMAN_NUMBER, CONTENTS_ENTRY, *([captions] if captions else [])]
    return drop_layout_noise(rows, line, patterns, title)


def drop_layout_noise(df: DataFrame, line: str, patterns: Sequence[str], title: str | None = None) -> DataFrame:
    """Lines that match none of the patterns, white space at their ends aside, and are not the title."""
    test = F.lit(False)
    for pattern in patterns:
        test = test | strip(F.col(line)).rlike(pattern)
    return df.where(~test if title is None else ~(test | (strip(F.col(line)) == title)))


def parse_header(df: DataFrame, text: str, fields: Mapping[str, str]) -> DataFrame:
    """A column for each labelled field, first match, null if there is none."""
    return df.withColumns({name: F.nullif(strip(F.regexp_extract(text, pattern, 1)), F.lit("")) for name, pattern in fields.items()})


def measure_body(df: DataFrame, text: str, title: str, marks: Sequence[str], fields: Mapping[str, str], signs: Sequence[str], endings: Sequence[str], word: str = "附件", longest: int = 80) -> DataFrame:
    """Add body_len (characters before the first metadata label, without the title and white space), has_attachment,
    attachments (distinct file names in order), and what ``fields`` names, as ``parse_header`` does: the record's address
    and id.

    There is an attachment where one of ``signs`` stands, or ``word`` before a number. A file name is what follows the
    word, its number and punctuation, on one line, up to the first of ``endings`` after at most ``longest`` characters.
    A null title is not taken out; a null text has no lengths.
    """
    ends = [F.coalesce(F.nullif(F.locate(m, F.col(text)), F.lit(0)), F.length(text) + 1) for m in marks]
    body = F.substring(F.col(text), F.lit(1), F.least(*ends, F.length(text) + 1) - 1)
    core = F.regexp_replace(F.replace(body, F.coalesce(title, F.lit("")), F.lit("")), f"[{SPACE}]+", "")
    after = F.slice(F.split(text, word), 2, 1 << 30)  # what stands after each word
    blank, digits, points = " \t\r\n\u3000", "0123456789", ":：、."
    numbered = F.exists(after, lambda x: F.substring(F.ltrim(x, F.lit(blank)), 1, 1).isin(*HAN_DIGITS, *digits))
    ending = "|".join(sorted(endings, key=len, reverse=True))
    named = lambda x: F.ltrim(F.ltrim(F.ltrim(x, F.lit(blank)), F.lit(HAN_DIGITS + digits)), F.lit(blank + points))
    files = F.transform(after, lambda x: strip(F.regexp_extract(named(x), f"(?i)^[^\n]{{0,{longest}}}?[.](?:{ending})", 0)))
    out = df.withColumn("body_len", F.length(core)).withColumn("has_attachment", has_any(text, signs) | numbered)
    out = out.withColumn("attachments", F.array_distinct(F.filter(files, lambda x: x != "")))
    return parse_header(out, text, fields)


def collect_links(df: DataFrame, html: str) -> DataFrame:
    """Add links (distinct addresses in order) and attachment_links (those that look like files)."""
    links = F.array_distinct(F.regexp_extract_all(html, F.lit('href="([^"]+)"'), F.lit(1)))
    look = r"(?i)\.(?:pdf|docx?|xlsx?|zip|rar)|download|attach|file"
    return df.withColumn("links", links).withColumn("attachment_links", F.filter("links", lambda x: x.rlike(look)))


def render_notes(df: DataFrame, note: str, n_articles: str, has_attachment: str, reason: str) -> DataFrame:
    articles = F.when(F.col(n_articles) > 0, F.concat(F.col(n_articles).cast("string"), F.lit("条"))).otherwise("无第X条")
    return df.withColumn("rendered", F.concat_ws("｜", note, articles, F.when(F.col(has_attachment), "有附件"), reason))
